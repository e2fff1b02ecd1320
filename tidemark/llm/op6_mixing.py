"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its documents in shuffled order, as often as a document may be repeated.
A document's virtual finish time is its source's words so far, itself included, divided by the
source's target. All are sorted by that time and cut where the words reach the total budget: at
every moment each source has had its share, and at the cut (time 1) its target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.text import n_words, others
from tidemark.shared import fixed

#: Rows of one virtual-time bucket, about: only the bucket with the cut is sorted row by row.
CUT_ROWS = 10_000


def source_targets(sizes: DataFrame, source: str, size: str, weights: tuple[int, ...], share: float, repeats: int) -> DataFrame:
    """(source, source_rank, source_size, target) from one row for each source.

    Sources by code point, null last, get the weights in turn. The total, share times all words, is
    shared by weight; a target stops at repeats times its source's size and the excess is reshared:
    with sources by repeats * size / weight, ascending, all before some source are full and the
    others get one level times their weight.
    """
    order = Window.orderBy(F.col(source).asc_nulls_last())
    rank = F.row_number().over(order) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.col("_rank"), F.lit(len(weights))) + 1).cast("double")
    ratio = F.col("_cap") / F.col("_weight")
    before = Window.orderBy(ratio, "_rank").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy(ratio, "_rank").rowsBetween(0, Window.unboundedFollowing)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum(size).over(whole) * F.lit(float(share)) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_weight").over(after)
    return (
        sizes.withColumn("_rank", rank)
        .withColumns({"_weight": weight, "_cap": (F.col(size) * repeats).cast("double")})
        .withColumn("_level", level)
        .withColumn("_level", F.max(F.when(F.col("_level") <= ratio, F.col("_level"))).over(whole))
        .select(source, F.col("_rank").alias("source_rank"), F.col(size).alias("source_size"), F.coalesce(F.least("_cap", F.col("_level") * F.col("_weight")), "_cap").alias("target"))
    )


def mix_sources(
    df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", size_col: str | None = None,
    weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, repeats: int = 2, seed: str = "mix",
) -> DataFrame:
    """df with size, source_size, target and taken (words the mix takes of the row, repeats counted).

    size is the number of words of text_col, or size_col as given. Null text has size 0; rows of size
    0 take nothing, and a source of such rows alone has the target 0. A null source is a source of its
    own, the last. The shuffle key comes from id and size, so that rows without an id or with a
    repeated one spread over the buckets; rows equal in both are told apart by nothing and may swap
    places. An empty table stays empty. Columns of df named as the results are replaced. df is read
    more than once, so hand over a table rather than a long computation. Sources may be of any size:
    running sums are made in buckets of the shuffle order and of the virtual time. What is sorted in
    one task is one row for each source, and the one bucket of virtual time in which the cut falls.
    """
    names = ["size", "source_size", "target", "taken"]
    size_expr: Column = F.coalesce(F.col(size_col), F.lit(0)).cast("long") if size_col else n_words(F.col(text_col))
    key, bucket, source = "_key", "_bucket", "_source"
    base = df.select(F.struct(*others(df, names)).alias("_row"), size_expr.alias("size"), F.col(id_col).cast("string").alias("_id"), F.col(source_col).alias(source))
    hashed = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce("_id", F.lit("")), F.lit(":"), F.col("size").cast("string")))
    base = base.select("_row", "size", hashed.alias(key), source)
    narrow = fixed(base.select(key, source, "size"))

    sums = narrow.groupBy(source).agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    n_rows = sums.agg(F.sum("n")).first()[0] or 0
    targets = source_targets(sums.select(source, "size"), source, "size", weights, share, repeats)
    hexes = 3 if n_rows < 50_000_000 else 4 if n_rows < 5_000_000_000 else 5
    targets = targets.withColumnRenamed(source, "_of")

    def queued(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn(bucket, F.substring(key, 1, hexes))
        starts = narrow.groupBy(source, F.substring(key, 1, hexes).alias(bucket)).agg(F.sum("size").alias("_sum"))
        starts = starts.join(targets, starts[source].eqNullSafe(targets["_of"])).drop("_of")
        starts = starts.withColumn("_start", F.sum("_sum").over(Window.partitionBy(source).orderBy(bucket)) - F.col("_sum")).drop("_sum")
        starts = starts.withColumnsRenamed({source: "_of", bucket: "_at"})
        within = Window.partitionBy(source, bucket).orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
        out = rows.withColumn("_run", F.sum("size").over(within))
        return out.join(starts, out[source].eqNullSafe(starts["_of"]) & (out[bucket] == starts["_at"])).withColumn("_run", F.col("_start") + F.col("_run")).drop("_of", "_at", "_start")

    def finish(copy: int) -> Column:
        # a source without words has the target 0 and no document that could be taken: its times are null
        return F.try_divide(F.col("_run") + F.col("source_size") * copy, F.col("target"))

    times = queued(narrow).where("size > 0").select("size", "source_rank", F.explode(F.array(*map(finish, range(repeats)))).alias("_time"))
    n_times = max(1024, n_rows * repeats // CUT_ROWS)
    slot = F.floor(F.col("_time") * n_times)
    budget = targets.agg(F.sum("target")).first()[0] or 0.0
    by_slot = times.groupBy(slot.alias("_slot")).agg(F.sum("size").alias("_sum"))
    wide = F.floor(F.col("_slot") / 1024)
    coarse = by_slot.groupBy(wide.alias("_wide")).agg(F.sum("_sum").alias("_sum"))

    def crossing(sums: DataFrame, at: str, start: float) -> tuple[int, float] | None:
        """The first place where the words pass the budget, and the words before it."""
        w = Window.orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
        run = sums.withColumn("_upto", F.sum("_sum").over(w) + F.lit(start))
        found = run.where(F.col("_upto") > budget).orderBy(at).select(at, F.col("_upto") - F.col("_sum")).first()
        return (found[0], found[1]) if found else None

    cut_time, cut_rank = float("inf"), 0
    if (first := crossing(coarse, "_wide", 0.0)) and (second := crossing(by_slot.where(wide == first[0]), "_slot", first[1])):
        w = Window.orderBy("_time", "source_rank").rowsBetween(Window.unboundedPreceding, 0)
        run = times.where(slot == second[0]).withColumn("_upto", F.sum("size").over(w) + F.lit(second[1]))
        cut_time, cut_rank = run.where(F.col("_upto") > budget).orderBy("_time", "source_rank").select("_time", "source_rank").first()

    def taken(copy: int) -> Column:
        early = (finish(copy) < F.lit(cut_time)) | ((finish(copy) == F.lit(cut_time)) & (F.col("source_rank") < cut_rank))
        return F.when(early & (F.col("size") > 0), F.col("size")).otherwise(F.lit(0))

    total = sum((taken(i) for i in range(1, repeats)), taken(0))
    return queued(base).withColumn("taken", total.cast("long")).select("_row.*", *names)
