"""Data-quality profiles of keyed sample tables, in long form: one row for each column, rule or group."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import label01
from tidemark.operators.ranks import quantiles, running
from tidemark.shared import stored


def null_counts(df: DataFrame) -> DataFrame:
    """(column, nulls, ratio) in one pass."""
    one = df.agg(F.count("*").alias("_n"), *(F.count_if(F.col(c).isNull()).alias(c) for c in df.columns))
    return one.unpivot("_n", df.columns, "column", "nulls").select("column", "nulls", F.when(F.col("_n") == 0, 0.0).otherwise(F.col("nulls") / F.col("_n")).alias("ratio"))


def shape(df: DataFrame) -> DataFrame:
    """rows, columns, rows that repeat another, rows with any null."""
    any_null = F.greatest(*(F.col(c).isNull() for c in df.columns)) if len(df.columns) > 1 else F.col(df.columns[0]).isNull()
    rows = df.groupBy(*df.columns).agg(F.count("*").alias("_many")).withColumn("_null", any_null)
    return rows.agg(
        F.coalesce(F.sum("_many"), F.lit(0)).alias("rows"), F.lit(len(df.columns)).alias("columns"), F.coalesce(F.sum(F.col("_many") - 1), F.lit(0)).alias("duplicate_rows"),
        F.coalesce(F.sum(F.when(F.col("_null"), F.col("_many")).otherwise(0)), F.lit(0)).alias("rows_with_null"),
    )


def label_summary(df: DataFrame, raw: Column) -> DataFrame:
    """Counts and ratios over all rows; invalid is what is there and neither 0 nor 1."""
    label = label01(raw)
    n, pos, neg = F.count("*"), F.count_if(label == 1), F.count_if(label == 0)
    return df.agg(n.alias("rows"), neg.alias("negatives"), pos.alias("positives"), F.count_if(label.isNull()).alias("missing"), F.count_if(raw.isNotNull() & label.isNull()).alias("invalid"),
                  (pos / n).alias("positive_ratio"), F.when(F.least(pos, neg) > 0, F.greatest(pos, neg) / F.least(pos, neg)).alias("imbalance"))


def long_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value), NaN as null."""
    doubles = df.select(*(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c) for c in columns))
    return doubles.unpivot([], columns, "column", "value")


def numeric_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count, moments, exact quartiles (linear), missing, infinite, negative, zero and dominant ratios of each column.

    Values are counted first, so that quartiles are taken over distinct values with frequencies, by ranges of values."""
    counted = stored(long_numeric(df, columns).groupBy("column", "value").agg(F.count("*").alias("n")))
    v, n = F.col("value"), F.col("n")
    fine = v.isNotNull() & (F.abs(v) != float("inf"))
    x = F.when(fine, v)
    total = counted.groupBy("column").agg(
        F.sum(F.when(fine, n).otherwise(0)).alias("count"), F.sum(F.when(fine, v * n)).alias("_sum"), F.min(x).alias("min"), F.max(x).alias("max"),
        F.sum(F.when(v.isNull(), n).otherwise(0)).alias("missing"), F.sum(F.when(F.abs(v) == float("inf"), n).otherwise(0)).alias("infinite"),
        F.sum(F.when(fine & (v < 0), n).otherwise(0)).alias("negative"), F.sum(F.when(v == 0, n).otherwise(0)).alias("zero"), F.max(F.when(fine, n)).alias("_top"), F.sum("n").alias("_all"),
    )
    mean = total.select(F.col("column"), (F.col("_sum") / F.col("count")).alias("mean"))
    spread = counted.where(fine).join(F.broadcast(mean), "column").groupBy("column").agg(F.sum(n * (v - F.col("mean")) * (v - F.col("mean"))).alias("_sq"))
    middle = quantiles(counted.where(fine), ["column"], "value", "n", {"q25": 0.25, "median": 0.5, "q75": 0.75})
    out = total.join(mean, "column").join(spread, "column", "left").join(middle, "column", "left")
    var = F.when(F.col("count") > 1, F.col("_sq") / (F.col("count") - 1))
    return out.select("column", "count", "mean", F.sqrt(var).alias("std"), "min", "q25", "median", "q75", "max", "missing", "infinite", "negative", "zero",
                      (F.col("zero") / F.col("count")).alias("zero_ratio"), var.alias("variance"), (F.col("_top") / F.col("count")).alias("dominant_ratio"), (F.col("missing") / F.col("_all")).alias("missing_ratio"))


def numeric_warnings(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, rule) of suspicious columns, outliers of three interquartile ranges among them."""
    p = numeric_profile(df, columns)
    spread = F.col("q75") - F.col("q25")
    bounds = F.broadcast(p.where("count >= 4").select("column", (F.col("q25") - 3 * spread).alias("low"), (F.col("q75") + 3 * spread).alias("high")).where("low != high"))
    out = long_numeric(df, columns).join(bounds, "column").where("value < low OR value > high").select("column", F.lit("outliers").alias("rule")).distinct()
    c = F.col
    rules = [(c("missing_ratio") > 0.3, "missing"), (c("infinite") > 0, "infinite"), (c("variance") == 0, "zero_variance"), (c("dominant_ratio") >= 1.0, "constant"), ((c("dominant_ratio") > 0.9) & (c("dominant_ratio") < 1.0), "quasi_constant"), (c("zero_ratio") > 0.9, "zeros")]
    named = p.select("column", F.explode(F.array_compact(F.array(*(F.when(r, F.lit(n)) for r, n in rules)))).alias("rule"))
    return named.unionByName(out)


def family_rollup(profile: DataFrame, families: dict[str, str]) -> DataFrame:
    family = F.create_map(*(F.lit(x) for kv in families.items() for x in kv))[F.col("column")]
    return profile.groupBy(family.alias("family")).agg(F.count("*").alias("columns"), F.sum("missing").alias("missing"), F.avg("missing_ratio").alias("mean_missing_ratio"), F.count_if(F.col("dominant_ratio") >= 1).alias("constant"), F.avg("mean").alias("mean"), F.median("median").alias("median"), F.min("min").alias("min"), F.max("max").alias("max"))


def repository_profile(df: DataFrame) -> DataFrame:
    """rows, distinct commits, labels and whether there is one class only, by repository."""
    return df.groupBy("repository").agg(F.count("*").alias("rows"), F.countDistinct("commit").alias("commits"), F.count_if(F.col("label") == 0).alias("negatives"), F.count_if(F.col("label") == 1).alias("positives")).withColumn(
        "single_class", F.when(F.col("negatives") == 0, "only_positive").when(F.col("positives") == 0, "only_negative"))


def coverage(df: DataFrame, valid: Column) -> DataFrame:
    """Valid rows overall, by label and by repository: grouping sets in one aggregate."""
    rows = df.withColumn("_ok", valid.cast("int"))
    out = rows.groupingSets([[], ["label"], ["repository"]], "label", "repository").agg(F.count("*").alias("rows"), F.sum("_ok").alias("valid"), F.grouping_id("label", "repository").alias("_g"))
    return out.select(F.when(F.col("_g") == 3, "all").when(F.col("_g") == 1, "label").otherwise("repository").alias("section"), F.coalesce(F.col("label").cast("string"), "repository", F.lit("*")).alias("key"), "rows", "valid", (F.col("valid") / F.col("rows")).alias("ratio"))


def leakage(df: DataFrame) -> DataFrame:
    """Files of a repository in several commits, rows they hold, and repositories of several commits. Null keys are keys."""
    # by commit first: distinct counts beside others would copy every row for each of them
    each = df.groupBy("repository", "filepath", "commit").agg(F.count("*").alias("rows"), *(F.count_if(F.col("label") == k).alias(f"n{k}") for k in (0, 1)))
    there = F.col("commit").isNotNull()
    files = each.groupBy("repository", "filepath").agg(F.count("commit").alias("commits"), F.sum("rows").alias("rows"), F.sum("n1").alias("pos"),
                                                       *(F.count_if(there & (F.col(f"n{k}") > 0)).alias(f"c{k}") for k in (0, 1)))
    repos = df.groupBy("repository").agg(F.countDistinct("commit").alias("c"), F.count("*").alias("r"))
    many = F.col("commits") > 1
    a = files.agg(F.count_if(many).alias("files_in_several_commits"), F.sum(F.when(many, F.col("rows")).otherwise(0)).alias("rows_affected"), F.sum(F.when(many, F.col("pos")).otherwise(0)).alias("positives_affected"),
                  *(F.count_if(F.col(f"c{k}") > 1).alias(f"files_in_several_commits_label_{k}") for k in (0, 1)))
    b = repos.agg(F.count_if(F.col("c") > 1).alias("repositories_of_several_commits"), F.sum(F.when(F.col("c") > 1, F.col("r")).otherwise(0)).alias("rows_in_them"))
    return a.crossJoin(F.broadcast(b))  # one row each


def gram(rows: DataFrame, centre: list[float]) -> DataFrame:
    """(i, j, n, sx, sy, sxx, syy, sxy, same) for places i < j of the columns of rows, all doubles: over rows where both are
    there how many, and sums of values less centre, their squares and products; same counts equal values, two missing ones
    too. One pass: a partition adds up its own batches, so that what is shuffled is one row for each pair and partition."""
    size = len(centre)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(float)
            there = ~np.isnan(x)
            held, z, gone = there.astype(float), np.where(there, x - centre, 0.0), (~there).astype(float)
            same = np.stack([(x == x[:, [i]]).sum(axis=0) for i in range(size)]) + gone.T @ gone
            now = np.stack([held.T @ held, z.T @ held, held.T @ z, (z * z).T @ held, held.T @ (z * z), z.T @ z, same])
            total = now if total is None else total + now
        if total is not None:
            i, j = np.triu_indices(size, 1)
            ints = [pa.array(k, type=pa.int32()) for k in (i, j)]
            yield pa.RecordBatch.from_arrays([*ints, *(pa.array(part[i, j]) for part in total)], names=["i", "j", *GRAM])

    sums = rows.mapInArrow(add, "i int, j int, " + ", ".join(f"{c} double" for c in GRAM))
    return sums.groupBy("i", "j").agg(*(F.sum(c).alias(c) for c in GRAM))


#: Distinct values of a column up to which its ranks are broadcast.
FEW = 50_000


GRAM = ["n", "sx", "sy", "sxx", "syy", "sxy", "same"]


def coefficient() -> Column:
    """Pearson's coefficient from the sums of gram(); null where a side does not vary."""
    part = lambda c, a, b: F.col(c) - F.col(a) * F.col(b) / F.col("n")
    x, y = part("sxx", "sx", "sx"), part("syy", "sy", "sy")
    return F.when((F.col("n") > 0) & (x > 0) & (y > 0), part("sxy", "sx", "sy") / (F.sqrt(x) * F.sqrt(y)))


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, pearson, spearman, equal_ratio) of all pairs of columns: the coefficients over rows where both are
    there, the ratio of equal values over all rows, in which two missing values are equal.

    Sums of all pairs come from one pass over the rows. A column's values are counted once, beside each pattern of missing
    values of other columns that takes rows from it, and their ranks looked up: by broadcast for up to FEW distinct values,
    else the rows are shuffled once by it. The driver holds counts of columns and of pairs of them."""
    spark, xs = df.sparkSession, [f"x{i}" for i in range(len(columns))]
    rows = stored(df.select(*(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(x) for c, x in zip(columns, xs, strict=True))))
    first = rows.agg(F.count("*").alias("all"), *(f(x).alias(f"{k}{x}") for x in xs for k, f in (("n", F.count), ("m", F.avg)))).first()
    centre = [first[f"m{x}"] if first[f"m{x}"] is not None and math.isfinite(first[f"m{x}"]) else 0.0 for x in xs]
    sums = stored(gram(rows, centre))
    both = {(r["i"], r["j"]): r["n"] for r in sums.select("i", "j", "n").collect()}
    there = {(i, i): first[f"n{x}"] for i, x in enumerate(xs)} | both | {(j, i): n for (i, j), n in both.items()}
    # columns that are missing in the same rows share a pattern, named by the first of them
    pattern = [min(k for k in range(i + 1) if there[k, i] == there[i, i] == there[k, k]) for i in range(len(columns))]
    # a column, among the rows that a pattern leaves it; None where it takes none
    needed = {(i, pattern[j] if there[i, j] < there[i, i] else None) for i, j in there if i != j}
    ranked = sorted(needed, key=lambda v: (v[0], -1 if v[1] is None else v[1]))
    if not ranked:
        return spark.createDataFrame([], "a string, b string, pearson double, spearman double, equal_ratio double")
    found = rows
    for i, among in value_ranks(rows, xs, ranked).items():
        # missing values are spread, as none finds a rank
        found = found.withColumn("_salt", F.when(F.col(xs[i]).isNull(), F.pmod(F.monotonically_increasing_id(), F.lit(1024)) + 1).otherwise(0))
        found = found.join(among, [xs[i], "_salt"], "left").drop("_salt")
    wide = found.select(*((F.col(f"r{i}") if k is None else F.when(F.col(xs[k]).isNotNull(), F.col(f"r{i}_{k}"))).alias(f"v{v}") for v, (i, k) in enumerate(ranked)))
    place = {v: k for k, v in enumerate(ranked)}
    sides = [(i, j, *sorted((place[i, pattern[j] if there[i, j] < there[i, i] else None], place[j, pattern[i] if there[i, j] < there[j, j] else None]))) for i, j in both]
    names = F.broadcast(spark.createDataFrame([(i, j, columns[i], columns[j], v, w) for i, j, v, w in sides], "i int, j int, a string, b string, v int, w int"))  # pairs of columns
    spearman = gram(wide, [first["all"] / 2] * len(ranked)).select(F.col("i").alias("v"), F.col("j").alias("w"), coefficient().alias("spearman"))
    out = sums.join(names, ["i", "j"]).join(spearman, ["v", "w"], "left")
    return out.select("a", "b", coefficient().alias("pearson"), "spearman", (F.col("same") / first["all"]).alias("equal_ratio"))


def value_ranks(rows: DataFrame, xs: list[str], ranked: list[tuple[int, int | None]]) -> dict[int, DataFrame]:
    """For each column i of ranked, by its distinct values: (x<i>, _salt of 0, r<i>: average rank among all rows, r<i>_<k>:
    among those where column k is there, for each k that is ranked with i)."""
    there = sorted({k for _, k in ranked if k is not None})
    flags, sums = [f"_t{k}" for k in there], ["_n", *(f"_n{k}" for k in there)]
    long = rows.select(*xs, *(F.col(xs[k]).isNotNull().alias(f) for k, f in zip(there, flags, strict=True))).unpivot(flags, xs, "c", "value").where("value IS NOT NULL")
    counted = stored(long.groupBy("c", "value").agg(F.count("*").alias("_n"), *(F.count_if(f).alias(n) for f, n in zip(flags, sums[1:], strict=True))))
    distinct = {r["c"]: r["count"] for r in counted.groupBy("c").count().collect()}
    rank = lambda n: F.when(F.col(n) > 0, F.col(f"{n}_upto") - F.col(n) + (F.col(n) + 1) / 2.0)
    ranks = stored(running(counted, ["c"], "value", sums).select("c", "value", *(rank(n).alias(f"_r{n[2:]}") for n in sums)))
    out = {}
    for i in sorted({i for i, _ in ranked}):
        wanted = [F.col("_r" if k is None else f"_r{k}").alias(f"r{i}" if k is None else f"r{i}_{k}") for j, k in ranked if j == i]
        each = ranks.where(F.col("c") == xs[i]).select(F.col("value").alias(xs[i]), F.lit(0).cast("long").alias("_salt"), *wanted)
        out[i] = F.broadcast(each) if distinct.get(xs[i], 0) <= FEW else each.hint("merge")
    return out


def strong_pairs(pairs: DataFrame, threshold: float = 0.95, duplicate: float = 0.99) -> DataFrame:
    """Of correlations() those whose larger coefficient is above threshold, with it and whether they are near duplicates."""
    size = F.greatest(*(F.coalesce(F.abs(F.nanvl(c, F.lit(0.0))), F.lit(0.0)) for c in ("pearson", "spearman")))
    out = pairs.withColumn("max_abs", size).where(F.col("max_abs") > threshold)
    return out.withColumn("near_duplicate", F.col("equal_ratio") > duplicate)


def metric_validity(df: DataFrame, columns: list[str]) -> Column:
    """Whether any of columns is a number other than 0: what tells valid rows where there is no status."""
    out = F.lit(False)
    for c in columns:
        x = F.col(c).cast("string").try_cast("double")
        out = out | F.coalesce((x != 0) & ~F.isnan(x), F.lit(False))
    return out


def usable_graphs(df: DataFrame) -> DataFrame:
    """(section, key, value) from (repository, label, path, status, found): rows with a path, of status SUCCESS, whose file is found."""
    ok = (F.trim(F.coalesce("path", F.lit(""))) != "") & (F.upper("status") == "SUCCESS") & F.col("found").isNotNull()
    rows = df.withColumn("_ok", F.coalesce(ok, F.lit(False)).cast("int"))
    one = rows.agg(F.sum("_ok").alias("u"), F.count("*").alias("n"), *(F.sum(F.when(F.col("label") == k, F.col("_ok")).otherwise(0)).alias(f"l{k}") for k in (0, 1)))
    repos = rows.where("repository IS NOT NULL").groupBy("repository").agg(F.max("_ok").alias("m")).agg(F.sum("m").alias("r"), F.sum(1 - F.col("m")).alias("e"))
    said = [("overall", "usable_graphs", "u"), ("overall", "usable_graph_ratio", "u / n"), ("label", "0", "l0"), ("label", "1", "l1"), ("repositories", "represented", "r"), ("repositories", "excluded", "e")]
    cells = F.explode(F.array(*(F.struct(F.lit(a).alias("section"), F.lit(b).alias("key"), F.expr(c).cast("double").alias("value")) for a, b, c in said)))
    return one.crossJoin(F.broadcast(repos)).select(cells.alias("c")).select("c.*")  # one row each


def temporal_summary(df: DataFrame, raw: str, now: Column) -> DataFrame:
    """Dates that do not parse, the first and last, and those after now and before 1990."""
    at = F.try_to_timestamp(F.col(raw))
    return df.agg(F.count_if(F.col(raw).isNotNull() & at.isNull()).alias("unparsable"), F.min(at).alias("first_at"), F.max(at).alias("last_at"), F.count_if(at > now).alias("future"), F.count_if(F.year(at) < 1990).alias("before_1990"))


def yearly(df: DataFrame, raw: str) -> DataFrame:
    at = F.try_to_timestamp(F.col(raw))
    return df.where(at.isNotNull()).groupBy(F.year(at).alias("year")).agg(F.count("*").alias("rows"))


def value_counts(df: DataFrame, column: str, missing: str = "MISSING") -> DataFrame:
    return df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit(missing)).alias("value")).agg(F.count("*").alias("n"))


def stability(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Mean, population deviation, least, most and range of metrics over runs."""
    long = df.unpivot(keys, columns, "metric", "value")
    return long.groupBy(*keys, "metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"), (F.max("value") - F.min("value")).alias("range"))


def monthly(df: DataFrame, at: str) -> DataFrame:
    month = F.date_format(at, "yyyy-MM")
    return df.groupBy(month.alias("month")).agg(F.count("*").alias("rows"), F.count_if(F.col("label") == 0).alias("label_0"), F.count_if(F.col("label") == 1).alias("label_1"))


def ranked_top(df: DataFrame, by: str, key: str, n: int) -> DataFrame:
    return df.orderBy(F.desc(by), key).limit(n)
