"""Ranks, running sums and quantiles of keys of any size.

Rows are dealt to partitions by range of (keys, order). Each partition sums its own stretch of a key,
and the stretches before it are added from one row for each key and partition: no key is ordered in
one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.shared import fresh, stored


def same(left: DataFrame, right: DataFrame, columns: dict[str, str]) -> Column:
    """Null-safe equality of columns of left with those of right."""
    return reduce(lambda a, b: a & b, (left[x].eqNullSafe(right[y]) for x, y in columns.items()))


def joined(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """left joined with right on keys where nulls are equal; the columns of right beside the keys follow."""
    names = dict(zip(keys, fresh(left, *(f"_{k}_r" for k in keys)), strict=True))
    other = right.withColumnsRenamed(names)
    return left.join(other, same(left, other, names), how).drop(*names.values())


def running(df: DataFrame, keys: list[str], order: str, sums: list[str], *, descending: bool = False) -> DataFrame:
    """df with {c}_upto for each of sums: the sum over the rows of its keys up to it in order, itself
    included. Equal orders of a key are in any order, so aggregate by them first. Null keys are keys."""
    (part,) = fresh(df, "_part")
    by = F.desc(order) if descending else F.asc(order)
    ranged = stored(df.repartitionByRange(*map(F.asc, keys), by).withColumn(part, F.spark_partition_id()))
    totals = ranged.groupBy(*keys, part).agg(*(F.sum(c).alias(f"_{c}") for c in sums))
    before = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumns({f"_{c}": F.coalesce(F.sum(f"_{c}").over(before), F.lit(0)) for c in sums})
    within = Window.partitionBy(*keys, part).orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.withColumns({f"{c}_upto": F.sum(c).over(within) for c in sums})
    out = joined(out, totals, [*keys, part])
    return out.withColumns({f"{c}_upto": F.col(f"{c}_upto") + F.col(f"_{c}") for c in sums}).drop(part, *(f"_{c}" for c in sums))


def average_rank(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """df with the rank of value among its keys, ties sharing the mean of their places; null comes first."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    ranks = running(counts, keys, value, ["_n"])
    ranks = ranks.select(*keys, value, (F.col("_n_upto") - F.col("_n") + (F.col("_n") + 1) / 2.0).alias(name))
    return joined(df.drop(name), ranks, [*keys, value])


def numbered_rows(df: DataFrame, order: list[str], name: str = "row_index") -> DataFrame:
    """df with the 1-based place of each row in order, which has to tell all rows apart."""
    rows = df.withColumns({"_order": F.struct(*order), "_one": F.lit(1).cast("long")})
    return running(rows, [], "_order", ["_one"]).withColumnRenamed("_one_upto", name).drop("_order", "_one")


def quantiles(counted: DataFrame, keys: list[str], value: str, n: str, wanted: dict[str, float]) -> DataFrame:
    """Exact quantiles (linear between neighbours) by keys from distinct values with frequencies n; value is never null."""
    rows = running(counted.select(*keys, value, n), keys, value, [n])
    rows = joined(rows, counted.groupBy(*keys).agg(F.sum(n).alias("_all")), keys) if keys else rows.crossJoin(F.broadcast(counted.agg(F.sum(n).alias("_all"))))  # one row
    upto, below = F.col(f"{n}_upto"), F.col(f"{n}_upto") - F.col(n)
    aggs = [F.first("_all").alias("_all")]
    for name, p in wanted.items():
        place = (F.col("_all") - 1) * p
        for side, at in (("low", F.floor(place)), ("high", F.ceil(place))):
            aggs.append(F.max(F.when((below <= at) & (at < upto), F.col(value))).alias(f"_{name}_{side}"))
    out = rows.groupBy(*keys).agg(*aggs)
    part = {name: (F.col("_all") - 1) * p - F.floor((F.col("_all") - 1) * p) for name, p in wanted.items()}
    return out.select(*keys, *((F.col(f"_{name}_low") + (F.col(f"_{name}_high") - F.col(f"_{name}_low")) * part[name]).alias(name) for name in wanted))


#: Children of a node of the tree of ranks below: a level is one pass over values and questions.
RADIX_BITS = 4


def prefix_order(values: DataFrame, asked: DataFrame, keys: list[str], at: str, value: str, place: str) -> DataFrame:
    """asked (keys, at, place) with value: of the values of its keys that stand at a place of order `at` up to its own, the
    one of 0-based rank `place`, which has to be less than how many there are. value is never null.

    Values get their dense rank in their keys. Questions go down the digits of these ranks: running counts of each digit
    over `at`, for each node that digits so far name, say which child holds the value asked for. Each level is one pass
    over values and questions, whatever prefixes overlap."""
    ranked = running(values.groupBy(*keys, value).agg(F.lit(1).alias("_one")), keys, value, ["_one"])
    ranked = stored(ranked.select(*keys, value, (F.col("_one_upto") - 1).alias("_rank")))
    most = ranked.agg(F.max("_rank")).first()[0] or 0
    levels = max(1, -(-int(most).bit_length() // RADIX_BITS))
    counted = values.groupBy(*keys, at, value).agg(F.count("*").alias("_n"))
    counted = stored(joined(counted, ranked, [*keys, value]).select(*keys, at, "_rank", "_n"))
    digits = [f"_d{k}" for k in range(1 << RADIX_BITS)]
    (row,) = fresh(asked, "_row")
    marked = stored(asked.withColumn(row, F.monotonically_increasing_id()))
    left = marked.select(*keys, at, row, F.col(place).cast("long").alias("_place"), F.lit(0).cast("long").alias("_node"))
    for level in range(levels - 1, -1, -1):
        node, digit = F.shiftright("_rank", RADIX_BITS * (level + 1)), F.shiftright("_rank", RADIX_BITS * level).bitwiseAND(F.lit((1 << RADIX_BITS) - 1))
        held = counted.groupBy(*keys, node.alias("_node"), at).agg(*(F.sum(F.when(digit == k, F.col("_n")).otherwise(0)).alias(d) for k, d in enumerate(digits)))
        both = held.unionByName(left.withColumns({d: F.lit(0).cast("long") for d in digits}), allowMissingColumns=True)
        # values before questions of the same place
        both = both.withColumn("_order", F.struct(F.col(at).alias("at"), F.col(row).isNotNull().alias("asks")))
        found = running(both, [*keys, "_node"], "_order", digits).where(F.col(row).isNotNull())
        upto = F.array(*(F.col(f"{d}_upto") for d in digits))
        walk = F.aggregate(upto, F.struct(F.lit(-1).cast("long").alias("digit"), F.col("_place").alias("place"), F.lit(False).alias("done")), lambda a, n: F.when(a["done"], a).otherwise(F.struct((a["digit"] + 1).alias("digit"), F.when(n > a["place"], a["place"]).otherwise(a["place"] - n).alias("place"), (n > a["place"]).alias("done"))))
        found = found.withColumn("_walk", walk)
        left = found.select(*keys, at, row, F.col("_walk.place").alias("_place"), (F.shiftleft("_node", RADIX_BITS) + F.col("_walk.digit")).alias("_node"))
    ends = joined(left.select(*keys, row, F.col("_node").alias("_rank")), ranked, [*keys, "_rank"])
    return marked.join(ends.select(row, value), row).drop(row)
