"""Sharding by a hypergeometric communication matrix.

A uniform random permutation of all rows, cut into shards of exact size, moves a random number of
rows from each input partition to each shard. Those numbers are drawn first, on the driver, from
the multivariate hypergeometric law (one row of the matrix for each partition). Each partition then
permutes its own rows and deals them out by its row of the matrix, the rows are exchanged once, and
each shard permutes what it got. Every assignment of rows to places is equally likely and shard
sizes differ by one row at most.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.text import others
from tidemark.shared import fixed, fresh

#: Rows of the matrix (one a partition) up to which it is broadcast.
BROADCAST = 100_000
#: Bits of monotonically_increasing_id that count rows in a partition.
ROW_BITS = 33


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """Good ones among n drawn without replacement. Beyond numpy's bound of 1e9, by inversion over
    forty standard deviations around the mean; what lies outside is under the resolution of a double."""
    if good + bad < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, n))
    total = good + bad
    mean = n * good / total
    sd = math.sqrt(max(1.0, mean * (bad / total) * (total - n) / max(1, total - 1)))
    low, high = max(0, n - bad, int(mean - 40 * sd)), min(n, good, int(mean + 40 * sd) + 1)
    x = np.arange(low, high, dtype=np.float64)
    steps = np.log(good - x) + np.log(n - x) - np.log(x + 1) - np.log(bad - n + x + 1)
    weight = np.concatenate([[0.0], np.cumsum(steps)])
    weight = np.cumsum(np.exp(weight - weight.max()))
    return low + int(np.searchsorted(weight, rng.random() * weight[-1]))


def communication_matrix(rows: list[int], shards: list[int], seed: int) -> np.ndarray:
    """A random matrix with these row and column sums, as a uniform permutation makes it."""
    rng, left = np.random.default_rng(seed), list(shards)
    out = np.zeros((len(rows), len(shards)), dtype=np.int64)
    for i, n in enumerate(rows):
        rest = sum(left)
        for k in range(len(left)):
            rest -= left[k]
            out[i, k] = take = hypergeometric(rng, left[k], rest, n) if n else 0
            left[k] -= take
            n -= take
    return out


def shard_sizes(rows: int, n_shards: int) -> list[int]:
    """Equal sizes; the first shards have one row more where it doesn't come out even."""
    return [rows // n_shards + (k < rows % n_shards) for k in range(n_shards)]


def shard_rows(df: DataFrame, n_shards: int = 8, seed: int = 20_240, bucket_rows: int = 100_000) -> DataFrame:
    """df with `shard` (int, 0 to n_shards - 1) and `slot` (long, 0 up to the shard's size - 1).

    Row counts of shards differ by one at most, whatever the rows hold: nulls, empty or very long
    texts, ties and repeated rows are rows like any other, and equal rows may go to different
    shards. An empty table gives an empty table. Columns of df called shard or slot are replaced.
    The rows are written to the shared folder first, so that a partition means the same rows in
    every later job, and a rerun with the same partitions and seed gives the same result. The
    driver draws one matrix row for each partition, and each partition is joined with its own. A shard is permuted in buckets of about
    bucket_rows rows, so that no task holds a shard.
    """
    df = df.drop("shard", "slot")
    pos, bucket, offset, key, many, of, dealt_row = fresh(df, "_pos", "_bucket", "_offset", "_key", "_many", "_of", "_cells")
    base = fixed(df.withColumn(pos, F.monotonically_increasing_id()))
    part = F.shiftright(F.col(pos), ROW_BITS)
    counts = {r[0]: r[1] for r in base.groupBy(part.alias(key)).count().collect()}
    total = sum(counts.values())
    sizes = shard_sizes(total, n_shards)
    order = sorted(counts)
    drawn = communication_matrix([counts[p] for p in order], sizes, seed)
    matrix = df.sparkSession.createDataFrame([(p, row.tolist()) for p, row in zip(order, drawn, strict=True)], f"{of} long, {dealt_row} array<long>")
    matrix = F.broadcast(matrix) if len(order) <= BROADCAST else matrix

    @F.pandas_udf("int")
    def deal(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        last = dealt = None
        for at, cells in batches:
            at = at.to_numpy()
            parts, row = at >> ROW_BITS, at & ((1 << ROW_BITS) - 1)
            out = np.empty(len(at), dtype=np.int32)
            for p in np.unique(parts):
                here = np.flatnonzero(parts == p)
                if p != last:
                    last, dealt = p, np.repeat(np.arange(n_shards, dtype=np.int32), cells.iloc[here[0]])
                    np.random.default_rng([seed, int(p)]).shuffle(dealt)
                out[here] = dealt[row[here]]
            yield pd.Series(out)

    n_buckets = max(256, math.ceil(total / n_shards / bucket_rows))
    dealt = base.withColumn(of, part).join(matrix, of).withColumn("shard", deal(pos, dealt_row)).drop(of, dealt_row)
    dealt = dealt.withColumns({bucket: F.pmod(F.xxhash64(F.lit(seed), pos), F.lit(n_buckets))})
    starts = (
        dealt.groupBy("shard", bucket).agg(F.count("*").alias(many))
        .withColumn(offset, F.sum(many).over(Window.partitionBy("shard").orderBy(bucket)) - F.col(many))
        .drop(many)
    )
    within = Window.partitionBy("shard", bucket).orderBy(F.xxhash64(F.lit(seed + 1), pos), pos)
    slot = F.col(offset) + F.row_number().over(within) - 1
    return dealt.join(starts, ["shard", bucket]).withColumn("slot", slot.cast("long")).select(*others(df, ["shard", "slot"]), "shard", "slot")
