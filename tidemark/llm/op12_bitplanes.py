"""Centroid clustering by bit planes.

A vector of 64 whole numbers is kept as its bit planes in two's complement: plane p holds bit p of all
64 components in one 64-bit word. A dot product is then the sum, over a plane of the one and a plane
of the other, of 2^(p + q) times the set bits of their AND, the top planes counting negative; norms
are dot products too, and a squared distance is exact. Centroids move by exact whole sums, added up in
each batch, then by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.text import others
from tidemark.shared import bounded_batches, discard, stored

SIZE = 64
#: Bits of a scaled component: squared distances then fit 64 bits.
MOST_BITS = 27


def whole_numbers(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))


def usable(vector: Column, scale: int) -> Column:
    """Whether a vector has 64 components, all of them finite and within MOST_BITS once scaled."""
    bound = float(1 << MOST_BITS)
    fine = F.forall(vector, lambda x: F.coalesce((F.floor(F.lit(float(scale)) * x.cast("double")) >= -bound) & (F.lit(float(scale)) * x.cast("double") < bound) & ~F.isnan(x), F.lit(False)))
    return F.coalesce((F.size(vector) == SIZE) & fine, F.lit(False))


def to_planes(x: np.ndarray) -> np.ndarray:
    """Rows of 64 whole numbers as rows of as many planes as the largest needs, the last of weight -2^p."""
    bits = 1 + max((int(np.abs(x).max(initial=0))).bit_length(), 1)
    out = np.empty((len(x), bits), dtype=np.uint64)
    for p in range(bits):
        out[:, p] = np.packbits(((x >> p) & 1).astype(np.uint8), axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def from_planes(planes: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(np.ascontiguousarray(planes).view(np.uint8).reshape(*planes.shape, 8), axis=2, bitorder="little")
    return np.einsum("npc,p->nc", bits.astype(np.int64), plane_weights(planes.shape[1]))


def plane_weights(bits: int) -> np.ndarray:
    out = np.left_shift(np.int64(1), np.arange(bits, dtype=np.int64))
    out[-1] = -out[-1]
    return out


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products of all rows of planes a with all rows of planes b."""
    out = np.zeros((len(a), len(b)), dtype=np.int64)
    for p, w in enumerate(plane_weights(a.shape[1])):
        for q, v in enumerate(plane_weights(b.shape[1])):
            out += w * v * np.bitwise_count(a[:, p, None] & b[None, :, q]).astype(np.int64)
    return out


def norms(a: np.ndarray) -> np.ndarray:
    out = np.zeros(len(a), dtype=np.int64)
    weights = plane_weights(a.shape[1])
    for p, w in enumerate(weights):
        for q, v in enumerate(weights):
            out += w * v * np.bitwise_count(a[:, p] & a[:, q]).astype(np.int64)
    return out


def stacked(rows: pd.Series) -> np.ndarray:
    """Planes of a batch as one array: shorter ones repeat their top plane, which is the sign."""
    longest = max(map(len, rows))
    return np.array([np.concatenate([r, np.repeat(r[-1:], longest - len(r))]) if len(r) < longest else r for r in rows], dtype=np.int64).view(np.uint64)


def nearest(planes: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row, of equal ones the first, and its squared distance."""
    held = to_planes(centroids)
    far = norms(planes)[:, None] - 2 * dots(planes, held) + norms(held)[None, :]
    at = far.argmin(axis=1)
    return at.astype(np.int32), far[np.arange(len(far)), at]


def packed(df: DataFrame, scale: int) -> DataFrame:
    """df, which has _id and _v, with _planes in place of _v."""

    @F.pandas_udf("array<long>")
    def planes(vectors: pd.Series) -> pd.Series:
        x = np.stack(list(vectors)).astype(np.int64) if len(vectors) else np.zeros((0, SIZE), np.int64)
        return pd.Series(list(to_planes(x).view(np.int64)))

    return df.withColumn("_planes", planes(whole_numbers(F.col("_v"), scale))).drop("_v")


def moved(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each centroid at the floor of the mean of the rows nearest to it. What is shuffled is one row for each batch and
    centroid, what the driver reads one for each centroid."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                planes = stacked(batch["_planes"])
                at, _ = nearest(planes, centroids)
                x = from_planes(planes)
                found = np.unique(at)
                yield pd.DataFrame({"cluster": found, "n": [int((at == k).sum()) for k in found], "total": [x[at == k].sum(axis=0) for k in found]})

    parts = rows.select("_planes").mapInPandas(sums, "cluster int, n long, total array<long>")
    total = F.array(*(F.sum(F.col("total")[i].cast("decimal(20,0)")) for i in range(SIZE)))
    out = centroids.copy()
    for r in parts.groupBy("cluster").agg(F.sum("n").alias("n"), total.alias("total")).collect():
        out[r["cluster"]] = [int(s) // r["n"] for s in r["total"]]
    return out


def cluster_vectors(df: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 16, rounds: int = 3, scale: int = 64, seed: int = 1, keep: list[str] | None = None) -> DataFrame:
    """The rows of df with 64 finite components, with cluster, distance (squared, to the final centroid), cluster_inertia,
    inertia and centroid (its components).

    Components are floor(scale * x). Left out are rows whose vector is null, has another length, or a component that is
    null, not finite, or beyond 27 bits once scaled, where squared distances would not fit 64 bits. Centroids start as
    the k rows of the smallest sha256 of "seed:id" (fewer where there are fewer rows; rows without an id come last,
    equal ids in order of their components' bits). Ties go to the smaller number; centroids without rows stay. Repeated
    rows count each; an empty table gives no rows. Columns of df named as the results are replaced; keep lists those to
    return. The packed vectors (some 60 bytes a row) are written to the shared folder with what is kept of each row, and
    read once a round; the driver holds k centroids.
    """
    spark = df.sparkSession
    bounded_batches(spark, 10_000)
    results = ["cluster", "distance", "cluster_inertia", "inertia", "centroid"]
    own = F.struct(*others(df, results, keep)).alias("_row")
    kept = df.select(own, F.col(f"`{id_col}`").alias("_id"), F.col(f"`{vector_col}`").alias("_v")).where(usable(F.col("_v"), scale))
    rows = stored(packed(kept, scale))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("_id").cast("string")), 256)
    first = rows.select("_planes", digest.alias("_digest")).orderBy(F.col("_digest").asc_nulls_last(), "_planes").limit(k).collect()
    if not first:
        none = {"cluster": "int", "distance": "long", "cluster_inertia": "long", "inertia": "long", "centroid": "array<long>"}
        return kept.select("_row.*", *(F.lit(None).cast(t).alias(c) for c, t in none.items()))
    centroids = np.concatenate([from_planes(stacked(pd.Series([np.array(r["_planes"])]))) for r in first])
    for _ in range(rounds):
        centroids = moved(rows, centroids)

    @F.pandas_udf("cluster int, distance long")
    def assigned(planes: pd.Series) -> pd.DataFrame:
        at, far = nearest(stacked(planes), centroids) if len(planes) else ([], [])
        return pd.DataFrame({"cluster": at, "distance": far})

    out = stored(rows.select("_row", assigned("_planes").alias("_at")).select("_row", "_at.*"))
    discard(rows)
    sums = {r[0]: r[1] for r in out.groupBy("cluster").agg(F.sum("distance")).collect()}
    # one row for each centroid
    table = spark.createDataFrame([(c, sums.get(c, 0), sum(sums.values()), [int(x) for x in row]) for c, row in enumerate(centroids)], "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return out.join(F.broadcast(table), "cluster").select("_row.*", *results)
