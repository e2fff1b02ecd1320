"""Exact deduplication against a persistent index of digests.

The index is a table of entries, bucketed and sorted by digest: what one batch of documents added for
one text. A new batch is first put together by digest, then anti-joined with the index by a sort-merge
join: only the batch is shuffled, as the index lies in its buckets already. What is left is new and
goes on, and the batch's entries are appended. Everything that is known of a text follows from its
entries, which lie in one bucket.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.shared import discard, shared_dir, stored

#: What does not count when texts are compared: the white space of ASCII.
SPACE = " \t\n\x0b\x0c\r"
#: Copies of one text, as a share of all rows, from which on its group is joined by broadcast: so there are 1,000 such groups at most.
HOT, LEAST_HOT = 0.001, 1000
ENTRY = "digest binary, n_chars long, not_id long, batch string, row long, copies long"


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), SPACE, "")


def digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs as (row, id, digest, n_chars); row tells equal rows apart. Written to the shared folder: texts are read once."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return stored(docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").cast("long").alias("id"),
        F.unhex(F.sha2(normalised(text), 256)).alias("digest"), F.length(text).cast("long").alias("n_chars"),
    ))


class DigestIndex:
    """Digests of all texts added so far, in a folder that all executors share. The number of buckets is fixed when the
    folder is first written; partitions of an anti-join are buckets, so take enough for the index that is to come."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 200):
        self.spark, self.buckets = spark, buckets
        self.name = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(f"CREATE TABLE {self.name} ({ENTRY}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'")

    def entries(self) -> DataFrame:
        return self.spark.table(self.name)

    def add(self, batch: DataFrame, name: str | None = None) -> DataFrame:
        """Append batch, rows as digests() makes them, and return (row, digest) of those that are new and stay: of equal
        new texts the row of the most code points, then of the smallest id (a missing one is the largest), then the first.

        A job that ended halfway hands over its batch again under the same name: it is appended once, and what it adds
        itself is new to it."""
        name = name or uuid.uuid4().hex
        # of equal lengths the largest complement is the smallest id; a missing id comes before all of them
        best = F.max(F.struct("n_chars", F.bitwise_not("id").alias("not_id"), F.bitwise_not("row").alias("not_row")))
        own = batch.groupBy("digest").agg(best.alias("best"), F.count("*").alias("copies"))
        own = stored(own.select("digest", "best.n_chars", "best.not_id", F.lit(name).alias("batch"), F.bitwise_not("best.not_row").alias("row"), "copies"))
        entries = self.entries()
        known = entries.where(F.col("batch") != name).select("digest").hint("merge")
        new = stored(own.join(known, "digest", "left_anti").select("row", "digest"))
        if entries.where(F.col("batch") == name).isEmpty():
            own.repartition(self.buckets, "digest").write.insertInto(self.name)
        discard(own)
        return new

    def groups(self) -> DataFrame:
        """(digest, keep_id, batch, row, group_size) of every text: which row stays of all that were ever added."""
        best = F.max(F.struct("n_chars", "not_id", F.bitwise_not("row").alias("not_row"), "batch")).alias("best")
        out = self.entries().groupBy("digest").agg(best, F.sum("copies").alias("group_size"))
        return out.select("digest", F.bitwise_not("best.not_id").alias("keep_id"), "best.batch", F.bitwise_not("best.not_row").alias("row"), "group_size")


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, buckets: int | None = None, batches: int = 2) -> DataFrame:
    """(id_col, keep_id, group_size, kept, text_sha256) of every row of docs, through an index at path, or a new one.

    Texts are equal when they are so without the white space of ASCII; null counts as empty, and all such texts are
    equal. Of equal texts the row of the most code points stays, then that of the smallest id (a missing id is the
    largest), then one of equal rows; none where the index has a better one from earlier. The rows are added in so many
    batches, dealt by a hash of the row, each deduplicated against those before it. Texts may be of any length; an empty table stays empty; other columns are
    not read. Ids are whole numbers. Groups of a thousandth of all rows or more, at most a thousand of them, are joined by broadcast.
    """
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/digests-{uuid.uuid4().hex}"
    index = DigestIndex(spark, path, buckets or int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows, run = digests(docs, id_col, text_col), uuid.uuid4().hex
    for k in range(batches):
        discard(index.add(rows.where(F.pmod(F.xxhash64("row"), F.lit(batches)) == k), f"{run}-{k}"))
    own = F.when(F.col("batch").startswith(run), F.col("row")).alias("_keep")
    groups = index.groups().select("digest", "keep_id", "group_size", own)
    least = max(LEAST_HOT, int(HOT * rows.count()))
    hot = stored(groups.where(F.col("group_size") >= least))
    few = rows.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(groups.where(F.col("group_size") < least).hint("merge"), "digest")
    out = few.unionByName(rows.join(F.broadcast(hot), "digest"))
    kept = F.coalesce(F.col("row") == F.col("_keep"), F.lit(False))
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
