"""A training corpus from raw documents: quality rules, near duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's docs. All but the last return the columns of docs: a row goes through an
operator as one struct, so that columns may have any names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.op1_ngram_join import similar_components
from tidemark.llm.op3_quality import judge
from tidemark.llm.op6_mixing import mix_sources
from tidemark.llm.op8_decontamination import decontaminate
from tidemark.llm.op9_sharding import shard_rows
from tidemark.llm.text import n_words, quoted, rows_where
from tidemark.shared import shared_dir, stored

#: Rows to leave out up to which their ids are broadcast.
BROADCAST = 1_000_000


def carried(docs: DataFrame, *columns: Column) -> DataFrame:
    """The rows of docs as one struct, doc, beside the columns that an operator reads."""
    return docs.select(F.struct(*(F.col(quoted(c)) for c in docs.columns)).alias("doc"), *columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Trusted are those that labels call good and not toxic.

    Null and empty texts have no words and go; texts may be of any length; repeated rows are judged
    each for itself; rows without an id are never trusted; ties at the threshold stay; an empty table
    stays empty, and without labels the base rules decide alone. Columns may have any names.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    trusted = labels.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic")).where("quality = 1 AND coalesce(toxic, 0) = 0")
    judged = judge(carried(docs, F.col("doc_id"), F.col("text")), trusted, keep=["doc"])
    return rows_where(judged, "kept", ["doc"]).select("doc.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near duplicates, that of the smallest id.

    Rows of one id are one document, of which one row stays (that of the least hash of the text, of
    equal ones any). Rows without an id are documents by their text, equal texts one, and come before
    all others in a component. Texts without words are near nothing, so one row of each id stays, and
    of those without an id one row of each text. Texts may be of any length; an empty table stays
    empty. Columns may have any names.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    by_text = F.xxhash64(text).bitwiseOR(F.lit(-(1 << 63)))
    own, digest = F.coalesce(F.col("doc_id").cast("long"), by_text).alias("own"), F.xxhash64(text).alias("digest")
    found = similar_components(docs.select(own, text.alias("text")), id_col="own", keep=["own"])
    found = found.groupBy("own").agg(F.min("component_id").alias("component"))
    named = stored(docs.select(own, digest).groupBy("own", "digest").agg(F.count("*").alias("many")).join(found, "own"))
    first = named.groupBy("component").agg(F.min(F.struct("own", "digest")).alias("first"))
    copies = stored(named.join(first, "component").where(F.struct("own", "digest") != F.col("first")).select("own", "digest"))
    rows = carried(docs, own, digest).join(F.broadcast(copies) if copies.count() <= BROADCAST else copies, ["own", "digest"], "left_anti")
    # equal rows of what stays are told apart by nothing: one of each
    repeated = stored(named.where("many > 1").select("own", "digest").join(copies, ["own", "digest"], "left_anti"))
    if many := repeated.count():
        repeated = F.broadcast(repeated) if many <= BROADCAST else repeated
        one = rows.join(repeated, ["own", "digest"], "left_semi").dropDuplicates(["own", "digest"])
        rows = rows.join(repeated, ["own", "digest"], "left_anti").unionByName(one)
    return rows.select("doc.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which under a twentieth is in windows of the benchmark.

    Null and empty texts have no words and stay; texts may be of any length; repeated rows, also of
    one id, are judged each for itself; a share of exactly a twentieth goes; an empty table stays
    empty, and without a benchmark all rows stay. Columns may have any names.
    """
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    out = decontaminate(carried(docs, F.col("doc_id"), F.col("text")), bench, keep=["doc"])
    return out.where("NOT contaminated").select("doc.*")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice.

    Null and empty texts have no words and are never taken, so a source of such texts, and a table of
    them, gives no rows. Texts may be of any length; a null source is a source of its own; rows of one
    id and size are drawn in any order, repeated rows each for itself; an empty table stays empty.
    Columns may have any names.
    """
    rows = carried(docs, F.col("doc_id").alias("own"), F.col("source").alias("queue"), n_words(F.col("text")).alias("words"))
    mixed = mix_sources(rows, id_col="own", source_col="queue", size_col="words").where("taken > 0")
    times = F.sequence(F.lit(1), (F.col("taken") / F.col("size")).cast("int"))
    return mixed.select("doc", F.explode(times)).select("doc.*")


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with shard and slot: 8 shards in uniformly shuffled order, whose sizes differ by one at most.

    All rows stay: nulls, empty and very long texts, ties and repeated rows are rows like any other; an
    empty table stays empty. Columns named shard or slot are replaced, others may have any names.
    """
    return shard_rows(docs, 8)


STAGES = [
    ("quality rules", quality),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: SQL can say neither the hashed likelihoods nor the random permutation. tests/llm holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{i}")
        docs = spark.read.parquet(f"{base}/{i}")
    return docs
