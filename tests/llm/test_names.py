"""Columns named as results in other letters, and names with dots, spaces and backticks, in every operator and stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import op1_ngram_join, op2_tokens, op3_quality, op4_html, op5_urls, op6_mixing, op8_decontamination, op9_sharding, op12_bitplanes

ODD = ["a.b", "c d", "e`f"]


def table(spark, results):
    """Rows with all that operators read, columns named as results in capitals, and odd names."""
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(i, None if i == 3 else f"{text} x{i} " + " ".join(f"y{i * k}" for k in range(30)), f"s{i % 2}") for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return df.select("*", *(F.lit("clash").alias(c.upper()) for c in results if c not in ("text",)), *(F.lit(1).alias(c) for c in ODD))


def bpe():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def trusted(df):
    return df.select("doc_id").limit(2)


OPERATORS = {
    "op1": (["n_shingles", "component_id"], lambda df: op1_ngram_join.similar_components(df)),
    "op2": (["n_bytes", "n_tokens", "over_limit"], lambda df: op2_tokens.count_tokens(df, bpe())),
    "op3": (op3_quality.RESULTS, lambda df: op3_quality.judge(df, trusted(df))),
    "op4": (["text", "n_chars"], lambda df: op4_html.extract_text(df.withColumnsRenamed({"text": "html"}).withColumn("Text", F.lit("clash")))),
    "op5": (["url_host", "n_active", "blocked", "matched", "category"], lambda df: op5_urls.filter_urls(df.withColumns({"url": F.lit("http://a.com/x"), "fetched_at": F.lit("2024-01-01").cast("date")}), df.sparkSession.createDataFrame([("a.com", "spam", "2023-01-01", True)], "pattern string, category string, listed_at string, listed boolean").withColumn("listed_at", F.col("listed_at").cast("date")))),
    "op6": (["size", "source_size", "target", "taken"], lambda df: op6_mixing.mix_sources(df)),
    "op8": (op8_decontamination.RESULTS, lambda df: op8_decontamination.decontaminate(df, df.select(F.col("doc_id").alias("item_id"), "text").limit(2))),
    "op9": (["shard", "slot"], lambda df: op9_sharding.shard_rows(df, 2)),
    "op12": (["cluster", "distance", "cluster_inertia", "inertia", "centroid"], lambda df: op12_bitplanes.cluster_vectors(df.withColumns({"vec_id": F.col("doc_id"), "embedding": F.array_repeat(F.col("doc_id") / 10.0, 64)}))),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operator(spark, name):
    results, run = OPERATORS[name]
    out = run(table(spark, results))
    assert [c for c in out.columns if c.lower() in results] == results
    assert len({c.lower() for c in out.columns}) == len(out.columns) and set(ODD) <= set(out.columns)
    rows = out.collect()
    assert len(rows) == 6 and all(r["a.b"] == 1 and "clash" not in tuple(r) for r in rows)


@pytest.mark.parametrize("k", range(5))
def test_stage(spark, tmp_path, k):
    name, stage = corpus_pipeline.STAGES[k]
    docs = table(spark, ["n_words", "kept", "score", "component_id", "n_hit", "size", "taken", "slot", "_digest"])
    spark.createDataFrame([(0, 1, 0), (1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, "none of it")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = stage(spark, docs, str(tmp_path))
    want = [c for c in docs.columns if c != "SLOT"] + ["shard", "slot"] if name == "sharding" else docs.columns
    assert out.columns == want
    rows = out.collect()
    assert len(rows) >= 5 or not k  # so few rows tell the quality rules nothing
