"""Quality rules by a hashed n-gram log-likelihood ratio.

Words and pairs of words are hashed into a fixed number of buckets. Two multinomials over the
buckets are fitted, one to trusted documents and one to the whole corpus; a document's score is the
mean over its n-grams of log p(trusted) - log p(corpus). Documents under a fixed score, and those
that fail the base rules, are rejected. Everything is DataFrame functions.
"""

from __future__ import annotations


import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.text import others, words

#: Buckets of the hash: what is broadcast is one number for each, however large the corpus.
BUCKETS = 10_000
#: Trusted documents that the target is fitted to, at most (those of the smallest ids).
TRUSTED = 20_000
#: Mean log-likelihood ratio, in nats for each n-gram, under which a document is rejected.
LEAST_SCORE = -0.1
#: A token: a run of ASCII punctuation, or of anything else that is not white space.
TOKEN = r"[!-/:-@\[-`{-~]+|[^\x00-\x20!-/:-@\[-`{-~\x7F]+"
SYMBOL = r"[#*$%&|<>]"


def n_grams(tokens: str) -> Column:
    """Buckets of all tokens and of all pairs of neighbours in an array column, which has to be a column of its own."""
    one = F.transform(tokens, lambda t: F.pmod(F.xxhash64(t), F.lit(BUCKETS)))
    two = F.transform(tokens, lambda t, i: F.pmod(F.xxhash64(t, F.get(tokens, i + 1)), F.lit(BUCKETS)))
    return F.concat(one, F.slice(two, F.lit(1), F.greatest(F.size(tokens) - 1, F.lit(0))))


def tokens_of(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))


def fit(docs: DataFrame, trusted: DataFrame, text_col: str = "text", id_col: str = "doc_id", bound: int = TRUSTED) -> np.ndarray:
    """log p(trusted) - log p(corpus) for each bucket, both with one count added.

    docs is counted whole. trusted has the ids of trusted documents, of which the bound smallest are
    used: they are broadcast. The driver gets one row for each bucket. Without any, all are zero.
    """
    ids = trusted.select(F.col(id_col).alias("_id")).where("_id IS NOT NULL").distinct().orderBy("_id").limit(bound)
    rows = docs.select(F.col(id_col).alias("_id"), tokens_of(F.col(text_col)).alias("_tokens"))
    rows = rows.join(F.broadcast(ids.withColumn("_good", F.lit(1))), "_id", "left")
    grams = rows.select(F.coalesce("_good", F.lit(0)).alias("_good"), "_tokens").select("_good", F.explode(n_grams("_tokens")).alias("_bucket"))
    counted = grams.groupBy("_bucket").agg(F.count("*").alias("n"), F.sum("_good").alias("good")).collect()
    n, good = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for bucket, many, trusty in counted:
        n[bucket], good[bucket] = many, trusty
    if good.sum() == 0:
        return np.zeros(BUCKETS)
    return np.log((good + 1) / (good.sum() + BUCKETS)) - np.log((n + 1) / (n.sum() + BUCKETS))


def repeated_words(windows: str, size: int) -> Column:
    """Words in windows that occur twice or more, from the hashes of all windows in order, in a column of its own.

    Where all differ nothing is sorted. Else windows are sorted with their places, those that equal a
    neighbour are put back in order, and each covers its words up to the next one's start.
    """
    pairs = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def places(s: Column) -> Column:
        again = F.transform(s, lambda x, j: F.when((x["h"] == F.get(s, j - 1)["h"]) | (x["h"] == F.get(s, j + 1)["h"]), x["i"]))
        return F.array_sort(F.filter(again, lambda i: i.isNotNull()))

    start = F.struct(F.lit(-(1 << 30)).alias("at"), F.lit(0).cast("long").alias("n"))
    step = lambda a, i: F.struct(i.alias("at"), (a["n"] + F.least(F.lit(size), i - a["at"])).cast("long").alias("n"))
    bound = lambda x, f: F.get(F.transform(F.array(x), f), F.lit(0))  # noqa: E731  x computed once
    many = bound(pairs, lambda s: F.aggregate(places(s), start, step)["n"])
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(many).cast("long")


def base_rules(docs: DataFrame, text_col: str = "text", window: int = 8) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = docs.withColumns({"_words": words(F.col(text_col)), "_lines": lines, "n_symbols": F.regexp_count(text, F.lit(SYMBOL)).cast("long")})
    out = out.withColumns({"n_words": F.size("_words").cast("long"), "word_chars": F.length(F.array_join("_words", "")).cast("long"), "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"), "_hashes": F.transform("_words", lambda w: F.xxhash64(w))})
    last = F.size("_hashes") - window
    spans = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(*(F.get("_hashes", i + k) for k in range(window))))
    out = out.withColumn("_spans", F.when(last >= 0, spans).otherwise(F.array().cast("array<bigint>"))).drop("_words", "_lines", "_hashes")
    out = out.withColumn("n_repeat_words", repeated_words("_spans", window)).drop("_spans")
    return out.withColumn("base_failed", (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30))


RESULTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept"]


def judge(docs: DataFrame, trusted: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least_score: float = LEAST_SCORE, bound: int = TRUSTED, keep: list[str] | None = None) -> DataFrame:
    """docs with the base rules' figures, base_failed, score and kept.

    trusted: ids of trusted documents. Null and empty texts have no words and fail the base rules;
    their score is 0. Texts may be of any length; repeated rows are judged each for itself; without
    trusted documents all scores are 0 and the base rules decide alone; a score at the threshold is
    kept; an empty table stays empty. Columns of docs named as the results are replaced, in any case; keep lists the columns of docs to return.
    """
    weights = fit(docs, trusted, text_col, id_col, bound)
    rows = docs.select(F.struct(*others(docs, RESULTS, keep)).alias("_row"), F.col(text_col).alias("_text"))
    rows = base_rules(rows, "_text").withColumn("_tokens", tokens_of(F.col("_text"))).drop("_text")
    rows = rows.withColumn("_grams", n_grams("_tokens")).drop("_tokens")
    table = F.lit(weights)
    total = F.aggregate("_grams", F.lit(0.0), lambda a, b: a + F.get(table, b.cast("int")))
    score = F.when(F.size("_grams") > 0, total / F.size("_grams")).otherwise(F.lit(0.0))
    rows = rows.withColumn("score", score).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= least_score))
    return rows.select("_row.*", *RESULTS)
