"""Benchmark decontamination by winnowing.

Of every `w` neighbouring hashes of `k` words a text keeps the smallest. A span of `k + w - 1` words
has such a group, and two equal spans keep the same hash at the same place, so every shared span of
that length is found by an equi-join of the kept hashes; each hit is then extended to both sides,
word by word. Places of the benchmark with one hash among the same words are one context, which is joined
and extended once, whatever items it stands in. Everything is DataFrame functions.

Benchmark items shorter than a window are one window. They have winnowings of their own: a smaller `w`,
and where they have fewer than `k` words all their own hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.text import others
from tidemark.shared import stored

K = 5
#: What parts words, once A-Z are in lower case: ASCII other than letters and digits.
PARTS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of a segment: a longer text is cut into segments that overlap by a window.
SEGMENT_BITS = 20
#: Contexts of the benchmark up to which it is broadcast (each with 21 words' hashes, 250 bytes or so).
BROADCAST = 50_000


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), PARTS), "")


def segments(df: DataFrame, text_col: str, window: int) -> DataFrame:
    """df with _w, hashes of the words of a segment, and _from, the segment's first word; _n words in all."""
    size = 1 << SEGMENT_BITS
    out = df.withColumn("_words", words_of(F.col(text_col))).drop(text_col)
    out = out.withColumn("_all", F.transform("_words", lambda x: F.xxhash64(x))).withColumn("_n", F.size("_words")).drop("_words")
    cut = F.transform(F.sequence(F.lit(0), F.greatest(F.col("_n") - window, F.lit(0)), F.lit(size)), lambda i: F.struct(i.alias("from"), F.slice("_all", i + 1, F.lit(size + window - 1)).alias("w")))
    whole = F.array(F.struct(F.lit(0).alias("from"), F.col("_all").alias("w")))
    out = out.withColumn("_cut", F.explode(F.when(F.col("_n") > size, cut).otherwise(whole))).drop("_all")
    return out.select("*", F.col("_cut.from").alias("_from"), F.col("_cut.w").alias("_w")).drop("_cut")


def least_of(had: int, wide: int) -> Column:
    """Least of every wide neighbours in _kept, which holds the least of every had; wide is 3 * had at most."""
    at = sorted({0, (wide - had) // 2, wide - had}) if wide > 2 * had else [0, wide - had]
    places = F.sequence(F.lit(0), F.size("_kept") - (wide - had) - 1)
    return F.transform(places, lambda i: F.least(*(F.get("_kept", i + a) for a in at)))


def winnowed(df: DataFrame, k: int, w: int) -> DataFrame:
    """df, which has _w, with _kept: of every w neighbouring hashes of k words the smallest, with its
    place in the low bits (ties: the first), each once."""
    mask = (1 << SEGMENT_BITS + 1) - 1
    top = F.size("_w") - k
    grams = F.transform(F.sequence(F.lit(0), top), lambda i: F.xxhash64(*(F.get("_w", i + j) for j in range(k))).bitwiseAND(F.lit(~mask)).bitwiseOR(i.cast("long")))
    none = F.array().cast("array<bigint>")
    df = df.withColumn("_kept", F.when(F.size("_w") >= k + w - 1, grams).otherwise(none))
    had = 1
    while had < w:
        wide = min(3 * had, w)
        df = df.withColumn("_kept", F.when(F.size("_kept") > wide - had, least_of(had, wide)).otherwise(none))
        had = wide
    return df


def exploded(df: DataFrame) -> DataFrame:
    """A row for each kept hash: _hash, without the place, and _at, the place. (Exploding a plain column
    would infer a filter on it, which is pushed down with all of the column's expression in it.)"""
    mask = (1 << SEGMENT_BITS + 1) - 1
    out = df.withColumn("_one", F.explode(F.array_distinct("_kept"))).drop("_kept")
    return out.withColumns({"_hash": F.col("_one").bitwiseAND(F.lit(~mask)), "_at": F.col("_one").bitwiseAND(F.lit(mask)).cast("int")}).drop("_one")


def around(back: int, ahead: int, prefix: str) -> dict[str, Column]:
    """The hashes before a place, nearest first, and those from it on."""
    first = F.greatest(F.col("_at") - back, F.lit(0))
    return {f"{prefix}back": F.reverse(F.slice("_w", first + 1, F.col("_at") - first)), f"{prefix}on": F.slice("_w", F.col("_at") + 1, F.lit(ahead))}


def run(a: str, b: str) -> Column:
    """How many neighbours from the start are equal in two arrays."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    stop = F.array_position(same, False)
    return F.when(stop == 0, F.size(same)).otherwise(stop - 1).cast("int")


def hits(docs: DataFrame, items: DataFrame, key: list[str], window: int) -> tuple[DataFrame, DataFrame]:
    """(key, _context, _start, _end): runs of document words, of a window or more, that items have too, and
    (_context, _item), which they are.

    docs has key and _text; items has _item and _text.
    """
    bench = stored(segments(items, "_text", window).where("_n > 0"))
    lengths = [r[0] for r in bench.select(F.least("_n", F.lit(window)).alias("n")).distinct().collect()]
    found = held = None
    # items of a whole window keep the widest winnowing, whatever shorter items there are
    short = [n for n in lengths if K <= n < window]
    plans = [(K, window - K + 1, [window])] if window in lengths and window >= K else []
    plans += [(K, min(short) - K + 1, short)] if short else []
    plans += [(n, 1, [n]) for n in lengths if n < K]
    cut = segments(docs, "_text", window)
    for at, (k, w, own) in enumerate(plans):
        fingers = None
        for n in own:
            part = winnowed(bench.where(F.least("_n", F.lit(window)) == n), k, n - k + 1)
            part = exploded(part).select("_item", "_hash", F.lit(n).alias("_long"), F.struct(*(c.alias(x) for x, c in around(n - k, n, "").items())).alias("_i"))
            fingers = part if fingers is None else fingers.unionByName(part)
        fingers = fingers.groupBy("_hash", "_long", "_i").agg(F.collect_set("_item").alias("_items"))
        fingers = stored(fingers.withColumn("_context", F.monotonically_increasing_id() * 8 + at))
        names = fingers.select("_context", F.explode("_items").alias("_item"))
        held = names if held is None else held.unionByName(names)
        fingers = fingers.drop("_items")
        most = max(own)
        rows = exploded(winnowed(cut.select(*key, "_from", "_w"), k, w))
        if fingers.count() <= BROADCAST:
            near = rows.join(F.broadcast(fingers), "_hash").withColumns(around(most - k, most, "_d")).drop("_w")
        else:
            near = rows.withColumns(around(most - k, most, "_d")).drop("_w").join(fingers, "_hash")
        # an exploded filter and not where(): a condition would go into the join, which then copies _w for every kept hash
        span = F.struct((F.col("_from") + F.col("_at") - F.col("_left")).alias("start"), (F.col("_from") + F.col("_at") + F.col("_right")).alias("end"))
        near = near.withColumns({"_left": run("_dback", "_i.back"), "_right": run("_don", "_i.on")})
        near = near.select(*key, "_context", F.explode(F.filter(F.array(span), lambda s: s["end"] - s["start"] >= F.col("_long"))).alias("_span"))
        near = near.select(*key, "_context", F.col("_span.start").alias("_start"), F.col("_span.end").alias("_end"))
        found = near if found is None else found.unionByName(near)
    if found is None:
        none = docs.select(*key, F.lit(0).cast("long").alias("_context"), F.lit("").alias("_item"), F.lit(0).alias("_start"), F.lit(0).alias("_end")).limit(0)
        return none.drop("_item"), none.select("_context", "_item")
    return found, held


RESULTS = ["n_words", "n_hit", "n_items", "items", "contaminated"]


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 13, keep: list[str] | None = None) -> DataFrame:
    """docs with n_words, n_hit (words inside occurring windows), n_items, items (ids as sorted strings)
    and contaminated (n_hit > 0 and 20 * n_hit >= n_words).

    Null and empty texts have no words and no hits; null items and those without words or without an
    id are no items; rows of one item id count once in n_items; texts may be of any length; repeated
    rows get the same result each; an empty benchmark or table gives no hits or no rows. Columns of
    docs named as the results are replaced, in any case of letters; keep lists the columns of docs to return. Documents are
    joined with their hits by id and a hash of the text.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    id_key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    rows = docs.select(id_key.alias("_id"), F.xxhash64(text).alias("_digest"), text.alias("_text"))
    items = benchmark.where(F.col(item_col).isNotNull()).select(F.col(item_col).cast("string").alias("_item"), F.col(item_text_col).alias("_text")).where("_text IS NOT NULL")
    found, held = hits(rows, items, ["_id", "_digest"], window)
    # intervals of one document: sorted by start, each adds what lies beyond the end so far
    spans = stored(found.groupBy("_id", "_digest").agg(F.array_sort(F.collect_set(F.struct("_start", "_end"))).alias("_spans"), F.collect_set("_context").alias("_contexts")))
    named = spans.select("_id", "_digest", F.explode("_contexts").alias("_context")).join(held, "_context")
    named = named.groupBy("_id", "_digest").agg(F.array_sort(F.collect_set("_item")).alias("items"))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    grown = F.aggregate("_spans", start, lambda a, s: F.struct(F.greatest(a["end"], s["_end"]).alias("end"), (a["n"] + F.greatest(s["_end"] - F.greatest(s["_start"], a["end"]), F.lit(0))).alias("n")))
    spans = spans.join(named, ["_id", "_digest"]).select("_id", "_digest", grown["n"].alias("_hit"), "items").withColumnsRenamed({"_id": "_i", "_digest": "_d"})
    count = F.regexp_count(text, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")).cast("long")
    out = docs.select(F.struct(*others(docs, RESULTS, keep)).alias("_row"), id_key.alias("_id"), F.xxhash64(text).alias("_digest"), count.alias("n_words"))
    out = out.join(spans, (out["_id"] == spans["_i"]) & (out["_digest"] == spans["_d"]), "left")
    out = out.withColumns({"n_hit": F.coalesce("_hit", F.lit(0)).cast("long"), "items": F.coalesce("items", F.array().cast("array<string>"))})
    dirty = (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))
    return out.select("_row.*", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", dirty.alias("contaminated"))
