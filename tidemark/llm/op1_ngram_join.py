"""N-gram Jaccard join: a grouped prefix join.

A document is its set of word shingles. In an order of all shingles, rare ones first, two sets of
the wanted similarity share one of the first `size - need + 1` shingles of both (their prefixes).
Documents of the same prefix and size are one group, so copies cost nothing; groups that share a
prefix shingle are candidates, filtered by size and by the places of the shared shingle, and their
members are verified on their whole texts.

What is asked for are components, so that links inside what is already connected need not be found
again. First each group is paired with one other of its lists (a star), then, some times, each
document with one of another component, and at last all pairs of groups that are not yet in one
component are listed, filtered, and expanded to their members of different components: a family of
near copies never becomes all pairs, and no link between two components is lost. Lists, groups and
documents that have very many partners are split into blocks, each the work of a task of its own.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.text import others
from tidemark.shared import bounded_batches, discard, fixed, stored

SHINGLE = 5
#: Similarity of at least three quarters.
NUM, DEN = 3, 4
#: Counters of the frequency sketch that orders shingles: its size is fixed, so it can be broadcast.
SKETCH_BITS, SLICES = 20, 256
#: Rounds of one candidate for each group, before all remaining pairs are listed.
PARTNER_ROUNDS = 1
#: Rows of a key from which on its pairs are split into blocks of so many.
BLOCK = 1_000
#: Documents to verify up to which their ids are broadcast.
BROADCAST = 1_000_000

_BYTE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = np.random.default_rng(8).integers(1, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_GAP = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_POWERS = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for i, x in enumerate((_BASE, _BACK)):
            p = np.full(max(n, 1 << 17), x, dtype=np.uint64)
            p[0] = 1
            _POWERS[i] = np.cumprod(p)
    return _POWERS[0], _POWERS[1]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None) -> np.ndarray:
    """Hashes of the distinct shingles, sorted. Words come from a polynomial over their bytes, by prefix sums."""
    b = np.frombuffer((text or "").encode().lower(), dtype=np.uint8)  # bytes.lower() changes A-Z only
    if not len(b):
        return np.empty(0, dtype=np.uint64)
    inside = ~_GAP[b]
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    n = len(start)
    if not n:
        return np.empty(0, dtype=np.uint64)
    power, back = _powers(len(b))
    total = np.zeros(len(b) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[b] * power[: len(b)], out=total[1:])
    word = _mixed((total[end] - total[start]) * back[start])
    if n < SHINGLE:
        return _mixed(np.array([(word * _PLACE[:n]).sum(dtype=np.uint64) + np.uint64(n)]))
    out = word[: n - SHINGLE + 1] * _PLACE[0]
    for i in range(1, SHINGLE):
        out = out + word[i : n - SHINGLE + 1 + i] * _PLACE[i]
    return np.unique(_mixed(out))


def prefix_size(n: int) -> int:
    return n - -(-NUM * n // DEN) + 1 if n else 0


def frequency_sketch(docs: DataFrame) -> np.ndarray:
    """How many documents have a shingle of each hash class, over all of docs (_text). One array of
    fixed size for each task, merged slice by slice, and one on the driver."""
    size = (1 << SKETCH_BITS) // SLICES

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(1 << SKETCH_BITS, dtype=np.uint32)
        for batch in batches:
            found = [(shingles(t) & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int64) for t in batch["_text"]]
            if found:
                total += np.bincount(np.concatenate(found), minlength=1 << SKETCH_BITS).astype(np.uint32)
        cut = total.reshape(SLICES, size)
        yield pd.DataFrame({"part": np.arange(SLICES), "counts": [zlib.compress(x.tobytes(), 1) for x in cut]})

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch["part"], batch["counts"], strict=True):
                x = np.frombuffer(zlib.decompress(counts), dtype=np.uint32).astype(np.uint64)
                total[part] = total[part] + x if part in total else x
        yield pd.DataFrame({"part": list(total), "counts": [zlib.compress(x.tobytes(), 1) for x in total.values()]})

    schema = "part int, counts binary"
    merged = docs.select("_text").mapInPandas(count, schema).repartition("part").mapInPandas(merge, schema)
    out = np.zeros((SLICES, size), dtype=np.uint64)
    for part, counts in merged.collect():
        out[part] = np.frombuffer(zlib.decompress(counts), dtype=np.uint64)
    return np.minimum(out.reshape(-1), np.uint64(0xFFFFFFFF)).astype(np.uint32)


def prefixes(docs: DataFrame, sketch: np.ndarray) -> DataFrame:
    """(_id, _hash, _n, _set, _group, _prefix) for each row of docs (_id, _hash, _text): size, digest of
    the set, hash of prefix and size, and the prefix, rare shingles first."""
    held = docs.sparkSession.sparkContext.broadcast(sketch)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        often = held.value
        for batch in batches:
            n, digest, group, prefix = [], [], [], []
            for text in batch["_text"]:
                s = shingles(text)
                order = np.lexsort((s, often[(s & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int64)]))
                p = s[order[: prefix_size(len(s))]]
                n.append(len(s))
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                group.append(int.from_bytes(hashlib.blake2b(p.tobytes() + len(s).to_bytes(8, "little"), digest_size=8).digest(), "little", signed=True))
                prefix.append(p.view(np.int64))
            yield pd.DataFrame({"_id": batch["_id"], "_hash": batch["_hash"], "_n": n, "_set": digest, "_group": group, "_prefix": prefix})

    return docs.mapInPandas(cut, "_id long, _hash long, _n long, _set binary, _group long, _prefix array<long>")


def in_blocks(counts: DataFrame, key: list[str]) -> DataFrame:
    """(key, _blocks) of the keys that are split, from (key, _many)."""
    return counts.where(F.col("_many") > BLOCK).select(*key, F.ceil(F.col("_many") / BLOCK).cast("int").alias("_blocks"))


def paired(left: DataFrame, right: DataFrame, key: list[str], counts: DataFrame) -> DataFrame:
    """left joined with right on key. counts: (key, _many), how many rows of left a key has. A row of
    left goes to one block of its key, a row of right to all of them."""
    split = in_blocks(counts, key)
    block = F.pmod(F.xxhash64(*left.columns), F.coalesce("_blocks", F.lit(1))).cast("int")
    each = F.explode(F.sequence(F.lit(0), F.coalesce("_blocks", F.lit(1)) - 1))
    left = left.join(split, key, "left").withColumn("_block", block).drop("_blocks")
    right = right.join(split, key, "left").withColumn("_block", each).drop("_blocks")
    return left.join(right, [*key, "_block"])


def verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Of pairs (a, b) of ids, those whose texts are similar enough. Each pair is checked on the whole
    sets; rows that share an id are one document. Of the two the id with more pairs takes the other's
    text to its own, in blocks, so that its own text is sent once a block and not once a pair."""
    ids = stored(pairs.select(F.explode(F.array("a", "b")).alias("_id")).groupBy("_id").agg(F.count("*").alias("_many")))
    few = ids.count() <= BROADCAST
    wanted = ids.select("_id")
    texts = docs.join(F.broadcast(wanted), "_id", "left_semi") if few else stored(docs.join(wanted, "_id", "left_semi"))
    hot = in_blocks(ids, ["_id"])
    for x in "ab":
        pairs = pairs.join(hot.select(F.col("_id").alias(x), F.col("_blocks").alias(f"_{x}")), x, "left")
    mine, other = F.coalesce("_a", F.lit(1)), F.coalesce("_b", F.lit(1))
    turned = [F.when(mine > other, F.col(x)).otherwise(F.col(y)).alias(y) for x, y in ("ba", "ab")]
    pairs = pairs.select(*turned, F.greatest(mine, other).alias("n"))
    pairs = pairs.select("a", "b", F.pmod(F.xxhash64("a"), F.col("n")).cast("int").alias("_block"))
    held = texts.select(F.col("_id").alias("b"), F.col("_text").alias("_right")).join(hot.withColumnRenamed("_id", "b"), "b", "left")
    held = held.select("b", "_right", F.explode(F.sequence(F.lit(0), F.coalesce("_blocks", F.lit(1)) - 1)).alias("_block"))
    both = pairs.join(texts.select(F.col("_id").alias("a"), F.col("_text").alias("_left")), "a").join(held, ["b", "_block"])
    both = both.select("a", "b", "_left", "_right")

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[int, np.ndarray] = {}
        for batch in batches:
            right = []
            for b, left, text in zip(batch["b"], batch["_left"], batch["_right"], strict=True):
                x, y = shingles(left), seen.get((b, text))
                if y is None:
                    seen = {(b, text): (y := shingles(text))}
                both = len(np.intersect1d(x, y, assume_unique=True))
                right.append(DEN * both >= NUM * (len(x) + len(y) - both) > 0)
            yield batch.loc[right, ["a", "b"]]

    return ordered_pairs(both.mapInPandas(check, "a long, b long"))


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable, for every node with an edge (a, b). Large-star and
    small-star steps, until every node has one edge to a root; each round is written to the shared folder."""

    def star(rows: DataFrame, ahead: bool) -> DataFrame:
        """rows (u, v): v's under the least of u and its v's. ahead: only v > u move, else u too."""
        least = rows.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m")).select("w", F.least("w", "m").alias("m"))
        joined = rows.join(least, rows["u"] == least["w"])
        if ahead:
            return joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        moved = joined.select(F.explode(F.array(F.struct(F.col("v").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b")))).alias("e"))
        return moved.select("e.a", "e.b").where("a != b")

    now = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    while True:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = star(both, True).where("a != b").distinct()
        now = fixed(star(large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), False).distinct())
        ends = now.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(now.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        ends = ends.groupBy("node").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
        if not ends.where("up > 1 OR (up > 0 AND down > 0)").limit(1).count():
            break
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(roots)


def shared_prefixes(filled: DataFrame) -> DataFrame:
    """(token, _group, at, pivot): places of prefix shingles that two groups or more have; pivot is the
    least of them. Groups are exploded and not documents: copies and documents of one prefix are one."""
    groups = filled.select("_group", "_prefix").dropDuplicates(["_group"])
    tokens = groups.select("_group", F.posexplode("_prefix").alias("at", "token")).repartition("token")
    # the condition on the places is always met: all columns are used, so both sides read one exchange
    ends = tokens.groupBy("token").agg(F.min("_group").alias("pivot"), F.max("_group").alias("last"), F.max("at").alias("deep"))
    return tokens.join(ends.where("pivot != last AND deep >= 0").select("token", "pivot"), "token")


def ordered_pairs(df: DataFrame) -> DataFrame:
    return df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct()


def sizes_fit(n: str, m: str) -> Column:
    return F.least(n, m) * DEN >= F.greatest(n, m) * NUM


def labelled(nodes: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, _group, label) of all nodes, and the groups: (_group, _n, lo, hi, _many) with the least and
    largest component of the members and how many there are."""
    named = nodes.join(labels, "node", "left").select("node", "_group", "_n", F.coalesce("label", "node").alias("label"))
    groups = named.groupBy("_group").agg(F.first("_n").alias("_n"), F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("_many"))
    return named.drop("_n"), groups


def mixed_lists(shared: DataFrame, groups: DataFrame) -> DataFrame:
    """(token, _group, at, _n, lo, hi, _many) of the tokens whose groups are not all in one component, stored."""
    lists = shared.select("token", "_group", "at").join(groups.drop("_many"), "_group")
    mixed = lists.groupBy("token").agg(F.min("lo").alias("x"), F.max("hi").alias("y"), F.count("*").alias("_many")).where("x != y")
    return stored(lists.join(mixed.select("token", "_many"), "token"))


def one_partner_each(shared: DataFrame, named: DataFrame, groups: DataFrame) -> DataFrame:
    """A candidate for each document: of the first documents of the components in one of its group's
    lists the least, or the greatest where the least is of its own component; of several lists the
    least, so that a family gathers around few documents. Chosen once for all members of a group that
    are of one component, then expanded to them. A group of several components is a list too."""
    parts = named.join(groups.select("_group", "_n", "lo", "hi"), "_group").groupBy("_group", "label").agg(F.min("node").alias("rep"), F.first("_n").alias("_n"), F.first(F.col("lo") < F.col("hi")).alias("mixed"))
    lists = shared.select("token", "_group").join(parts, "_group").select("token", "_group", "label", "rep", "_n")
    lists = lists.unionByName(parts.where("mixed").select(F.col("_group").alias("token"), "_group", "label", "rep", "_n"))
    firsts = lists.groupBy("token", "label").agg(F.min(F.struct("rep", "_n")).alias("f"))
    ends = firsts.groupBy("token").agg(F.min(F.struct("f", "label")).alias("x"), F.max(F.struct("f", "label")).alias("y")).where("x.label != y.label")
    rows = lists.join(ends, "token").withColumn("p", F.when(F.col("label") != F.col("x.label"), F.col("x.f")).otherwise(F.col("y.f")))
    chosen = rows.where(sizes_fit("_n", "p._n")).groupBy("_group", "label").agg(F.min("p.rep").alias("b"))
    return ordered_pairs(named.join(chosen, ["_group", "label"]).select(F.col("node").alias("a"), "b"))


def group_pairs(lists: DataFrame) -> DataFrame:
    """(g, h): pairs of groups that share a prefix shingle and are not in one component, filtered by
    size and by what the places of the shingle leave possible."""
    left, right = (lists.select("token", *(F.col(c).alias(f"{c}_{x}") for c in ("_group", "lo", "hi", "_n", "at"))) for x in "ab")
    # the overlap that is still possible if this is the first shared shingle, against the one needed
    most = F.least(F.col("_n_a") - F.col("at_a"), F.col("_n_b") - F.col("at_b"))
    fits = (most * (NUM + DEN) >= (F.col("_n_a") + F.col("_n_b")) * NUM) & sizes_fit("_n_a", "_n_b")
    apart = (F.least("lo_a", "lo_b") < F.greatest("hi_a", "hi_b")) & (F.col("_group_a") < F.col("_group_b"))
    counts = lists.select("token", "_many").distinct()
    return paired(left, right, ["token"], counts).where(apart & fits).select(F.col("_group_a").alias("g"), F.col("_group_b").alias("h")).distinct()


def expanded(pairs: DataFrame, named: DataFrame, groups: DataFrame) -> DataFrame:
    """Members (a, b) of pairs (g, h) of groups, and of each group itself, that are in different components."""
    inside = groups.where("lo < hi").select(F.col("_group").alias("g"), F.col("_group").alias("h"))
    pairs = pairs.unionByName(inside)
    left = pairs.join(named.select(F.col("_group").alias("g"), F.col("node").alias("a"), F.col("label").alias("x")), "g")
    right = pairs.join(named.select(F.col("_group").alias("h"), F.col("node").alias("b"), F.col("label").alias("y")), "h")
    counts = pairs.join(groups.select(F.col("_group").alias("g"), "_many"), "g")
    return ordered_pairs(paired(left, right, ["g", "h"], counts).where("x != y").select("a", "b"))


RESULTS = ["n_shingles", "component_id"]


def similar_components(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """df with n_shingles and component_id, the smallest id reachable by links (Jaccard of shingle sets
    of 0.75 or more), the row's own included.

    Null texts and texts without words have no shingles and are linked with nothing; texts of fewer
    than five words are one shingle. Texts may be of any length. Rows that share an id are one
    document, which has the links of all its texts. A row without an id gets the component of a row of
    the same shingles that has one, else null, and links nothing else. An empty table stays empty.
    Ids are whole numbers, or texts of such. Columns of df named as the results are replaced, in any
    case of letters; others may have any names; keep lists the columns of df to return.
    """
    alone = (keep or df.columns) == [id_col]
    bounded_batches(df.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = df.select(F.col(id_col).cast("long").alias("_id"), text.alias("_text"), F.xxhash64(text).alias("_hash"))
    texts = docs.select("_id", "_text")
    base = stored(prefixes(docs, frequency_sketch(docs)))
    filled = base.where("_id IS NOT NULL AND _n > 0")
    nodes = stored(filled.groupBy("_set").agg(F.min("_id").alias("node"), F.first("_group").alias("_group"), F.first("_n").alias("_n")))
    reps = nodes.groupBy("_group").agg(F.min("node").alias("rep"), F.first("_n").alias("_n"))

    # an id with several sets joins their nodes
    of = filled.select("_id", "_set").join(nodes.select("_set", "node"), "_set").select("_id", "node")
    several = of.groupBy("_id").agg(F.min("node").alias("x"), F.max("node").alias("y")).where("x != y").select("_id")
    edges = of.join(several, "_id").select(F.col("_id").alias("a"), F.col("node").alias("b")).distinct()

    # a star: each group against the least pivot of its prefix shingles, each node against its group's first
    shared = stored(shared_prefixes(filled))
    stars = shared.where("_group != pivot").groupBy("_group").agg(F.min("pivot").alias("pivot"))
    other = reps.select(F.col("_group").alias("pivot"), F.col("rep").alias("b"), F.col("_n").alias("m"))
    stars = stars.join(reps, "_group").join(other, "pivot").where(sizes_fit("_n", "m")).select(F.col("rep").alias("a"), "b")
    inside = nodes.join(reps.select("_group", "rep"), "_group").where("node != rep").select(F.col("node").alias("a"), F.col("rep").alias("b"))
    done = stored(ordered_pairs(stars.unionByName(inside)))
    edges = stored(verified(done, texts).unionByName(edges))
    labels = stored(components(edges))
    # then one partner in another component for each group, some times over, and at last all that is left
    for last in (*[False] * PARTNER_ROUNDS, True):
        named, groups = map(stored, labelled(nodes, labels))
        if last:
            lists = mixed_lists(shared, groups)
            found = stored(group_pairs(lists))
            discard(lists)
            pairs = expanded(found, named, groups)
        else:
            pairs = one_partner_each(shared, named, groups)
        pairs = stored(pairs.join(done, ["a", "b"], "left_anti"))
        discard(named, groups)
        more = stored(verified(pairs, texts))
        done = done.unionByName(pairs)
        if more.limit(1).count():
            edges = edges.unionByName(more)
            labels = stored(components(edges))
    discard(shared, found)

    ids = nodes.select("_set", "node").join(labels, "node", "left").select(F.col("_set").alias("_of"), F.coalesce("label", "node").alias("_label"))
    named = base.select("_id", "_hash", "_n", "_set").join(ids, F.col("_set") == F.col("_of"), "left")
    result = named.select("_id", "_hash", F.col("_n").alias("n_shingles"), F.coalesce("_label", "_id").alias("component_id"))
    if alone:  # nothing to carry along, so the rows are already there
        return result.select(F.col("_id").cast(df.schema[id_col].dataType).alias(id_col), *RESULTS)
    rows = df.select(F.struct(*others(df, RESULTS, keep)).alias("_row"), F.col(id_col).cast("long").alias("_of"), F.xxhash64(text).alias("_digest"))
    result = result.distinct()
    return rows.join(result, rows["_of"].eqNullSafe(result["_id"]) & (rows["_digest"] == result["_hash"])).select("_row.*", *RESULTS)
