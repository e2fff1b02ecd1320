"""Hard negatives from a packed R-tree.

The tree is packed by sort-tile-recursive: Spark's range partitioning by label and the first coordinate
makes the slabs, and each task tiles its slab by one coordinate after the other down to leaves. A node's
box holds the least and largest value of each coordinate, so the inner product of an anchor with any
row in it lies between two sums over coordinates. A queue takes the box of the largest upper sum first
and drops boxes whose sums lie outside the window of scores that is asked for, or below the k-th score
found so far; a box that can still tie it stays.

Anchors go through the tree three times: through the slab they stand in, which gives each a first k-th
score; through all other slabs, for their positives; and through all slabs for the negatives in the
windows that the positives set. A task holds one slab, of bounded size, while anchors stream past it.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.shared import bounded_batches, discard, stored

#: Rows of a leaf, children of a node, and rows of a slab, which one task holds (64 coordinates: some 50 MB).
LEAF, FANOUT, SLAB = 128, 8, 100_000
#: A row's place in its slab is its leaf's number and its place there, in so many low bits.
PLACE_BITS = 20
#: Anchors that a task takes through its slab at once.
BLOCK = 512
FAR = 1 << 62
#: Windows compare scores times 95 in 64 bits.
MOST_SCORE = 1 << 56
#: One schema for leaves (kind 0: ids, labels and vectors of its rows in turn, box, which rows are anchors) and anchors
#: (kind 1: home slab and place there as ids, label, vector, least and largest score of each window).
PARTS = "slab int, kind int, at long, ids array<long>, labels array<long>, x array<int>, low array<long>, high array<long>, anchors array<int>"


class Slab:
    """The packed tree over the leaves of one slab: of each level the boxes, whose children are neighbours."""

    def __init__(self, leaves: list[tuple]):
        at, self.ids, self.labels, x, low, high = zip(*leaves, strict=True)
        low, high = np.stack(low), np.stack(high)
        self.x = [v.reshape(len(i), low.shape[1]) for v, i in zip(x, self.ids, strict=True)]
        self.place = [(k << PLACE_BITS) + np.arange(len(i)) for k, i in zip(at, self.ids, strict=True)]
        first, last = np.array([k.min() for k in self.labels]), np.array([k.max() for k in self.labels])
        self.levels = [(low, high, first, last)]
        while len(self.levels[-1][0]) > 1:
            cut = np.arange(0, len(self.levels[-1][0]), FANOUT)
            self.levels.append(tuple(f.reduceat(a, cut, axis=0) for f, a in zip((np.minimum, np.maximum) * 2, self.levels[-1], strict=True)))
        self.most = int(max(np.abs(low).max(initial=0), np.abs(high).max(initial=0)))

    def search(self, a: np.ndarray, labels: np.ndarray, own: np.ndarray, low: np.ndarray, high: np.ndarray, want: int, same: bool):
        """(anchor, window, score, id, place) of the first want rows, by score and then id, of each window low to high
        of each anchor, among rows of its label (same) or of others. own is the anchor's place in this slab or -1."""
        exact = a.shape[1] * self.most * int(np.abs(a).max(initial=0)) < 1 << 53
        kind = np.float64 if exact else np.int64  # sums of doubles are whole numbers too below 2^53
        a = a.astype(kind)
        plus, minus = np.maximum(a, 0), np.minimum(a, 0)
        n, windows = low.shape
        kth, found = low.copy(), Found(n, windows, want)

        def push(level: int, at: np.ndarray, active: np.ndarray) -> None:
            """Boxes of a level into the queue, each with the anchors that it may serve."""
            lows, highs, first, last = (part[at] for part in self.levels[level])
            up = plus[active] @ highs.T.astype(kind) + minus[active] @ lows.T.astype(kind)
            down = plus[active] @ lows.T.astype(kind) + minus[active] @ highs.T.astype(kind)
            mine = labels[active][:, None]
            right = (first <= mine) & (mine <= last) if same else (first != mine) | (last != mine)
            right &= (up >= kth[active].min(axis=1)[:, None]) & (down <= high[active].max(axis=1)[:, None])
            for j in np.flatnonzero(right.any(axis=0)):
                some = np.flatnonzero(right[:, j])
                heapq.heappush(queue, (-up[some, j].max(), level, int(at[j]), active[some], up[some, j]))

        queue: list[tuple] = []
        push(len(self.levels) - 1, np.arange(1), np.arange(n))
        while queue:
            _, level, node, active, up = heapq.heappop(queue)
            active = active[up >= kth[active].min(axis=1)]
            if not len(active):
                continue
            if level:
                push(level - 1, np.arange(node * FANOUT, min((node + 1) * FANOUT, len(self.levels[level - 1][0]))), active)
                continue
            scores = plus[active] @ self.x[node].T.astype(kind) + minus[active] @ self.x[node].T.astype(kind)
            right = labels[active][:, None] == self.labels[node][None, :]
            right = right if same else ~right
            place = self.place[node]
            right &= place[None, :] != own[active][:, None]
            for w in range(windows):
                rows, cols = np.nonzero(right & (scores >= kth[active, w][:, None]) & (scores <= high[active, w][:, None]))
                if len(rows):
                    found.add(active[rows], w, scores[rows, cols].astype(np.int64), self.ids[node][cols], place[cols], kth)
        return found.rows()


class Found:
    """The first want rows so far of each anchor's windows, by score and then id."""

    def __init__(self, n: int, windows: int, want: int):
        self.windows, self.want = windows, want
        self.n = np.zeros((n, windows), dtype=np.int64)
        self.score, self.id, self.place = (np.zeros((n, windows, want), dtype=np.int64) for _ in range(3))

    def add(self, anchor: np.ndarray, w: int, score: np.ndarray, ids: np.ndarray, place: np.ndarray, kth: np.ndarray) -> None:
        """New rows of window w, anchors in order; kth rises to the want-th score of windows that have so many."""
        touched = np.unique(anchor)
        old, k = np.nonzero(np.arange(self.want)[None, :] < self.n[touched, w][:, None])
        old = touched[old]
        anchor = np.concatenate([old, anchor])
        score, ids, place = (np.concatenate([held[old, w, k], new]) for held, new in ((self.score, score), (self.id, ids), (self.place, place)))
        order = np.lexsort((place, ids, -score, anchor))
        anchor, score, ids, place = anchor[order], score[order], ids[order], place[order]
        rank = np.arange(len(anchor)) - np.searchsorted(anchor, anchor)
        top = rank < self.want
        self.score[anchor[top], w, rank[top]] = score[top]
        self.id[anchor[top], w, rank[top]] = ids[top]
        self.place[anchor[top], w, rank[top]] = place[top]
        np.maximum.at(self.n, (anchor[top], w), rank[top] + 1)
        full = touched[self.n[touched, w] == self.want]
        kth[full, w] = self.score[full, w, -1]

    def rows(self):
        anchor, window, k = np.nonzero(np.arange(self.want)[None, None, :] < self.n[:, :, None])
        return anchor, window, self.score[anchor, window, k], self.id[anchor, window, k], self.place[anchor, window, k]


def tiled(x: np.ndarray, rows: np.ndarray, coordinates: list[int], leaf: int) -> Iterator[np.ndarray]:
    """rows in tiles of up to leaf: sorted by the first coordinate and cut into as many slabs as make the tiles near cubes, each tiled by the others."""
    pages = math.ceil(len(rows) / leaf)
    if pages <= 1:
        yield rows
        return
    slabs = math.ceil(pages ** (1 / len(coordinates))) if len(coordinates) > 1 else pages
    rows = rows[np.argsort(x[rows, coordinates[0]], kind="stable")] if coordinates else rows
    step = leaf * math.ceil(pages / slabs)
    for k in range(0, len(rows), step):
        part = rows[k : k + step]
        yield from tiled(x, part, coordinates[1:], leaf) if len(coordinates) > 1 else (part[j : j + leaf] for j in range(0, len(part), leaf))


def packed(rows: DataFrame) -> tuple[DataFrame, int]:
    """Leaves of all slabs from rows (_id, _label, _anchor, _x), as kind 0 of PARTS, written to the shared folder, and the
    number of slabs.

    Slabs are ranges of (number of coordinates, label, first coordinate); equal ones are parted by a hash, so that
    neither a label nor a vector of many rows makes a slab larger."""
    slabs = max(math.ceil(rows.count() / SLAB), 2 * rows.sparkSession.sparkContext.defaultParallelism)
    by = [F.size("_x"), F.col("_label"), F.coalesce(F.get("_x", F.lit(0)), F.lit(0)), F.xxhash64("_id", "_x")]
    dealt = rows.repartitionByRange(slabs, *by).select(F.spark_partition_id().alias("slab"), F.size("_x").alias("size"), "_id", "_label", "_anchor", "_x")

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [b for b in batches if len(b)]
        if not held:
            return
        whole = pd.concat(held)
        at = 0
        for size, group in whole.groupby("size", sort=True):
            x = np.stack(list(group["_x"])).reshape(len(group), size)
            ids, labels, chosen = (group[c].to_numpy() for c in ("_id", "_label", "_anchor"))
            spread = x.max(axis=0) - x.min(axis=0) if size else np.zeros(0)
            wide = sorted(range(size), key=lambda j: -spread[j])
            for label in np.unique(labels):
                for tile in tiled(x, np.flatnonzero(labels == label), wide, LEAF):
                    y = x[tile]
                    yield pd.DataFrame({
                        "slab": [group["slab"].iloc[0]], "kind": 0, "at": at, "ids": [ids[tile]], "labels": [labels[tile]], "x": [y.ravel()],
                        "low": [y.min(axis=0)], "high": [y.max(axis=0)], "anchors": [np.flatnonzero(chosen[tile])],
                    })
                    at += 1

    return stored(dealt.mapInPandas(pack, PARTS)), slabs


def through(leaves: DataFrame, anchors: DataFrame, slabs: int, want: int, same: bool) -> DataFrame:
    """(home, place, window, score, id, slab, row) of what each anchor finds in the slab it is sent to; anchors are kind 1 of PARTS."""
    parts = leaves.drop("anchors").unionByName(anchors)
    parts = parts.repartitionById(slabs, "slab").sortWithinPartitions("slab", "kind")

    def found(slab: int, trees: dict[int, Slab], anchors: list[tuple]) -> Iterator[pd.DataFrame]:
        for size, tree in trees.items():
            if rows := [r for r in anchors if len(r[2]) == size]:
                keys, labels, x, low, high = map(np.stack, zip(*rows, strict=True))
                own = np.where(keys[:, 0] == slab, keys[:, 1], -1)
                i, w, score, ids, row = tree.search(x.astype(np.int64), labels[:, 0], own, low, high, want, same)
                yield pd.DataFrame({"home": keys[i, 0], "place": keys[i, 1], "window": w, "score": score, "id": ids, "slab": slab, "row": row})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, leaves, trees, waiting = None, {}, None, []
        for batch in batches:
            for slab, kind, at, *row in batch.itertuples(index=False):
                if slab != now:
                    if waiting:
                        yield from found(now, trees, waiting)
                    now, leaves, trees, waiting = slab, {}, None, []
                if not kind:
                    leaves.setdefault(len(row[3]), []).append((at, *row))
                    continue
                if trees is None:
                    trees = {size: Slab(some) for size, some in leaves.items()}
                waiting.append(tuple(row))
                if len(waiting) == BLOCK:
                    yield from found(now, trees, waiting)
                    waiting = []
        if waiting:
            yield from found(now, trees, waiting)

    return parts.mapInPandas(run, "home long, place long, window int, score long, id long, slab int, row long")


def first_rows(found: DataFrame, want: int) -> DataFrame:
    """Of what slabs found for each anchor and window the first want, with rank. A slab finds want at most."""
    order = Window.partitionBy("home", "place", "window").orderBy(F.desc("score"), "id", "slab", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= want)


def usable(vector: Column, scale: int) -> Column:
    """Whether all components are finite, and small enough once scaled for windows to be compared in 64 bits."""
    bound = F.sqrt(F.lit(float(MOST_SCORE)) / F.greatest(F.size(vector), F.lit(1)))
    fine = F.forall(vector, lambda x: F.coalesce((F.abs(F.lit(float(scale)) * x.cast("double")) < bound - 1) & ~F.isnan(x), F.lit(False)))
    return F.coalesce(fine, F.lit(False))


def mine_hard_negatives(
    df: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", anchor: Column | None = None,
    scale: int = 256, positives: int = 5, negatives: int = 3, window: tuple[int, int] = (50, 95),
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for each anchor and each of its positives.

    Components are floor(scale * x), scores inner products of those. Anchors are the rows for which anchor holds (of ids
    divisible by 50, if none is given); their positives are the first other rows of the same label, their negatives the first rows of other labels
    whose score lies between the two per cents of the positive's, ends included. First are higher scores, of equal ones
    smaller ids (missing ids last), of equal ids any.

    Rows with a null label, a null vector, a null or infinite component or NaN take no part, nor do those with a component
    too large for scores in 64 bits (over 2^25 once scaled, for 64 components). Rows of other numbers of components are
    never compared. Repeated rows count each, as anchors too; an empty table gives no rows. Labels and ids are whole
    numbers. Other columns are not read.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    last = F.lit((1 << 63) - 1)
    own = F.col(f"`{id_col}`").cast("long")
    anchor = F.pmod(own, F.lit(50)) == 0 if anchor is None else anchor
    rows = df.select(own.alias("_id"), F.col(f"`{label_col}`").cast("long").alias("_label"), F.coalesce(anchor, F.lit(False)).alias("_anchor"), F.col(f"`{vector_col}`").alias("_v"))
    rows = rows.where(F.col("_label").isNotNull() & usable(F.col("_v"), scale))
    scaled = F.transform("_v", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("int"))
    rows = stored(rows.select(F.coalesce("_id", last).alias("_id"), "_label", "_anchor", scaled.alias("_x")))
    leaves, slabs = packed(rows)
    discard(rows)
    one = leaves.where(F.size("anchors") > 0).select("slab", "at", "ids", "labels", "x", F.size("low").alias("size"), F.explode("anchors").alias("j"))
    item = lambda c: F.get(c, F.col("j"))
    anchors = one.select(F.col("slab").cast("long").alias("home"), (F.shiftleft("at", PLACE_BITS) + F.col("j")).alias("place"), item("ids").alias("anchor_id"), item("labels").alias("label"), F.slice("x", F.col("j") * F.col("size") + 1, F.col("size")).alias("x"))
    anchors = stored(anchors)

    def sent(to: Column, low: Column, high: Column, rows: DataFrame = anchors) -> DataFrame:
        longs = lambda *c: F.array(*c).cast("array<long>")
        return rows.select(to.alias("slab"), F.lit(1).alias("kind"), F.lit(0).cast("long").alias("at"), longs("home", "place").alias("ids"), longs("label").alias("labels"), "x", low.cast("array<long>").alias("low"), high.cast("array<long>").alias("high"))

    everywhere, far = F.sequence(F.lit(0), F.lit(slabs - 1)), F.lit(FAR)
    near = stored(through(leaves, sent(F.col("home").cast("int"), F.array(-far), F.array(far)), slabs, positives, True))
    kth = near.groupBy("home", "place").agg(F.when(F.count("*") == positives, F.min("score")).otherwise(-far).alias("kth"))
    others = anchors.join(kth, ["home", "place"], "left").withColumn("kth", F.coalesce("kth", -far))
    others = sent(F.explode(F.array_remove(everywhere, F.col("home").cast("int"))), F.array("kth"), F.array(far), others)
    best = stored(first_rows(near.unionByName(through(leaves, others, slabs, positives, True)), positives).select("home", "place", "rank", "score", "id"))
    # a window for each positive, an empty one where there are fewer
    ends = F.map_from_entries(F.collect_list(F.struct("rank", F.struct(F.expr(f"-((-{window[0]} * score - pmod(-{window[0]} * score, 100)) div 100)").alias("low"), F.expr(f"({window[1]} * score - pmod({window[1]} * score, 100)) div 100").alias("high")))))
    windows = anchors.join(best.groupBy("home", "place").agg(ends.alias("ends")), ["home", "place"])
    end = lambda name, none: F.array(*(F.coalesce(F.col("ends")[k][name], F.lit(none)) for k in range(1, positives + 1)))
    found = first_rows(through(leaves, sent(F.explode(everywhere), end("low", 1), end("high", 0), windows), slabs, negatives, False), negatives)
    found = found.select("home", "place", (F.col("window") + 1).alias("_k"), "rank", F.col("id").alias("_negative"), F.col("score").alias("negative_score"))
    out = found.join(best.select("home", "place", F.col("rank").alias("_k"), F.col("id").alias("_positive"), F.col("score").alias("positive_score")), ["home", "place", "_k"])
    out = out.join(anchors.select("home", "place", F.col("anchor_id").alias("_anchor")), ["home", "place"])
    named = [F.when(F.col(f"_{c}") != last, F.col(f"_{c}")).alias(f"{c}_id") for c in ("anchor", "positive", "negative")]
    return out.select(named[0], named[1], "rank", named[2], "positive_score", "negative_score")
