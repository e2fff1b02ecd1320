"""Selection on all splits at once against elimination split by split, with the same draws, cuts and orders of features."""

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_trees import grow

from tidemark.operators import selection, trees

TREES, DEPTH, SEED = 3, 2, 42


def mcc(y, p):
    tp, tn, fp, fn = (sum((a, b) == c for a, b in zip(y, p)) for c in ((1, 1), (0, 0), (0, 1), (1, 0)))
    root = math.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    f1 = 2 * tp / (2 * tp + fp + fn) if 2 * tp + fp + fn else 0.0
    return (tp * tn - fp * fn) / root if root else None, f1, (tp + tn) / len(y)


class Looked:
    """grow() with the features that each node looks at."""

    def __init__(self, order, left, look):
        self.order, self.left, self.look = order, left, look

    def grow(self, bins, y, w, tree, depth, node=1):
        if not depth:
            return {}
        some = [f for f in self.left if len({b for b, v in zip(bins[:, f], w) if v}) > 1]
        some = sorted(some, key=lambda f: self.order[tree, node, f])[: self.look]
        mine = np.zeros_like(bins)
        mine[:, some] = bins[:, some]
        found = grow(mine, y, w, 1, 1, node) if w.sum() else {}
        if node not in found:
            return {}
        f, b, low, high = found[node]
        before, p, n = (w * y).sum() * (w.sum() - (w * y).sum()) / w.sum(), (w * y).sum(), w.sum()
        side = bins[:, f] <= b
        pl, nl = (w * y)[side].sum(), w[side].sum()
        gain = before - pl * (nl - pl) / nl - (p - pl) * (n - nl - p + pl) / (n - nl)
        out = {node: (f, b, low, high, gain)}
        for s, at in ((side, 2 * node), (~side, 2 * node + 1)):
            out |= self.grow(bins[s], y[s], w[s], tree, depth - 1, at)
        return out


def scored(forest, roots, bins):
    out = []
    for row in bins:
        shares = []
        for splits, root in zip(forest, roots):
            node, share = 1, root
            while node in splits:
                f, b, low, high, _ = splits[node]
                node, share = (2 * node, low) if row[f] <= b else (2 * node + 1, high)
            shares.append(share)
        out.append(sum(shares) / len(shares))
    return out


@pytest.fixture(scope="module")
def found(spark):
    rng, train, held = np.random.default_rng(11), [], []
    for k, n in (("a", 40), ("b", 30), ("c", 12), ("d", 9), ("e", 8)):
        for i in range(n + 12):
            y = 0 if k == "e" and i < n else 1 if k == "d" and i == 0 else int(k != "d" and rng.random() < 0.5)
            x = [y + float(rng.integers(0, 3)), float(rng.normal()), y * 0.8 + float(rng.normal()), 1.0, float(rng.integers(0, 4))]
            if i < n:
                train.append((k, f"{k}{i}", y, x))
            elif k != "c" or i % 2:
                held.append((k, "test" if i % 2 else "validation", f"{k}{i}", y, x))
    t = spark.createDataFrame(train, "split_id string, sample_id string, label int, x array<double>")
    h = spark.createDataFrame(held, "split_id string, partition string, sample_id string, label int, x array<double>")
    return t, h


def eliminated(spark, t, fold_rows, judged, size):
    """{(split, fold): [(left, ranked, scores of judged rows), ...]} round by round, one key at a time."""
    rows = fold_rows.collect()
    keys = ["split_id", "fold"]
    edges = {(r.split_id, r.fold): r.edges for r in trees.fit_trees(fold_rows, keys, size, 1, 1, seed=SEED).collect()}
    ready = fold_rows.withColumn("drawn", trees.drawn(TREES, SEED, keys, "sample_id")).collect()
    every = spark.createDataFrame([(*k, a, b, c) for k in edges for a in range(TREES) for b in range(1, 1 << DEPTH) for c in range(size)], "split_id string, fold int, tree int, node int, feature int")
    order = defaultdict(dict)
    for r in every.withColumn("h", F.xxhash64(F.xxhash64(F.lit(SEED), "split_id", "fold"), "tree", "node", "feature")).collect():
        order[r.split_id, r.fold][r.tree, r.node, r.feature] = r.h
    cut = lambda x, e: [sum(v > q for q in some) for v, some in zip(x, e)]
    out = {}
    for key, e in edges.items():
        own = [r for r in ready if (r.split_id, r.fold) == key]
        bins, y, w = np.array([cut(r.x, e) for r in own]), np.array([r.label for r in own]), np.array([r.drawn for r in own])
        look = [(r, cut(r.x, e)) for r in judged if (r.split_id, r.fold) == key]
        left, rounds = list(range(size)), []
        while left:
            looked = Looked(order[key], left, max(1, math.isqrt(len(left))))
            drawn = [k for k in range(TREES) if w[:, k].sum()]
            forest = [looked.grow(bins, y, w[:, k], k, DEPTH) for k in drawn]
            roots = [(w[:, k] * y).sum() / w[:, k].sum() for k in drawn]
            weight = np.zeros(size)
            for splits in forest:
                for f, _, _, _, gain in splits.values():
                    weight[f] += gain / sum(s[4] for s in splits.values()) / len(forest)
            ranked = sorted(left, key=lambda i: (round(weight[i], 9), i), reverse=True)
            rounds.append((list(left), ranked, [(r, s) for (r, _), s in zip(look, scored(forest, roots, [b for _, b in look]))]))
            left = sorted(ranked[:-1])
        out[key] = rounds
    return out


def test_same_as_split_by_split(spark, found):
    t, h = found
    size = 5
    used, final = selection.select_on_splits(t, h, size, count_trees=TREES, depth=DEPTH, cv=3, seed=SEED)
    got = {(r.split_id, r.selector): list(r.used) for r in used.collect()}
    dealt = selection.with_folds(t, 3, SEED).collect()
    assert {r.folds for r in dealt if r.split_id in "abc"} == {3} and {r.folds for r in dealt if r.split_id == "d"} == {1} and {r.folds for r in dealt if r.split_id == "e"} == {0}
    for k in "abc":
        for y in (0, 1):
            many = [sum(r.split_id == k and r.label == y and r.fold == f for r in dealt) for f in range(3)]
            assert max(many) - min(many) <= 1
    rows = [(r.split_id, f, r.sample_id, r.label, r.x) for r in dealt if r.folds for f in [-1, *(range(r.folds) if r.folds > 1 else ())] if f != r.fold]
    held = [r for r in h.withColumn("fold", F.lit(-1)).collect()] + [r for r in dealt if r.folds > 1]
    rounds = eliminated(spark, t, spark.createDataFrame(rows, "split_id string, fold int, sample_id string, label int, x array<double>"), held, size)
    want, scores = {}, {}
    for k in "abcd":
        whole = rounds[k, -1]
        want[k, "rfe"] = whole[3][0]
        folds = [rounds[k, f] for f in range(3) if (k, f) in rounds]
        best = 0
        if folds:
            mean = [sum(mcc([r.label for r, _ in x[j][2]], [int(s >= 0.5) for _, s in x[j][2]])[0] or 0.0 for x in folds) / 3 for j in range(size)]
            best = max(range(size), key=lambda j: (round(mean[j], 9), j))
        want[k, "rfecv"] = whole[best][0]
        judged = [[(r, s) for r, s in x[2] if r.partition == "validation"] for x in whole]
        at = 0
        if judged[0]:
            value = [next(m for m in mcc([r.label for r, _ in x], [int(s >= 0.5) for _, s in x]) if m is not None) for x in judged]
            at = max(range(size), key=lambda j: (round(value[j], 9), j))
        want[k, "validation_rfe"] = whole[at][0]
        for name, j in (("rfe", 3), ("rfecv", best), ("validation_rfe", at)):
            scores |= {(name, r.sample_id): s for r, s in whole[j][2]}
    assert got == want and len({tuple(v) for v in got.values()}) > 2
    rows = final.collect()
    assert {(r.selector, r.sample_id): pytest.approx(r.y_score) for r in rows} == scores and len(rows) == len(scores)


def test_wide_steps(spark, found):
    """A step of two features: rfe and validation_rfe also score sets that no round passes."""
    t, h = found
    used, final = selection.select_on_splits(t, h, 5, step=2, count=4, count_trees=TREES, depth=DEPTH)
    got = {(r.split_id, r.selector): list(r.used) for r in used.collect()}
    assert all(len(got[k, "rfe"]) == 4 and len(got[k, "rfecv"]) in (5, 3, 1) and len(got[k, "validation_rfe"]) in (1, 3, 5) for k in "abcd")
    assert final.groupBy("selector").count().collect()[0]["count"] == h.where("split_id <> 'e'").count()
