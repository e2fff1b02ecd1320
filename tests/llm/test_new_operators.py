"""Hard negatives, bit-plane clusters and the digest index against brute force and on edge cases."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import op11_rtree
from tidemark.llm.op11_rtree import mine_hard_negatives
from tidemark.llm.op12_bitplanes import cluster_vectors, dots, from_planes, norms, to_planes
from tidemark.llm.op13_digest_index import DigestIndex, deduplicate, digests

VECTORS = "vec_id long, embedding array<float>, label int, LABEL_ int, `a.b` string, _x int"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], VECTORS)


def hard_negatives(rows, scale=256, positives=5, negatives=3):
    rows = [(i, tuple(int(np.floor(scale * float(np.float32(x)))) for x in v), k) for i, v, k in rows if k is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    last, out = 1 << 70, []
    for at, (i, v, k) in enumerate(rows):
        if i is None or i % 50:
            continue
        scored = [(-sum(a * b for a, b in zip(v, w)), last if j is None else j, m, n) for n, (j, w, m) in enumerate(rows) if n != at and len(w) == len(v)]
        for p, j, _, _ in sorted(x for x in scored if x[2] == k)[:positives]:
            found = sorted((s, q) for s, q, m, _ in scored if m != k and 50 * -p <= 100 * -s <= 95 * -p)[:negatives]
            out += [(i, None if j == last else j, r + 1, None if q == last else q, -p, -s) for r, (s, q) in enumerate(found)]
    return sorted(out, key=str)


def mined(df, **how):
    return sorted((tuple(r) for r in mine_hard_negatives(df, **how).collect()), key=str)


@pytest.mark.parametrize("leaf", [4, 128])
def test_op11_against_brute_force(spark, monkeypatch, leaf):
    """Clusters, one vector in a third of all rows, ties, repeated rows, missing ids, several lengths, and small leaves, slabs and blocks."""
    rng = np.random.default_rng(5)
    monkeypatch.setattr(op11_rtree, "LEAF", leaf)
    monkeypatch.setattr(op11_rtree, "SLAB", 60)
    monkeypatch.setattr(op11_rtree, "BLOCK", 3)
    centres = rng.normal(size=(6, 8))
    rows = [(i, (centres[i % 6] + 0.1 * rng.normal(size=8)).tolist(), int(rng.integers(3))) for i in range(300)]
    rows += [(1000 + i, [0.5] * 8, i % 4) for i in range(150)]
    rows += [(50, rows[50][1], rows[50][2]), rows[50], (None, rows[7][1], 1), (None, rows[8][1], 2)]
    rows += [(2000 + i, rng.normal(size=2).tolist(), i % 2) for i in range(60)] + [(2100, [], 1), (2101, [], 1), (2102, [], 2)]
    rows += [(3000, None, 1), (3050, [0.1] * 8, None), (3100, [0.1, None] * 4, 1), (3150, [float("nan")] * 8, 1), (3200, [float("inf")] * 8, 0), (3250, [float("-inf")] * 8, 0)]
    rows += [(4000, [1.0] * 3, 9), (4050, [0.0] * 8, 0), (4100, (-centres[0]).tolist(), 7)]
    assert mined(vectors(spark, rows)) == hard_negatives(rows)
    assert mined(vectors(spark, rows), positives=2, negatives=1) == hard_negatives(rows, positives=2, negatives=1)


def test_op11_large_components_and_nothing(spark):
    rows = [(50 * i, [30_000.0 + i, 1e5, -3.5], i % 2) for i in range(12)]
    assert mined(vectors(spark, rows)) == hard_negatives(rows)
    assert mined(vectors(spark, [*rows, (7, [3e38, 1.0, 1.0], 1)])) == hard_negatives(rows)  # no score of 64 bits
    assert mined(vectors(spark, [])) == []
    assert mined(vectors(spark, [(0, [1.0], 1)])) == []


def test_op11_prunes(spark):
    """Boxes outside the windows or below the k-th score are left out, so few leaves are scored."""
    rng = np.random.default_rng(1)
    x = np.concatenate([np.full((256, 3), 40 * k) + rng.integers(0, 9, (256, 3)) for k in range(8)])
    leaves = [(k, np.arange(k * 64, k * 64 + 64), np.zeros(64, np.int64), x[k * 64 : k * 64 + 64].ravel(), x[k * 64 : k * 64 + 64].min(0), x[k * 64 : k * 64 + 64].max(0)) for k in range(32)]
    tree, seen = op11_rtree.Slab(leaves), []

    class Watched(list):
        def __getitem__(self, i):
            seen.append(i)
            return super().__getitem__(i)

    tree.x = Watched(tree.x)
    far = np.array([[1 << 62]])
    anchor, _, score, _, _ = tree.search(np.array([[1, 1, 1]]), np.array([0]), np.array([-1]), -far, far, 5, True)
    assert sorted(score)[::-1] == sorted(x.sum(1))[::-1][:5]
    assert len(set(seen)) <= 4
    seen.clear()
    window = tree.search(np.array([[1, 1, 1]]), np.array([1]), np.array([-1]), np.array([[200]]), np.array([[250]]), 3, False)
    assert sorted(window[2])[::-1] == sorted(s for s in x.sum(1) if 200 <= s <= 250)[::-1][:3]
    assert len(set(seen)) <= 8


def clusters(rows, k=16, rounds=3):
    rows = [(i, [int(np.floor(64 * float(np.float32(x)))) for x in v]) for i, v, _ in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    x = np.array([v for _, v in rows], dtype=object).reshape(len(rows), 64)
    named = [i for i in range(len(rows)) if rows[i][0] is not None]
    c = [list(x[i]) for i in sorted(named, key=lambda i: hashlib.sha256(f"1:{rows[i][0]}".encode()).hexdigest())[:k]]
    for step in range(rounds + 1):
        far = [[sum((a - b) ** 2 for a, b in zip(v, w)) for w in c] for v in x]
        at = [f.index(min(f)) for f in far]
        if step < rounds:
            for j in range(len(c)):
                own = [x[i] for i in range(len(x)) if at[i] == j]
                if own:
                    c[j] = [sum(col) // len(own) for col in zip(*own)]
    d = [min(f) for f in far]
    return sorted(((rows[i][0], at[i], d[i], sum(d[j] for j in range(len(d)) if at[j] == at[i]), sum(d), c[at[i]]) for i in range(len(rows))), key=str)


def clustered(df, **how):
    return sorted(((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, list(r.centroid)) for r in cluster_vectors(df, **how).collect()), key=str)


def test_op12_against_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=64) * (0.1, 0.5, 30.0)[i % 3]).tolist(), 1) for i in range(120)]
    rows += [(500 + i, rows[3][1], 1) for i in range(70)] + [rows[5], rows[5], (None, rows[6][1], 1)]
    rows += [(900, [0.0] * 64, 1), (901, [-0.01] * 64, 1), (902, [1000.0] * 64, 1)]
    bad = [(910, None, 1), (911, [], 1), (912, [0.5] * 63, 1), (913, [0.5] * 63 + [None], 1), (914, [0.5] * 63 + [float("nan")], 1), (915, [float("inf")] * 64, 1), (916, [float("-inf")] * 64, 1)]
    df = vectors(spark, rows + bad)
    assert clustered(df) == clusters(rows)
    assert clustered(vectors(spark, rows[:5])) == clusters(rows[:5])  # fewer rows than centroids
    assert clustered(vectors(spark, bad)) == [] == clustered(vectors(spark, []))
    assert clustered(vectors(spark, [(1, [3e38] * 64, 1), *rows[:3]])) == clusters(rows[:3])  # its distances are no 64-bit numbers


def test_op12_columns(spark):
    named = spark.createDataFrame([(1, [0.5] * 64, 3, "y")], "vec_id long, embedding array<float>, Cluster int, `a.b` string")
    out = cluster_vectors(named)
    assert out.columns == ["vec_id", "embedding", "a.b", "cluster", "distance", "cluster_inertia", "inertia", "centroid"]
    assert out.select("vec_id", "cluster", "distance", "`a.b`").collect() == [(1, 0, 0, "y")]


def test_op12_planes():
    rng = np.random.default_rng(3)
    for bound in (1, 2, 38, 1 << 20, 1 << 27):
        a, b = rng.integers(-bound, bound, (9, 64)), rng.integers(-40, 40, (5, 64))
        assert (from_planes(to_planes(a)) == a).all()
        assert (dots(to_planes(a), to_planes(b)) == a @ b.T).all()
        assert (norms(to_planes(a)) == (a * a).sum(1)).all()


def exact(rows):
    groups = defaultdict(list)
    for n, (i, text, *_) in enumerate(rows):
        own = re.sub("[\x20\x09-\x0d]", "", text or "")
        groups[own].append((-len(text or ""), 1 << 70 if i is None else i, n))
    out = []
    for own, held in groups.items():
        best = min(held)
        out += [(None if i == 1 << 70 else i, None if best[1] == 1 << 70 else best[1], len(held), (n, i, at) == best, hashlib.sha256(own.encode()).hexdigest()) for n, i, at in held]
    return sorted(out, key=str)


def deduplicated(df, **how):
    return sorted((tuple(r) for r in deduplicate(df, **how).collect()), key=str)


def test_op13_against_brute_force(spark, monkeypatch):
    from tidemark.llm import op13_digest_index

    monkeypatch.setattr(op13_digest_index, "LEAST_HOT", 50)
    rng = random.Random(4)
    rows = [(i, rng.choice(["a b", "ab", "a  b\n", "c", " c", "é\U0001f600 x", "é\U0001f600x", "long " * 3000, "A b"])) for i in range(90)]
    rows += [(200 + i, " hot text" + " " * (i % 3)) for i in range(60)] + [(300, None), (301, ""), (302, " \t\n\x0b\x0c\r"), (None, "ab"), (None, "only"), (7, "twice"), (7, "twice"), (7, "twice")]
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, Kept int, `a.b` string")
    for batches in (1, 2, 3):
        assert deduplicated(df, batches=batches) == exact(rows)
    assert deduplicated(df.limit(0)) == []


def test_op13_index_persists(spark, tmp_path):
    """A later job opens the same folder: what is known is dropped, the rest appended, and the index is not shuffled."""
    docs = lambda rows: digests(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    path = f"file:{tmp_path}/index"
    first, batch = DigestIndex(spark, path, 4), docs([(1, "a b"), (2, "ab"), (3, "c"), (4, "d")])
    ids = lambda new, of: sorted(r.id for r in new.join(of, "row").collect())
    assert ids(first.add(batch, "monday"), batch) == [1, 3, 4]
    assert ids(first.add(batch, "monday"), batch) == [1, 3, 4]  # handed over again: the same, and counted once
    second, more = DigestIndex(spark, path, 4), docs([(5, "a  b"), (6, "e"), (7, "e "), (8, "c")])
    assert ids(second.add(more, "tuesday"), more) == [7]
    assert {(r.keep_id, r.group_size) for r in second.groups().collect()} == {(5, 3), (3, 2), (4, 1), (7, 2)}
    plan = second.groups()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Bucketed: true" in plan
    again = deduplicated(spark.createDataFrame([(9, "ab"), (10, "f"), (11, "c  ")], "doc_id long, text string"), path=path, buckets=4)
    assert [(r[0], r[1], r[2], r[3]) for r in again] == [(10, 10, 1, True), (11, 11, 3, True), (9, 5, 4, False)]
