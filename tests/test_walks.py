"""What tasks make of a repository's rows against the keyed jobs over spelled-out members of splits."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.operators import evaluate, hops, prep, search, splits, walks
from tidemark.plans import learning_queries as learning
from tidemark.shared import stored

COLUMNS = "threshold string, repository string, commit string, committed_at timestamp, label int, sample_id string, quantity double, price double, discount double, tax double, nodes int, edges int"


@pytest.fixture(scope="module")
def rows(spark):
    """Repositories of 2 to 14 commits; commits of equal times, missing, infinite and constant values."""
    rng, out = np.random.default_rng(9), []
    for t in ("none", "3:2"):
        for r, commits in enumerate((2, 5, 9, 14, 11)):
            for c in range(commits):
                for i in range(int(rng.integers(1, 6))):
                    y = int(rng.random() < 0.45)
                    price = [None, float("inf"), float("nan")][i] if rng.random() < 0.2 and i < 3 else float(np.round(rng.normal() + y, 2))
                    out.append((t, f"{t}|r{r}", f"k{(c * 7) % commits}", f"2024-01-{1 + c // 2:02d}", y, f"{t}{r}::{c}::{i}" + "é" * (i % 3), float(rng.integers(0, 6)), price, 0.5 if r == 2 else float(rng.normal() - y), None if r == 3 else float(rng.integers(0, 3)), int(rng.integers(0, 9)), i))
    df = spark.createDataFrame(out, COLUMNS.replace("committed_at timestamp", "committed_at string"))
    return df.withColumn("committed_at", F.to_timestamp("committed_at")).cache()


def test_hashes_are_those_of_spark(spark):
    texts = ["", "a", "abc", "abcdefgh", "é" * 9, "x" * 31, "x" * 32, "o12345::f1::155190::7706::17.0::1", "y" * 77]
    held = walks.Texts(pa.array(texts))
    start = walks.seeds(42, len(texts))
    want = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", F.xxhash64(F.lit(42), "t").alias("a"), F.xxhash64(F.lit(42), "t", F.lit(1), F.lit(0), F.lit(-7).cast("long")).alias("b")).orderBy("i").collect()
    text = held.hashed(np.arange(len(texts)), start)
    more = walks.hashed_long(np.full(len(texts), -7), walks.hashed_int(np.zeros(len(texts)), walks.hashed_int(np.ones(len(texts)), text)))
    assert [r.a for r in want] == text.view(np.int64).tolist() and [r.b for r in want] == more.view(np.int64).tolist()


RUNS = [("base", "e1", "random_oversampling", 42, "none", learning.FEATURES), ("s", "u", "random_undersampling", 7, "none", learning.FEATURES), ("s", "n", "none", 42, "3:2", ["quantity", "price"]), ("s", "g", "random_oversampling", 42, "3:2", learning.GRAPH_FEATURES)]


def test_bayes_of_tasks_is_that_of_members(rows, monkeypatch):
    """no member of a split is spelled out."""
    want_used, want = learning.swept_keyed(learning.spelled_out(rows), RUNS)
    want_used, want = want_used.collect(), {(r.run, r.split_id, r.sample_id): r for r in want.collect()}
    monkeypatch.setattr(splits, "members", None)
    found = learning.swept(rows, RUNS).collect()
    got = {(r.run, r.split_id, r.sample_id): r for r in found if r.used is None}
    assert set(got) == set(want) and len({k[0] for k in got}) == 4 and len(got) > 60
    for k, r in got.items():
        assert (r.y_true, r.y_pred, r.y_score) == (want[k].y_true, want[k].y_pred, pytest.approx(want[k].y_score, abs=1e-6)), k
    assert sorted((r.run, r.split_id, list(r.used)) for r in found if r.used is not None) == sorted((r.run, r.split_id, list(r.used)) for r in want_used)


def test_large_repositories_go_by_members(rows, monkeypatch):
    want = sorted(map(str, (r[:4] for r in learning.swept(rows, RUNS[:1]).collect())))
    monkeypatch.setattr(walks, "GATHERED", 25)
    assert sorted(map(str, (r[:4] for r in learning.swept(rows, RUNS[:1]).collect()))) == want


@pytest.mark.parametrize("strategy", ["random_oversampling", "random_undersampling", "none"])
def test_draws_are_those_of_balanced(rows, strategy):
    part = learning.spelled_out(rows).where("partition = 'train'")
    want = {(r.split_id, r.sample_id): r.n for r in prep.balanced(part, strategy, 5).groupBy("split_id", "sample_id").agg(F.count("*").alias("n")).collect()}

    def work(block):
        for some in block.some():
            k, m = np.nonzero(times := some.balanced(strategy, 5))
            yield {"split_id": pa.array([block.names[some.at[i]] for i in k], pa.string()), "sample_id": block.taken(some.place[k, m]), "n": pa.array(times[k, m])}

    got = walks.spread(rows, [], "split_id string, sample_id string, n long", work).collect()
    assert {(r.split_id, r.sample_id): r.n for r in got} == want and len(want) > 100


def same_metrics(got, want, keys, more=()):
    got, want = ({tuple(r[k] for k in keys): r for r in df.collect()} for df in (got, want))
    assert set(got) == set(want) and got
    for k, r in got.items():
        for c in ("tp", "fp", "fn", "tn", *evaluate.NAMES, *more):
            assert r[c] == want[k][c] or r[c] == pytest.approx(want[k][c], abs=1e-9), (k, c)


def test_linear_models_of_tasks_are_those_of_members(spark, rows, monkeypatch):
    """F8: no member of a split is spelled out."""
    base = rows.where("threshold = 'none'")
    want = stored(learning.linear_keyed(learning.spelled_out(base), learning.FEATURES))
    monkeypatch.setattr(learning, "swept_rows", lambda *_: (None, base))
    monkeypatch.setattr(splits, "members", None)
    same_metrics(learning.m08_linear(spark, ""), evaluate.metrics(want, ["model", "split_id"]), ["model", "split_id"])
    each = learning.linear_predictions(base, learning.FEATURES)
    same_metrics(evaluate.metrics(stored(each), ["model", "split_id"]), evaluate.metrics(want, ["model", "split_id"]), ["model", "split_id"])


def test_trees_of_tasks_are_those_of_members(spark, rows, monkeypatch):
    """no member of a split is spelled out."""
    base = rows.where("threshold = 'none'")
    want = stored(learning.trees_keyed(learning.spelled_out(base), learning.FEATURES))
    monkeypatch.setattr(learning, "swept_rows", lambda *_: (None, base))
    monkeypatch.setattr(splits, "members", None)
    same_metrics(learning.m08_trees(spark, ""), evaluate.metrics(want, ["model", "split_id"]), ["model", "split_id"])
    each = learning.tree_predictions(base, learning.FEATURES)
    same_metrics(evaluate.metrics(stored(each), ["model", "split_id"]), evaluate.metrics(want, ["model", "split_id"]), ["model", "split_id"])


def test_search_grows_all_trees(spark, rows, monkeypatch):
    """forests have as many trees as the configurations say, and no member of a split is spelled out."""
    monkeypatch.setattr(search, "DEEPEST", 6)
    monkeypatch.setattr(search, "SPACE", {"random_forest": {"trees": [6, 3, 9], "depth": [None, 2], "least": [1, 2, 5]}, "linear_svm": search.SPACE["linear_svm"]})
    base = rows.where("threshold = 'none'")
    found = stored(search.search_on_splits(*learning.ready_rows(learning.spelled_out(base)), len(learning.FEATURES)))
    want = evaluate.metrics(found, ["model", "split_id"]).join(found.select("model", "split_id", "parameters", "validation_score").distinct(), ["model", "split_id"])
    monkeypatch.setattr(learning, "swept_rows", lambda *_: (None, base))
    monkeypatch.setattr(splits, "members", None)
    same_metrics(learning.m09_splits(spark, ""), learning.plain_names(want), ["model", "split_id"], ["parameters", "validation_score"])


def test_counts_of_tasks_are_those_of_members(spark, rows, monkeypatch):
    """no member of a split is spelled out."""
    base = rows.where("threshold = 'none'").withColumns({"filepath": F.col("sample_id"), "l_partkey": F.lit(1), "l_suppkey": F.lit(1)})
    train = splits.members(base, splits.walk_forward(base)).where("partition = 'train'")
    each = [df.groupBy("split_id", "label").count().collect() for df in (train, prep.balanced(train, "random_oversampling"))]
    before, after = ({(r.split_id, r.label): r["count"] for r in one} for one in each)
    monkeypatch.setattr(learning, "samples", lambda *_: base)
    monkeypatch.setattr(splits, "members", None)
    got = {(r.split_id, r.label): (r.before, r.after) for r in learning.m01_over(spark, "").collect()}
    assert got == {k: (n, after[k]) for k, n in before.items()} and len(got) > 10


def test_graphs_of_tasks_are_those_of_members(spark, monkeypatch):
    """no graph of a split's training rows is spelled out."""
    whole, features, adjacent = learning.graph_samples(spark, "/root/testdata/sf0.001")
    held = stored(whole.where("repository < 'c2'"))
    found = stored(hops.hop_table(features, adjacent, learning.GRAPH_COLUMNS))
    want = {(r.split_id, r.sample_id): r for r in learning.graph_keyed(held, found).collect()}
    monkeypatch.setattr(learning, "graph_samples", lambda *_: (held, features, adjacent))
    monkeypatch.setattr(hops, "split_graphs", None)
    got = learning.graph_predictions(spark, "").collect()
    assert {(r.split_id, r.sample_id) for r in got} == set(want) and len(got) > 100
    for r in got:
        w = want[r.split_id, r.sample_id]
        assert (r.y_true, r.y_pred, r.penalty, r.y_score) == (w.y_true, w.y_pred, w.penalty, pytest.approx(w.y_score, abs=1e-6))


def test_selection_of_tasks_is_that_of_members(spark, rows, monkeypatch):
    """no member of a split is spelled out."""
    base = rows.where("threshold = 'none' AND repository <> 'none|r4'")
    want = stored(learning.selected_keyed(learning.spelled_out(base)))
    monkeypatch.setattr(learning, "swept_rows", lambda *_: (None, base))
    monkeypatch.setattr(splits, "members", None)
    same_metrics(learning.m05_splits(spark, ""), learning.plain_names(want), ["selector", "split_id"], ["used"])
