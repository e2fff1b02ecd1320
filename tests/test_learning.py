"""Sweeps, selection and search against brute force on small tables."""

import math
import random
from statistics import median

import pytest
from pyspark.sql import functions as F

from tidemark.operators import models, prep
from tidemark.plans import learning_queries as learning

SF = "/root/testdata/sf0.001"


def test_ranked_bayes_and_best_prefix(spark):
    rng = random.Random(8)
    rows = [(k, p, i, (y := i % 2), None if i % 5 == 0 else y * 1.5 + rng.random() * 2, rng.random() + y * 0.4, 7.0, None) for k in "ab" for p, n in (("train", 24), ("validation", 15)) for i in range(n)]
    df = spark.createDataFrame(rows, "split_id string, partition string, n int, label int, x double, y double, same double, none double")
    names = ["same", "y", "none", "x"]
    fits = prep.ranked_bayes(df.where("partition = 'train'"), names, ["split_id"])
    odds = prep.prefix_log_odds(df.where("partition = 'validation'").join(fits, "split_id"), names)
    best = {r.split_id: r["size"] for r in prep.best_prefix(odds, ["split_id"]).collect()}
    got = {(r.split_id, r.n): (list(r.log_odds), [f.feature for f in r.ranked]) for r in odds.collect()}
    for k in "ab":
        train = [r for r in rows if r[0] == k and r[1] == "train"]
        fit = {}
        for c, at in (("x", 4), ("y", 5)):
            med = median(r[at] for r in train if r[at] is not None)
            v = [med if r[at] is None else r[at] for r in train]
            mean = sum(v) / len(v)
            std = math.sqrt(sum((a - mean) ** 2 for a in v) / len(v))
            by = [[(a - mean) / std for a, r in zip(v, train) if r[3] == y] for y in (0, 1)]
            m = [sum(b) / len(b) for b in by]
            fit[c] = (med, mean, std, m, [sum((a - m[y]) ** 2 for a in by[y]) / len(by[y]) + 1e-9 for y in (0, 1)], at)
        order = sorted(fit, key=lambda c: -abs(fit[c][3][1] - fit[c][3][0]))
        right = {1: [], 2: []}
        for r in (r for r in rows if r[0] == k and r[1] == "validation"):
            total, want = 0.0, []
            for c in order:
                med, mean, std, m, v, at = fit[c]
                z = ((med if r[at] is None else r[at]) - mean) / std
                total += sum(s * -0.5 * (math.log(v[y]) + (z - m[y]) ** 2 / v[y]) for y, s in ((1, 1), (0, -1)))
                want.append(total)
            assert got[k, r[2]][1] == order and got[k, r[2]][0] == pytest.approx(want)
            for size in (1, 2):
                right[size].append((r[3], int(want[size - 1] >= 0)))
        score = {}
        for size, found in right.items():
            n = lambda a, b: found.count((a, b))
            root = math.sqrt((n(1, 1) + n(0, 1)) * (n(1, 1) + n(1, 0)) * (n(0, 0) + n(0, 1)) * (n(0, 0) + n(1, 0)))
            score[size] = (n(1, 1) * n(0, 0) - n(0, 1) * n(1, 0)) / root
        assert best[k] == max(score, key=lambda s: (round(score[s], 9), -s))


def test_sweep_has_all_runs_splits_and_rows(spark):
    part = learning.members(spark, SF)
    got = {r.run: r for r in learning.v14(spark, SF).collect()}
    assert len(got) == len(learning.RUNS) == 12 and {r.strategy for r in got.values()} == {"none", "random_undersampling", "random_oversampling"}
    base = got["base:e1"]
    tested = part.where("partition = 'test'")
    assert base.splits == tested.select("split_id").distinct().count() and base.tp + base.fp + base.fn + base.tn == tested.count()
    assert base.skipped_splits == learning.splits.walk_forward(learning.samples(spark, SF)).where("reason IS NOT NULL").count()
    assert got["threshold:10:6"].splits == 0 and got["experiment:e2"].feature_usage.count(":") == 6
    assert base.predicted_rate > got["balance:none"].predicted_rate  # the rarer label is drawn as often as the other


def test_equal_rows_all_count(spark, monkeypatch):
    rows = learning.samples(spark, SF)
    doubled = rows.unionByName(rows.withColumn("price", F.col("price") + 1))
    monkeypatch.setattr(learning, "samples", lambda *_: doubled)
    test = learning.sweep(spark, SF, [learning.BASE])[2]
    n = learning.members(spark, SF).where("partition = 'test'").count()
    assert test.count() == n == test.select("split_id", "sample_id").distinct().count()


def test_selectors_try_every_size(spark, monkeypatch):
    assert models.candidate_counts(5, 0.1) == [1, 2, 3, 4, 5] and models.candidate_counts(25, 0.1) == [*range(1, 26, 3)]
    assert models.ranking([["a", "b", "c", "d"], ["a", "c"], ["c"]], ["a", "b", "c", "d"]) == ["c", "a", "b", "d"]
    rng = random.Random(3)
    rows = [(float(y), *((y + 0.1 * rng.random()) if i < 3 and rng.random() < 0.9 else rng.random() for i in range(5)), 1.0) for y in (0, 1) for _ in range(60)]
    names = ["a", "b", "c", "d", "e", "same"]
    df = spark.createDataFrame(rows, f"label double, {', '.join(f'{c} double' for c in names)}").coalesce(1)
    assert models.select_features(df, df, names, method="variance_threshold") == names[:5]
    dealt = models.folds(df, 3, 1).groupBy("label", "fold").count().collect()
    assert len(dealt) == 6 and sum(r["count"] for r in dealt) == 120
    monkeypatch.setattr(models, "FOREST", {"numTrees": 5})
    assert set(models.select_features(df, df, names[:5], method="rfe")) < {"a", "b", "c"}  # half of five
    tried, real = [], models.forest
    monkeypatch.setattr(models, "forest", lambda t, f, *x: tried.append(len(f)) or real(t, f, *x))
    monkeypatch.setattr(models, "validation_score", lambda rows: 1.0 if tried[-1] == 3 else 0.0)
    assert set(models.select_features(df, df, names[:5])) == {"a", "b", "c"} and set(tried) == {1, 2, 3, 4, 5}
    monkeypatch.setattr(models, "mcc", lambda rows: 1.0 if tried[-1] == 4 else 0.0)
    assert len(models.select_features(df, df, names[:5], method="rfecv")) == 4


@pytest.mark.parametrize("name", list(models.SPACE))
def test_search_tries_the_whole_grid_once(monkeypatch, name):
    tried = []
    monkeypatch.setattr(models, "fit_and_score", lambda *_, **p: tried.append(p) or len(tried))
    monkeypatch.setattr(models, "validation_score", lambda n: float(n == 3))
    best, score = models.search(name, None, None, [])
    grid = math.prod(map(len, models.SPACE[name].values()))
    assert len(tried) == len({str(p) for p in tried}) == min(10, grid) and (best, score) == (tried[2], 1.0)


def test_temporal_parts_read_a_stored_table(spark):
    """Each fit scans its rows several times: the join behind them is made once."""
    for part in learning.temporal(spark, SF):
        assert part.inputFiles() and all("/stored-" in f for f in part.inputFiles())


def test_selectors_share_forests(spark, monkeypatch):
    """a forest over the same rows and features is fitted once for all selectors, which choose what they chose."""
    rng = random.Random(4)
    rows = [(float(y), *(y * (0.9 - 0.4 * i) + rng.random() for i in range(3))) for y in (0, 1) for _ in range(40)]
    df = spark.createDataFrame(rows, "label double, a double, b double, c double").coalesce(1).cache()
    monkeypatch.setattr(models, "FOREST", {"numTrees": 2, "maxDepth": 2})
    made, real = [], models.MODELS["random_forest"]
    monkeypatch.setitem(models.MODELS, "random_forest", lambda *a, **k: made.append(1) or real(*a, **k))
    methods = [m for m in models.SELECTORS if m != "variance_threshold"]
    alone = [models.select_features(df, df, ["a", "b", "c"], method=m) for m in methods]
    many, fits = len(made), {}
    assert [models.select_features(df, df, ["a", "b", "c"], method=m, fits=fits) for m in methods] == alone
    assert len(made) - many == 3 * 3 + 3 < many
