"""Running states, medians of prefixes, fits without members, and correlations by sums of pairs, against brute force."""

import random
from statistics import mean, median, pstdev

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import moments, prep, profile, ranks, splits


def test_running_states_far_from_zero(spark):
    rng = random.Random(2)
    rows = [(k, i, [1e9 + rng.randrange(2) for _ in range(rng.randrange(4))]) for k, n in (("hot", 300), ("b", 7), ("c", 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "k string, i int, v array<double>").select("k", "i", F.explode_outer("v").alias("v"))
    states = df.groupBy("k", "i").agg(moments.state(F.col("v")).alias("s"))
    got = {(r.k, r.i): r.s for r in moments.running_states(states, ["k"], "i", ["s"]).collect()}
    for key in ("hot", "b", "c"):
        so_far = []
        for _, i, values in (r for r in rows if r[0] == key):
            so_far += values
            s = got[key, i]
            assert s.n == len(so_far)
            if so_far:
                assert (s.low, s.high) == (min(so_far), max(so_far)) and s.mean == pytest.approx(mean(so_far), abs=1e-6)
                assert (s.m2 / s.n) ** 0.5 == pytest.approx(pstdev(so_far), abs=1e-6)


@pytest.mark.parametrize("distinct", [1, 5, 700])
def test_order_of_prefixes(spark, distinct):
    """Ties, places with several values, one key with most rows, questions before and between places."""
    rng = random.Random(distinct)
    values = [(rng.choice("aaab"), rng.randrange(40), float(rng.randrange(distinct)) - 3) for _ in range(1500)] + [(None, 1, 2.0), (None, 2, 1.0)]
    asked, want = [], {}
    for k in ("a", "b", None):
        for at in range(0, 41, 2):
            held = sorted(v for key, i, v in values if key == k and i <= at)
            for place in {0, len(held) // 2, len(held) - 1} if held else ():
                asked.append((k, at, place, f"{k}{at}/{place}"))
                want[f"{k}{at}/{place}"] = held[place]
    found = ranks.prefix_order(spark.createDataFrame(values, "k string, i int, v double"), spark.createDataFrame(asked, "k string, i int, place long, name string"), ["k"], "i", "v", "place")
    rows = found.collect()
    assert {r.name: r.v for r in rows} == want and len(rows) == len(asked)


def test_fits_from_prefixes_equal_fits_of_members(spark):
    rng = random.Random(6)
    rows = []
    for repo, n in (("r", 30), ("s", 5), ("t", 2)):
        for c in range(n):
            for f in range(rng.randrange(1, 5)):
                rows.append((repo, f"{repo}{c}", f"f{f}", c, rng.randrange(2), None if rng.random() < 0.3 else 1e9 + rng.randrange(2), None if repo == "s" else rng.random(), 3.0, float("inf")))
    names = ["far", "some", "same", "never"]
    df = spark.createDataFrame(rows, "repository string, commit string, filepath string, t int, label int, far double, some double, same double, never double").withColumn("committed_at", F.timestamp_seconds("t"))
    train = splits.members(df, splits.walk_forward(df)).where("partition = 'train'")
    want = {(r.split_id, r.feature): r for r in prep.fitted(prep.long_features(train, names, ["split_id"])).collect()}
    got = {(r.split_id, r.feature): r for r in prep.prefix_fitted(df, names).collect()}
    assert got.keys() == want.keys() and len(got) > 40
    for key, r in got.items():
        w = want[key]
        assert (r.median, r.low, r.high, r.reason) == (w.median, w.low, w.high, w.reason), key
        for a, b in ((r.mean, w.mean), (r.std, w.std)):
            assert (a is None) == (b is None) and (a is None or a == pytest.approx(b, rel=1e-12, abs=1e-6)), key
    members = train.select("split_id", "far").collect()
    for (split, feature), r in got.items():
        if feature == "far" and r.reason is None:
            held = [x.far for x in members if x.split_id == split]
            full = [median([v for v in held if v is not None]) if v is None else v for v in held]
            assert r.std == pytest.approx(pstdev(full), abs=1e-6)


def test_bayes_far_from_zero(spark):
    """Scores do not depend on where zero is."""
    rng = random.Random(9)
    base = [("r", f"c{c}", c, (y := rng.randrange(2)), float(y * 2 + rng.randrange(4))) for c in range(60) for _ in range(3)]
    scores = []
    for offset in (0.0, 1e9):
        df = spark.createDataFrame([(a, b, c, y, x + offset) for a, b, c, y, x in base], "repository string, commit string, t int, label int, x double").withColumn("committed_at", F.timestamp_seconds("t"))
        rows = prep.prefix_bayes(df, ["x"]).collect()
        scores.append(sorted((r.split_id, r.label, round(r.y_score, 6)) for r in rows))
        ranked = prep.ranked_bayes(df.withColumn("split_id", F.lit("s")), ["x"], ["split_id"]).first().ranked[0]
        assert ranked.std == pytest.approx(pstdev(x for *_, x in base), abs=1e-6)
    assert scores[0] == scores[1]


def test_correlations_of_gaps(spark):
    """Several patterns of missing values, ties, a constant, a column without values."""
    rng = np.random.default_rng(4)
    n = 400
    x = rng.integers(0, 9, n).astype(float)
    data = pd.DataFrame({"a": x, "b": x + rng.integers(0, 3, n), "c": rng.normal(size=n) + 1e8, "d": -x, "e": np.full(n, 2.0), "none": np.full(n, np.nan)})
    data["f"] = data["b"].where(rng.random(n) < 0.6)
    data["g"] = data["c"].where(rng.random(n) < 0.5)
    data["h"] = data["a"].where(data["f"].notna())
    df = spark.createDataFrame([tuple(None if v != v else float(v) for v in r) for r in data.itertuples(index=False)], ", ".join(f"{c} double" for c in data.columns)).repartition(5)
    got = {(r.a, r.b): r for r in profile.correlations(df, list(data.columns)).collect()}
    assert len(got) == 36
    for (a, b), r in got.items():
        for method, value in (("pearson", r.pearson), ("spearman", r.spearman)):
            want = data[[a, b]].corr(method=method).iloc[0, 1]
            assert (want != want) if value is None else value == pytest.approx(want, abs=1e-6), (a, b, method)
        assert r.equal_ratio == pytest.approx(((data[a] == data[b]) | (data[a].isna() & data[b].isna())).mean())


@pytest.mark.parametrize("bucket", [3, 100_000])
def test_draws_of_classes(spark, monkeypatch, bucket):
    """Exact sizes, no row twice without replacement, single classes as they are, nulls as labels, the same draws again, and every row as likely."""
    monkeypatch.setattr(prep, "DRAWN_FROM", bucket)
    rows = [(k, y, f"{k}{y}{i}", i) for k, sizes in (("a", (40, 7)), ("b", (5, 5)), ("one", (6, 0)), ("c", (1, 9))) for y, n in enumerate(sizes) for i in range(n)]
    df = spark.createDataFrame([*rows, rows[0]], "split_id string, label int, sample_id string, extra int")
    under, over = (prep.balanced(df, f"random_{how}sampling") for how in ("under", "over"))
    count = lambda d: {(r.split_id, r.label): r["count"] for r in d.groupBy("split_id", "label").count().collect()}
    assert count(under) == {("a", 0): 7, ("a", 1): 7, ("b", 0): 5, ("b", 1): 5, ("one", 0): 6, ("c", 0): 1, ("c", 1): 1}
    assert count(over) == {("a", 0): 41, ("a", 1): 41, ("b", 0): 5, ("b", 1): 5, ("one", 0): 6, ("c", 0): 9, ("c", 1): 9}
    assert under.columns == over.columns == df.columns
    got = sorted(map(tuple, under.collect()))
    assert len(got) - len(set(got)) <= 1 and set(got) <= set(rows) and got == sorted(map(tuple, prep.balanced(df, "random_undersampling").collect()))
    assert {r.sample_id for r in over.collect() if r.split_id == "one"} == {f"one0{i}" for i in range(6)}
    assert prep.balanced(df.limit(0), "random_oversampling").count() == 0
    many = spark.createDataFrame([(f"s{k}", y, f"{y}{i}", i) for k in range(300) for y, n in ((0, 12), (1, 4)) for i in range(n)], "split_id string, label int, sample_id string, extra int")
    for how, mean in (("under", 300 / 3), ("over", 300)):
        drawn = {r.sample_id: r["count"] for r in prep.balanced(many, f"random_{how}sampling").where("label = 0").groupBy("sample_id").count().collect()}
        assert len(drawn) == 12 and all(abs(n - mean) < 5 * mean**0.5 for n in drawn.values())


def test_equal_values_over_commits_have_no_deviation(spark):
    """0.05 three times has a mean of its own beside 0.05; features of one value get the deviation 1."""
    rows = [("r", f"c{c}", c, (i + c) % 2, 0.05) for c, n in enumerate((3, 1, 2, 2, 2)) for i in range(n)]
    df = spark.createDataFrame(rows, "repository string, commit string, committed_at int, label int, x double")
    got = prep.prefix_fitted(df, ["x"]).collect()
    assert got and all((f["std"], f["mean"], f.reason) == (1.0, 0.05, "zero_variance") for f in got)


def split_rows(spark):
    """Repositories of many commits, few and one; equal times, missing commits, values that are missing or not finite."""
    rng = random.Random(16)
    rows = []
    for repo, n in (("r", 30), ("s", 6), ("t", 1), (None, 5)):
        for c in range(n):
            for _ in range(rng.randrange(1, 5)):
                rows.append((repo, None if rng.random() < 0.03 else f"{repo}{c}", c // 2, rng.randrange(2), None if rng.random() < 0.3 else 1e9 + rng.randrange(3), None if repo == "s" else rng.random(), 3.0, float("nan")))
    return spark.createDataFrame(rows, "repository string, commit string, t int, label int, far double, some double, same double, never double").withColumn("committed_at", F.timestamp_seconds("t"))


@pytest.mark.parametrize(("how", "gathered"), [("minmax", 100_000), ("standard", 20)])
def test_scaled_prefixes_equal_scaled_members(spark, monkeypatch, how, gathered):
    """Whether a repository is put in one row or not."""
    monkeypatch.setattr(prep, "GATHERED", gathered)
    names, df = ["far", "some", "same", "never"], split_rows(spark)
    members = splits.members(df, splits.walk_forward(df))
    of = lambda part: prep.long_features(members.where(F.col("partition") == part), names, ["split_id"])
    want = sorted(map(tuple, prep.transformed(of("test"), prep.fitted(of("train")), how).collect()))
    got = sorted(map(tuple, prep.prefix_scaled(df, names, how).collect()))
    assert [x[:2] for x in got] == [x[:2] for x in want] and len(got) > 20
    assert [x[2] for x in got] == pytest.approx([x[2] for x in want], abs=1e-6)


def test_fits_of_gathered_rows_are_shuffled_once(spark):
    """No level of a tree of ranks, and no row of a feature, is written for repositories that fit in one row."""
    df = split_rows(spark)
    plan = prep.prefix_fitted(df, ["far", "some"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(repository") <= 4 and "rangepartitioning" not in plan


def test_leakage_copies_no_row_and_counts_null_keys(spark):
    rows = [("r", "f", "a", 1), ("r", "f", "b", 1), ("r", "f", "b", 0), ("r", "f", None, 0), ("r", "g", "a", 0), (None, "f", "x", 0), (None, "f", "y", 0), ("s", None, "z", None)]
    out = profile.leakage(spark.createDataFrame(rows, "repository string, filepath string, commit string, label int"))
    r = out.first()
    assert (r.files_in_several_commits, r.rows_affected, r.positives_affected) == (2, 6, 2)
    assert (r.files_in_several_commits_label_0, r.files_in_several_commits_label_1) == (1, 1)
    assert (r.repositories_of_several_commits, r.rows_in_them) == (2, 7)
    assert "Expand" not in out._jdf.queryExecution().executedPlan().toString()


def history(far=0.0):
    """Repositories of few and of many commits, commits of one time and of several rows, rows without a commit."""
    rng = random.Random(13)
    rows = [(r, f"{r}{c:02d}", c // 2, rng.randrange(2), far + rng.randrange(5), rng.random()) for r, n in (("p", 25), ("q", 9), ("r", 2)) for c in range(n) for _ in range(rng.randrange(1, 5))]
    return rows + [("p", None, 3, 1, far + 400.0, 0.5)]


def test_rows_after_their_training_rows(spark, monkeypatch):
    """A repository is ordered once: no running state is stored, and what is fitted is what members() give."""
    df = spark.createDataFrame(history(1e9), "repository string, commit string, t int, label int, x double, y double").withColumn("committed_at", F.timestamp_seconds("t"))
    members = splits.members(df, splits.walk_forward(df)).toPandas()
    want = []
    for split, rows in members.groupby("split_id"):
        train, test = rows[rows.partition == "train"], rows[rows.partition == "test"]
        by = [train[train.label == k] for k in (0, 1)]
        eps = 1e-9 * max(train[f].var(ddof=0) for f in "xy")
        for _, row in test.iterrows():
            odds = np.log(len(by[1]) / len(by[0]))
            for f in "xy":
                m, v = [b[f].mean() for b in by], [b[f].var(ddof=0) + eps for b in by]
                odds += 0.5 * (np.log(v[0]) - np.log(v[1]) + (row[f] - m[0]) ** 2 / v[0] - (row[f] - m[1]) ** 2 / v[1])
            want.append((split, int(row.label), odds))
    score = lambda odds: 0.0 if odds < -700 else 1 / (1 + np.exp(-odds))
    want = sorted((a, b, score(c)) for a, b, c in want)

    def check(rows):
        got = sorted((r.split_id, r.label, r.y_score) for r in rows)
        assert [g[:2] for g in got] == [w[:2] for w in want] and len(got) > 20
        assert [g[2] for g in got] == pytest.approx([w[2] for w in want], abs=1e-6)

    with monkeypatch.context() as m:
        m.setattr(moments, "running_states", None)
        check(prep.prefix_bayes(df, ["x", "y"]).collect())
    named = df.where("commit IS NOT NULL")  # running states know no row without a commit
    members = splits.members(named, splits.walk_forward(named))
    once = sorted((r.split_id, r.label, r.y_score) for r in prep.prefix_bayes(named, ["x", "y"]).collect())
    monkeypatch.setattr(prep, "GATHERED", 40)  # p has more
    mixed = sorted((r.split_id, r.label, r.y_score) for r in prep.prefix_bayes(named, ["x", "y"]).collect())
    assert len(once) == members.where("partition = 'test'").count() and [x[:2] for x in mixed] == [x[:2] for x in once]
    assert [x[2] for x in mixed] == pytest.approx([x[2] for x in once], abs=1e-6)


@pytest.mark.parametrize("few", [0, 50_000])
def test_ranks_are_looked_up_by_value(spark, monkeypatch, few):
    """Columns are ranked by their distinct values, not in a row for each row and column, by broadcast or by shuffle."""
    rng = random.Random(8)
    data = pd.DataFrame([(float(rng.randrange(4)), rng.choice([None, 0.5, -0.0, 0.0, 2.5]), rng.random() if rng.random() < 0.7 else None) for _ in range(300)], columns=list("abc"))
    df = spark.createDataFrame([tuple(None if v != v else v for v in r) for r in data.itertuples(index=False)], "a double, b double, c double")
    monkeypatch.setattr(profile, "FEW", few)
    monkeypatch.setattr(profile, "average_rank", None, raising=False)
    got = {(r.a, r.b): r for r in profile.correlations(df, list("abc")).collect()}
    assert len(got) == 3
    for (a, b), r in got.items():
        for method in ("pearson", "spearman"):
            assert r[method] == pytest.approx(data[[a, b]].corr(method=method).iloc[0, 1], abs=1e-9), (a, b, method)
