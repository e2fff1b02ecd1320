"""The full benchmark's reports against SQL over the same table of predictions."""

import random

import duckdb
import pytest

from tidemark.operators import evaluate
from tidemark.plans.learning_queries import metrics_sql

COLUMNS = ["system", "repository", "split_id", "y_true", "y_score", "y_pred"]


@pytest.fixture(scope="module")
def reports(spark):
    rng, rows = random.Random(11), []
    for r in "uvw":
        for k in range(6):
            for system, skill in (("a", 0.2), ("b", 0.4), ("c", 0.0)):
                if system == "c" and k % 2:
                    continue  # splits that one system lacks
                for i in range(rng.randint(1, 9)):
                    y = i % 2
                    score = float(round(min(rng.random() * 0.8 + skill * y, 1.0), 1))
                    rows.append((system, r, f"{r}{k}", y, score, int(score >= 0.5)))
    df = spark.createDataFrame(rows, "system string, repository string, split_id string, y_true int, y_score double, y_pred int")
    found = evaluate.levels(df).cache()
    con = duckdb.connect()
    con.execute("CREATE TABLE pred (system VARCHAR, repository VARCHAR, split_id VARCHAR, y_true INTEGER, y_score DOUBLE, y_pred INTEGER)")
    con.executemany("INSERT INTO pred VALUES (?, ?, ?, ?, ?, ?)", rows)
    return found, evaluate.comparisons(found).collect(), con


def test_levels_are_the_sql(reports):
    found, _, con = reports
    names = ["tp", "fp", "fn", "tn", *evaluate.NAMES]
    for level, part in (("pooled", "''"), ("repository", "repository"), ("split", "split_id")):
        source = f"lv AS (SELECT system, {part} AS part, y_true, y_score, y_pred FROM pred), {metrics_sql('system, part', 'lv')}"
        want = {r[:2]: r[2:] for r in con.sql(f"WITH {source} SELECT system, part, {', '.join(names)} FROM met").fetchall()}
        got = {(r.system, r.part): tuple(r[n] for n in names) for r in found.where(f"level = '{level}'").collect()}
        assert set(got) == set(want)
        for key, row in want.items():
            assert got[key] == pytest.approx(row, abs=1e-9), (level, key)


def test_comparisons_are_the_sql(reports):
    _, got, con = reports
    lines = " UNION ALL ".join(f"SELECT system, split_id, '{m}' AS metric, round({m}, 9) AS v FROM met" for m in evaluate.NAMES)
    sql = f"""WITH {metrics_sql('system, split_id')}, l AS ({lines}) SELECT x.metric, x.system, y.system, count(*), avg(x.v), avg(y.v), avg(y.v - x.v), count(*) FILTER (y.v > x.v), count(*) FILTER (y.v = x.v), count(*) FILTER (y.v < x.v)
      FROM l x JOIN l y ON x.split_id = y.split_id AND x.metric = y.metric AND x.system < y.system WHERE x.v IS NOT NULL AND y.v IS NOT NULL GROUP BY 1, 2, 3"""
    want = {r[:3]: r[3:] for r in con.sql(sql).fetchall()}
    assert {(r.metric, r.a, r.b) for r in got} == set(want) and len(got) == len(want) > 10
    for r in got:
        assert (r.n, r.mean_a, r.mean_b, r.delta, r.wins, r.ties, r.losses) == pytest.approx(want[r.metric, r.a, r.b], abs=1e-9)
        assert (r.unequal or 0) == r.wins + r.losses
        assert r.p is None or 0 <= r.p <= 1


def test_no_predictions(spark):
    found = evaluate.levels(spark.createDataFrame([], "system string, repository string, split_id string, y_true int, y_score double, y_pred int"))
    assert found.count() == 0 and evaluate.comparisons(found).count() == 0
