"""Reachability from all starts at once against a walk on the driver, and what it writes."""

import random

import pytest

from tidemark.operators import graph


def shapes() -> dict:
    rng = random.Random(7)
    out = {
        "chain": ([("c%03d" % i, "c%03d" % (i + 1)) for i in range(300)], ["c000"]),
        "cycle": ([("c%03d" % i, "c%03d" % ((i + 1) % 200)) for i in range(200)] + [("c050", "tail"), ("tail", "end")], ["c120"]),
        "no way in": ([("a%d" % i, "a%d" % ((i + 1) % 9)) for i in range(9)] + [("a1", "s"), ("s", "t")], ["s"]),
        "ladder": ([("%s%d" % (a, i), "%s%d" % (b, i + 1)) for i in range(12) for a in "xy" for b in "xy"] + [("zero", "x7")], ["x3"]),
        "star": ([("hub", "leaf%d" % i) for i in range(300)] + [("leaf5", "hub"), ("in", "hub")], ["in", "leaf7"]),
        "loops": ([("s", "s"), ("s", "v"), ("v", "v"), ("w", "w"), ("w", "v")], ["s"]),
        "nothing": ([("p", "q")], []),
        "alone": ([("p", "q")], ["elsewhere"]),
    }
    for k in range(40):
        n = rng.randint(2, 40)
        out[f"drawn {k}"] = ([(str(rng.randrange(n)), str(rng.randrange(n))) for _ in range(rng.randint(1, 3 * n // 2))], [str(x) for x in rng.sample(range(n), rng.randint(0, 2))])
    return out


def walked(edges: list, starts: list) -> set:
    seen, front = set(starts), list(starts)
    while front:
        front = list({b for a, b in edges if a in front} - seen)
        seen |= set(front)
    return seen


@pytest.fixture(scope="module")
def spread(spark):
    given = shapes()
    edges = spark.createDataFrame([(g, a, b) for g, (rows, _) in given.items() for a, b in rows], "graph_id string, src string, dst string").distinct()
    starts = spark.createDataFrame([(g, x) for g, (_, xs) in given.items() for x in xs], "graph_id string, node_id string")
    rows, written = [], {}
    real = graph.stored

    def counting(df):
        out = real(df)
        written[out.stored_at] = out.count()
        return out

    graph.stored = counting
    try:
        rows = graph.spread(starts, edges).collect()
    finally:
        graph.stored = real
    return given, rows, list(written.values())


def test_spread_is_the_walk(spread):
    given, rows, _ = spread
    assert len(rows) == len({(r.graph_id, r.node_id) for r in rows})
    for g, (edges, starts) in given.items():
        assert {r.node_id for r in rows if r.graph_id == g} == walked(edges, starts), g


def test_spread_writes_few_rows_in_few_rounds(spread):
    given, _, written = spread
    edges = sum(len(set(e)) for e, _ in given.values())
    assert sum(written) < 12 * edges
    assert len(written) < 100  # a walk of the chain alone takes 300 rounds


def test_spread_of_nothing(spark):
    none = spark.createDataFrame([], "graph_id string, src string, dst string")
    assert graph.spread(spark.createDataFrame([("g", "a")], "graph_id string, node_id string"), none).collect() == [("g", "a")]
    assert graph.spread(spark.createDataFrame([], "graph_id string, node_id string"), none).collect() == []
