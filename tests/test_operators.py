"""Hand-computed cases."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalars as s
from tidemark.operators import audit, decisions, evaluate, features, graph, prep, ranks, splits
from tidemark.sources.readers import read_csv, read_dot, text_rows, union_files, write_table

DOT = """digraph {
\tnode [shape=plain]
\tstep7 [label=<<B>copy.file</B>> shape=ellipse]
\targ [label="a \\"quoted\\" word" color=red];
\targ -> step7 [label="src" weight=0.5]
\targ -> late
}"""


def test_dot_text(spark):
    nodes, edges = read_dot(spark.createDataFrame([(1, DOT)], "graph_id int, dot string"))
    labels = {r.node_id: r.attrs.get("label") for r in nodes.collect()}
    assert labels == {"step7": "<B>copy.file</B>", "arg": 'a "quoted" word', "late": None}
    assert {(r.src, r.dst, r.attrs.get("label"), r.attrs.get("weight")) for r in edges.collect()} == {("arg", "step7", "src", "0.5"), ("arg", "late", None, None)}


def test_cyclic_multigraph(spark):
    task, plain = {"label": "<B>x</B>"}, {"label": "str"}
    nodes = spark.createDataFrame([(1, n, task if n[0] == "t" else plain) for n in ("t1", "t2", "t3", "d1", "d2", "o1")], "graph_id int, node_id string, attrs map<string,string>")
    rows = [("d1", "t1", "DEF"), ("d1", "t1", "DEF"), ("t1", "t2", "ORDER"), ("t2", "t1", "ORDER"), ("t2", "o1", "DEF"), ("d2", "t3", "USE"), ("t3", "t3", "ORDER")]
    edges = spark.createDataFrame([(1, a, b, {"label": c}) for a, b, c in rows], "graph_id int, src string, dst string, attrs map<string,string>")
    adj, tasks = graph.adjacency(edges), graph.task_nodes(nodes, edges)
    assert graph.sizes(nodes, edges).first()[1:3] == (6, 7)
    assert graph.direct_fans(tasks, adj).first()[1:] == (5, 4)
    assert graph.indirect_fans(tasks, adj).first()[1:] == (1, 1)
    assert graph.global_ends(nodes, tasks, adj).first()[1:] == (2, 1)
    assert graph.lack_of_cohesion(nodes, tasks, adj).first()[1] == pytest.approx(2 / 3)
    assert graph.edge_labels(edges).first()[1:] == (3, 3, 1, 3)


def test_binary_metrics(spark):
    rows = [("a", t, sc, int(sc >= 0.5)) for t, sc in zip([1, 0, 1, 0], [0.9, 0.8, 0.8, 0.1])] + [("b", 0, 0.2, 0)] * 3
    got = {r.k: r for r in evaluate.metrics(spark.createDataFrame(rows, "k string, y_true int, y_score double, y_pred int"), ["k"]).collect()}
    a, b = got["a"], got["b"]
    assert (a.tp, a.fp, a.fn, a.tn) == (2, 1, 0, 1)
    assert [a.precision, a.recall, a.f1, a.accuracy, a.mcc, a.auc_pr, a.auc_roc] == pytest.approx([2 / 3, 1, 0.8, 0.75, 0.5773503, 5 / 6, 0.875])
    assert (b.precision, b.recall, b.f1, b.accuracy, b.mcc, b.auc_pr, b.auc_roc, b.tn) == (0, 0, 0, 1, None, None, None, 3)


def test_published_confusion_matrix(spark):
    m = evaluate.count_metrics(spark.createDataFrame([(7533, 4120, 1418, 11991)], "tp long, fp long, fn long, tn long")).first()
    assert [round(m[c], 3) for c in ("precision", "recall", "f1", "accuracy", "mcc")] == [0.646, 0.842, 0.731, 0.779, 0.563]


def samples(spark, spec):
    rows = [(r, c, f"{r}{c}{i}", i, label) for r, commits in spec.items() for i, (c, labels) in enumerate(commits) for label in labels]
    return spark.createDataFrame(rows, "repository string, commit string, filepath string, committed_at int, label int")


def test_walk_forward_reasons(spark):
    df = samples(spark, {"x": [("c0", [0, 1]), ("c1", [0]), ("c2", [0, 1]), ("c3", [1])], "y": [("c0", [0]), ("c1", [1]), ("c2", [0, 1])], "z": [("c0", [0]), ("c1", [1])]})
    wf = splits.walk_forward(df)
    assert {(r.repository, r.test_idx): r.reason for r in wf.collect()} == {("x", 2): None, ("x", 3): "test_single_class", ("y", 2): "train_single_class", ("z", None): "too_few_commits"}
    parts = {(r.partition, r.commit) for r in splits.members(df, wf).collect()}
    assert parts == {("train", "c0"), ("validation", "c1"), ("test", "c2")}


def test_validation_sizes(spark):
    df = samples(spark, {"x": [(f"c{i:02}", [0, 1]) for i in range(14)]})
    got = {r.test_idx: r.val_count for r in splits.walk_forward(df).collect()}
    assert {n: got[n] for n in (2, 3, 7, 8, 10, 13)} == {2: 1, 3: 1, 7: 1, 8: 2, 10: 2, 13: 3}


def test_balancing(spark):
    df = spark.createDataFrame([("s", y, str(i)) for i, y in enumerate([0] * 5 + [1] * 2)] + [("one", 1, "9")], "split_id string, label int, sample_id string")
    count = lambda how: {(r.split_id, r.label): r["count"] for r in prep.balanced(df, how).groupBy("split_id", "label").count().collect()}
    assert count("random_oversampling") == {("s", 0): 5, ("s", 1): 5, ("one", 1): 1}
    assert count("random_undersampling") == {("s", 0): 2, ("s", 1): 2, ("one", 1): 1}
    assert count("none") == {("s", 0): 5, ("s", 1): 2, ("one", 1): 1}


def test_picks_are_not_broadcast(spark):
    """Picks may be as many as rows, but come from a small table: a join may take them for small and send them all to the driver."""
    df = spark.range(3_000).select(F.lit("s").alias("split_id"), (F.col("id") % 3 == 0).cast("int").alias("label"), F.col("id").cast("string").alias("sample_id"))
    for how in ("random_oversampling", "random_undersampling"):
        plan = prep.balanced(df, how)._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan and "Join" not in plan


def test_fit_uses_training_rows_only(spark):
    rows = [("s", "train", 1.0), ("s", "train", None), ("s", "train", 3.0), ("s", "test", 100.0)]
    df = spark.createDataFrame([(a, b, "f", v) for a, b, v in rows], "split_id string, partition string, feature string, value double")
    fit = prep.fitted(df.where("partition = 'train'").drop("partition")).first()
    assert (fit.median, fit.mean, fit.reason) == (2.0, 2.0, None)
    assert fit["std"] == pytest.approx((2 / 3) ** 0.5)


def test_identifiers(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(s.repository_from_url(F.lit("https://github.com/a/b.git/"))) == "a/b"
    assert one(s.normalized_repository(F.lit("git@github.com:a/b.git"))) == "a/b"
    assert one(s.repository_from_url(F.lit("x\\y\\z"))) == "y/z"
    assert one(s.safe_path(F.lit("../secret.yml"))) is None
    assert one(s.safe_path(F.lit("/absolute/file.yml"))) is None
    assert one(s.safe_path(F.lit("roles/web/tasks/main.yml"))) == "roles/web/tasks/main.yml"


def test_ledger_accounts_for_every_row(spark):
    df = spark.range(10)
    kept, out = audit.ledger(df, audit.first_reason([(F.col("id") < 3, "low"), (F.col("id") > 7, "high")]))
    assert (kept.count(), {r.id: r.reason for r in out.collect()}) == (5, {0: "low", 1: "low", 2: "low", 8: "high", 9: "high"})
    with pytest.raises(ValueError):
        audit.require_columns(df, ["nope"])
    with pytest.raises(ValueError):
        audit.require_unique(df.union(df), ["id"])


def test_guarded_sink_and_text_rows(spark, tmp_path):
    df = spark.createDataFrame([("b", "x"), ("a", None), ("c", "y")], "id string, v string").withColumnRenamed("id", "\ufeffid")
    write_table(df, f"{tmp_path}/t", fmt="csv")
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        write_table(df, f"{tmp_path}/t", fmt="csv")
    write_table(df, f"{tmp_path}/t", fmt="csv", force=True)
    got = text_rows(spark, f"{tmp_path}/t", ["id"], limit=2)
    assert got.columns == ["id", "v", "row_index"] and sorted(map(tuple, got.collect())) == [("a", None, 1), ("b", "x", 2)]
    (tmp_path / "bom.csv").write_bytes(b"\xef\xbb\xbfid,v\n1,2\n")
    assert text_rows(spark, f"{tmp_path}/bom.csv", ["id"]).columns == ["id", "v", "row_index"]
    assert [tuple(r) for r in read_csv(spark, f"{tmp_path}/bom.csv", "id int, v int").collect()] == [(1, 2)]


def test_union_refuses_other_columns(spark, tmp_path):
    for name, columns in (("a", "x string, y string"), ("b", "x string, y string, z string")):
        write_table(spark.createDataFrame([("1",) * columns.count("string")], columns), f"{tmp_path}/{name}", fmt="csv")
    assert union_files(spark, {"one": f"{tmp_path}/a", "two": f"{tmp_path}/a"}).count() == 2
    with pytest.raises(ValueError, match="two has columns"):
        union_files(spark, {"one": f"{tmp_path}/a", "two": f"{tmp_path}/b"})


def test_overlap_of_partitions_raises(spark):
    rows = [("s", "train", 1), ("s", "test", 2), ("t", "test", 1)]
    df = spark.createDataFrame(rows, "split_id string, partition string, sample_id int")
    splits.require_no_overlap(df, ["sample_id"])
    with pytest.raises(ValueError):
        splits.require_no_overlap(df.union(spark.createDataFrame([("s", "validation", 1)], df.schema)), ["sample_id"])


def test_ranks_and_quantiles_by_ranges(spark):
    rng = random.Random(1)
    rows = [(None if i % 7 == 0 else f"k{i % 2}", None if i % 11 == 0 else rng.randrange(60) / 4) for i in range(600)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    want = {}
    for k in {r[0] for r in rows}:
        values = sorted((r[1] for r in rows if r[0] == k), key=lambda x: (x is not None, x or 0))
        for v in set(values):
            want[k, v] = values.index(v) + (values.count(v) + 1) / 2
    got = ranks.average_rank(df, ["k"], "v", "rank").collect()
    assert len(got) == len(rows) and all(r["rank"] == want[r.k, r.v] for r in got)
    counted = df.where("v IS NOT NULL").groupBy("k", "v").agg(F.count("*").alias("n"))
    exact = {r.k: (r.a, r.b) for r in df.groupBy("k").agg(F.percentile("v", 0.25).alias("a"), F.percentile("v", 0.9).alias("b")).collect()}
    for r in ranks.quantiles(counted, ["k"], "v", "n", {"a": 0.25, "b": 0.9}).collect():
        assert (r.a, r.b) == pytest.approx(exact[r.k])
    places = ranks.numbered_rows(spark.range(100).repartition(7), ["id"]).collect()
    assert all(r.row_index == r.id + 1 for r in places)


def test_exact_p_of_few_pairs(spark):
    # all of five differences positive: 2 / 2^5; published table: n = 6, W = 1 gives 0.0625
    rows = [("m", "a", "b", 0.0, float(d)) for d in (1, 2, 3, 4, 5)] + [("o", "a", "b", 0.0, float(d)) for d in (-1, 2, 3, 4, 5, 6)]
    got = {r.metric: (r.n, r.w, r.p) for r in evaluate.wilcoxon(spark.createDataFrame(rows, "metric string, a string, b string, x double, y double")).collect()}
    assert got["m"] == (5, 0.0, pytest.approx(0.0625)) and got["o"] == (6, 1.0, pytest.approx(0.0625))


def test_feature_families():
    numeric = ["additions", "verticesCount", "nodes", "lines_code", "delta_b", "delta_a", "other", "num_uri"]
    assert features.families(numeric) == {"process": ["additions"], "product": ["lines_code"], "iac_oriented": ["num_uri"], "delta": ["delta_a", "delta_b"]}
    assert features.unmapped(numeric) == ["other"] and features.family(numeric, " IaC-oriented ") == ["num_uri"]
    assert features.combined_features(numeric, "globalInput, nodes".split(",")[0], only_graph=True) == ["globalInput"]
    assert features.combined_features(numeric, "top5")[-1] == "globalInput" and len(features.graph_metrics()) == 11
    for bad in (lambda: features.family(numeric, "none"), lambda: features.graph_metrics("nodes")):
        with pytest.raises(ValueError):
            bad()


def test_candidates_after_an_accepted_one(spark):
    rows = [(1, "A/x", True), (2, "a/X", False), (3, "A/X", False), (4, None, False), (5, "a/x", True)]
    df = spark.createDataFrame(rows, "id int, full_name string, archived boolean").selectExpr("*", "false AS disabled", "900 AS stars", "'u' AS url", "'main' AS default_branch", "false AS tutorial", "true AS signal")
    got = {r.id: r.outcome for r in decisions.candidate_outcomes(df, "id", 500).collect()}
    assert got == {1: "archived repository", 2: "accepted", 3: "duplicate repository", 4: "missing or invalid metadata", 5: "duplicate repository"}


def test_types_take_one_aggregate_a_column(spark, monkeypatch):
    """The narrowest type of all values, missing ones aside; a form that fits ends the search."""
    from tidemark.sources import readers

    columns = {
        "whole": ["1", " +2 ", "-3"], "wide": ["1", "99999999999999999999", "2"], "num": ["1", ".5", "1e3"], "inf": ["-Inf", "1.", "infinity"], "flag": ["TRUE", "false", "NA"],
        "at": ["2020-01-02", "2020-01-02T03:04:05.5Z", "2020-01-02 03:04"], "mixed": ["1", "x", "2"], "both": ["true", "1", "0"], "none": ["NA", "", None], "bad_day": ["2020-02-31", "2020-01-01", "2020-01-01"], "day_or_number": ["2020-01-01", "2020", "1"],
    }
    want = ["bigint", "double", "double", "double", "boolean", "timestamp", "string", "string", "double", "string", "string"]
    df = spark.createDataFrame(list(zip(*columns.values(), strict=True)), ", ".join(f"{c} string" for c in columns))
    assert readers.inferred_types(df) == dict(zip(columns, want, strict=True))
    counted, count = [], readers.F.bit_and
    monkeypatch.setattr(readers.F, "bit_and", lambda c: counted.append(c) or count(c))
    readers.inferred_types(df)
    assert len(counted) == len(columns)
