"""Queries over sources, audits, joins and walk-forward splits (survey ids S, F, J, W)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import audit, decisions, features, splits
from tidemark.operators.ranks import numbered_rows
from tidemark.plans.registry import SAMPLES, query, samples, table
from tidemark.shared import shared_dir
from tidemark.sources.readers import read_csv, read_inferred, text_rows, union_files, write_table

KEY = ["repository", "commit", "filepath"]
FEATURES = ["quantity", "price", "discount", "tax"]
#: An explicit order for keep-first rules: all columns.
ORDER_SQL = "quantity, price, discount, tax, label, l_partkey, l_suppkey"
DEDUPED = f"{SAMPLES}, deduped AS (SELECT * EXCLUDE (nth) FROM (SELECT *, row_number() OVER (PARTITION BY repository, commit, filepath ORDER BY {ORDER_SQL}) AS nth FROM samples) WHERE nth = 1)"


def order() -> list:
    return [F.col(c.strip()) for c in ORDER_SQL.split(",")]


def deduped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.first_of_key(samples(spark, sf_dir), KEY, order())


@query("f02_first_of_key", f"WITH {DEDUPED} SELECT repository, commit, filepath, label, quantity, price FROM deduped")
def f02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduped(spark, sf_dir).select(*KEY, "label", "quantity", "price")


@query("f02_duplicate_ledger", f"WITH {SAMPLES} SELECT repository, commit, filepath, quantity, price, 'duplicate_key' AS reason FROM (SELECT *, row_number() OVER (PARTITION BY repository, commit, filepath ORDER BY {ORDER_SQL}) AS nth FROM samples) WHERE nth > 1")
def f02_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.numbered(samples(spark, sf_dir), KEY, order()).where("_nth > 1").select(*KEY, "quantity", "price", F.lit("duplicate_key").alias("reason"))


@query("f01_a04_duplicate_groups", f"WITH {SAMPLES} SELECT repository, commit, filepath, count(*) AS duplicates FROM samples GROUP BY ALL HAVING count(*) > 1")
def a04(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = samples(spark, sf_dir)
    audit.require_columns(rows, KEY)
    return audit.duplicate_groups(rows, KEY)


STATUS_SQL = """status AS (SELECT 'c' || o_custkey AS repository, 'o' || o_orderkey AS commit, 'f' || (o_orderkey % 4 + 1) AS filepath, CASE o_orderstatus WHEN 'F' THEN 'SUCCESS' WHEN 'O' THEN 'EMPTY_GRAPH' ELSE 'TIMEOUT' END AS status, CAST(o_orderkey % 9 AS INTEGER) AS nodes, CAST(o_orderkey % 7 AS INTEGER) AS edges FROM orders)"""


def status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        "concat('c', o_custkey) AS repository", "concat('o', o_orderkey) AS commit", "concat('f', o_orderkey % 4 + 1) AS filepath", "CASE o_orderstatus WHEN 'F' THEN 'SUCCESS' WHEN 'O' THEN 'EMPTY_GRAPH' ELSE 'TIMEOUT' END AS status",
        "CAST(o_orderkey % 9 AS INT) AS nodes", "CAST(o_orderkey % 7 AS INT) AS edges",
    )


def joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples with their status, null where there is none, and the reason against each."""
    marked = status(spark, sf_dir).withColumnRenamed("status", "graph_status")
    out = deduped(spark, sf_dir).join(marked, KEY, "left")
    return out.withColumn("reason", audit.first_reason([
        (F.col("graph_status").isNull(), "missing_status"), (F.col("graph_status") == "EMPTY_GRAPH", "status_EMPTY_GRAPH"), (F.col("graph_status") == "TIMEOUT", "status_TIMEOUT"),
        (F.col("nodes") < 3, "nodes_below_minimum"), (F.col("edges") < 2, "edges_below_minimum"),
    ]))


JOINED = f"""{DEDUPED}, {STATUS_SQL}, joined AS (SELECT d.*, s.status AS graph_status, s.nodes, s.edges, CASE WHEN s.status IS NULL THEN 'missing_status' WHEN s.status <> 'SUCCESS' THEN 'status_' || s.status WHEN s.nodes < 3 THEN 'nodes_below_minimum' WHEN s.edges < 2 THEN 'edges_below_minimum' END AS reason
  FROM deduped d LEFT JOIN status s ON d.repository = s.repository AND d.commit = s.commit AND d.filepath = s.filepath)"""


@query("j01_f03_exclusion_ledger", f"WITH {JOINED} SELECT repository, commit, filepath, graph_status, reason FROM joined WHERE reason IS NOT NULL")
def f03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(spark, sf_dir).where("reason IS NOT NULL").select(*KEY, "graph_status", "reason")


@query("j02_f04_f05_kept", f"WITH {JOINED} SELECT repository, commit, filepath, nodes, edges, label FROM joined WHERE reason IS NULL")
def f04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(spark, sf_dir).where("reason IS NULL").select(*KEY, "nodes", "edges", "label")


@query("a15_funnel", f"WITH {JOINED} SELECT count(*) AS input_rows, count(*) FILTER (reason IS NULL) AS kept_rows, count(*) FILTER (reason IS NOT NULL) AS excluded_rows, count(DISTINCT (repository, commit, filepath)) AS distinct_keys, count(DISTINCT repository) FILTER (reason IS NULL) AS kept_repositories FROM joined")
def a15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.funnel(joined(spark, sf_dir), "reason", KEY)


@query("f07_f08_repository_size_filter", f"""WITH {SAMPLES}, g AS (SELECT repository, CASE WHEN o_custkey % 6 = 0 THEN 'FAILED' ELSE 'SUCCESS' END AS status, count(*) AS n, sum(label)::BIGINT AS pos, count(DISTINCT commit) AS tags FROM samples GROUP BY 1, 2)
SELECT repository, status, n, pos, tags, array_to_string(list_filter([CASE WHEN status <> 'SUCCESS' THEN 'status_not_success' END, CASE WHEN n < 40 THEN 'rows' END, CASE WHEN pos < 10 THEN 'positives' END, CASE WHEN n - pos < 10 THEN 'negatives' END, CASE WHEN tags < 2 THEN 'tags' END], lambda x: x IS NOT NULL), ';') AS reasons FROM g""")
def f07(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.when(F.col("o_custkey") % 6 == 0, "FAILED").otherwise("SUCCESS")
    g = samples(spark, sf_dir).groupBy("repository", state.alias("status")).agg(F.count("*").alias("n"), F.sum("label").cast("long").alias("pos"), F.countDistinct("commit").alias("tags"))
    return decisions.size_reasons(g, rows=40, positives=10, negatives=10, tags=2)


@query("s03_repo_list", """WITH l AS (SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN '# note' WHEN c_custkey % 10 = 1 THEN '   ' WHEN c_custkey % 10 < 5 THEN 'url' || (c_custkey % 300) ELSE 'url' || (c_custkey % 300) || ', b' || (c_custkey % 2) END AS line FROM customer),
p AS (SELECT c_custkey, trim(string_split(line, ',')[1]) AS url, coalesce(nullif(trim(string_split(line, ',')[2]), ''), 'master') AS branch FROM l WHERE NOT regexp_matches(line, '^\\s*(#|$)'))
SELECT url, branch, min(c_custkey) AS first_line FROM p GROUP BY 1, 2""".replace("\\\\", "\\"))
def s03(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    url = F.concat(F.lit("url"), k % 300)
    line = F.when(k % 10 == 0, "# note").when(k % 10 == 1, "   ").when(k % 10 < 5, url).otherwise(F.concat(url, F.lit(", b"), k % 2))
    from tidemark.sources.readers import repo_list

    return repo_list(table(spark, sf_dir, "customer").select(k.alias("at"), line.alias("value"))).withColumnRenamed("at", "first_line")


@query("s04_typed_load", f"""WITH {SAMPLES}, r AS (SELECT repository, commit, filepath, CASE WHEN l_suppkey % 9 = 0 THEN 'x' ELSE CAST(label AS VARCHAR) END AS label, CASE WHEN l_partkey % 8 = 0 THEN 'bad' ELSE strftime(committed_at, '%Y-%m-%d %H:%M:%S') END AS said FROM samples)
SELECT repository || '::' || commit || '::' || filepath AS sample_id, coalesce(CAST(TRY_CAST(label AS DOUBLE) AS INTEGER), 0) AS label, TRY_CAST(said AS TIMESTAMP) AS committed_at FROM r WHERE TRY_CAST(said AS TIMESTAMP) IS NOT NULL""")
def s04(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.sources.readers import typed_samples

    raw = samples(spark, sf_dir).select(*KEY, F.when(F.col("l_suppkey") % 9 == 0, "x").otherwise(F.col("label").cast("string")).alias("label"), F.when(F.col("l_partkey") % 8 == 0, "bad").otherwise(F.date_format("committed_at", "yyyy-MM-dd HH:mm:ss")).alias("committed_at"))
    return typed_samples(raw).select("sample_id", "label", "committed_at")


@query("s04_w06_first_repositories", f"WITH {SAMPLES}, f AS (SELECT repository, min(o_orderkey) AS first FROM samples GROUP BY 1 ORDER BY 2, 1 LIMIT 50) SELECT s.repository, commit, filepath, quantity, price FROM samples s JOIN f ON s.repository = f.repository")
def s04_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = samples(spark, sf_dir)
    first = rows.groupBy("repository").agg(F.min("o_orderkey").alias("first")).orderBy("first", "repository").limit(50)
    return rows.join(first.select("repository"), "repository", "left_semi").select(*KEY, "quantity", "price")


@query("s08_s09_w08_union", "SELECT l_orderkey AS id, l_quantity AS value, 'lineitem' AS run, l_tax AS extra FROM lineitem UNION ALL SELECT o_orderkey, o_totalprice, 'orders', NULL FROM orders")
def s08(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_quantity").alias("value"), F.lit("lineitem").alias("run"), F.col("l_tax").alias("extra"))
    b = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("value"), F.lit("orders").alias("run"))
    return a.unionByName(b, allowMissingColumns=True)


@query("s10_path_candidates", """WITH f AS (SELECT CASE o_orderkey % 3 WHEN 0 THEN '/data/g' || o_orderkey || '.xml' WHEN 1 THEN '/base/x/g' || o_orderkey || '.xml' ELSE '/base/g' || o_orderkey || '.xml' END AS file FROM orders WHERE o_orderstatus <> 'P'),
r AS (SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN '/data/g' || o_orderkey || '.xml' WHEN 1 THEN '/app/output/x/g' || o_orderkey || '.xml' WHEN 2 THEN 'x' || chr(92) || 'g' || o_orderkey || '.xml' ELSE '' END AS path FROM orders),
k AS (SELECT id, path, unnest([1, 2, 3, 4]) AS place, unnest([path, CASE WHEN contains(path, '/app/output/') THEN '/base/' || string_split(path, '/app/output/')[2] END, '/base/g' || id || '.xml', CASE WHEN path LIKE 'x%' THEN '/base/' || replace(path, chr(92), '/') END]) AS file FROM r WHERE path <> ''),
h AS (SELECT id, min_by(file, place) AS found FROM k JOIN f USING (file) GROUP BY 1) SELECT r.id, r.path, h.found FROM r LEFT JOIN h USING (id)""")
def s10(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    name = F.concat(F.lit("g"), k, F.lit(".xml"))
    files = orders.where("o_orderstatus <> 'P'").select(F.when(k % 3 == 0, F.concat(F.lit("/data/"), name)).when(k % 3 == 1, F.concat(F.lit("/base/x/"), name)).otherwise(F.concat(F.lit("/base/"), name)).alias("file"))
    rows = orders.select(k.alias("id"), F.when(k % 4 == 0, F.concat(F.lit("/data/"), name)).when(k % 4 == 1, F.concat(F.lit("/app/output/x/"), name)).when(k % 4 == 2, F.concat(F.lit("x\\"), name)).otherwise("").alias("path"))
    return decisions.resolved_paths(rows, files, "/base").select("id", "path", "found")


def written(df: DataFrame, name: str) -> str:
    """df as headed CSV in a new folder of the shared one."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    write_table(df, path, fmt="csv")
    return path


@query("s01_s11_csv_round_trip", f"WITH {SAMPLES} SELECT repository, commit, filepath, label, quantity, price, l_partkey FROM samples")
def s01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample table written as CSV by the guarded sink and scanned under its schema."""
    rows = samples(spark, sf_dir).select(*KEY, "label", "quantity", "price", "l_partkey")
    return read_csv(spark, written(rows, "samples"), rows.schema)


@query("s01_inferred_types", f"""WITH {SAMPLES} SELECT repository, commit, filepath, label::BIGINT AS label, quantity, CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE price END AS price, committed_at::TIMESTAMP AS committed_at, l_partkey % 2 = 0 AS flag,
  CASE WHEN l_linenumber = 1 THEN 'x' ELSE CAST(l_partkey AS VARCHAR) END AS mixed, CASE WHEN l_linenumber = 1 THEN l_partkey + 0.5 ELSE l_partkey END::DOUBLE AS wide, NULL::DOUBLE AS empty FROM samples""")
def s01_inferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample table as CSV without a schema: whole numbers, doubles with gaps, times, mixed and empty columns."""
    part, first = F.col("l_partkey"), F.col("l_linenumber") == 1
    rows = samples(spark, sf_dir).select(
        *KEY, "label", "quantity", F.when(part % 3 != 0, F.col("price")).alias("price"), F.date_format("committed_at", "yyyy-MM-dd HH:mm:ss").alias("committed_at"), (part % 2 == 0).alias("flag"),
        F.when(first, "x").otherwise(part.cast("string")).alias("mixed"), F.when(first, (part + 0.5).cast("string")).otherwise(part.cast("string")).alias("wide"), F.lit("NA").alias("empty"),
    )
    return read_inferred(spark, written(rows, "inferred"))


@query("s02_text_rows", "SELECT row_number() OVER (ORDER BY lpad(CAST(o_orderkey AS VARCHAR), 12, '0')) AS row_index, lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS id, o_orderstatus AS status, CAST(o_custkey AS VARCHAR) AS customer FROM orders ORDER BY 1 LIMIT 500")
def s02(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows of a CSV file that starts with a byte-order mark, all columns text."""
    rows = table(spark, sf_dir, "orders").select(F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("\ufeffid"), F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("customer"))
    return text_rows(spark, written(rows, "text"), ["id"], limit=500)


@query("s08_union_of_files", "SELECT 'run_' || lower(o_orderstatus) AS run, CAST(o_orderkey AS VARCHAR) AS id, CAST(o_custkey AS VARCHAR) AS customer FROM orders")
def s08_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders")
    return union_files(spark, {f"run_{x.lower()}": written(rows.where(F.col("o_orderstatus") == x).select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("customer")), "run") for x in "FOP"})


@query("s14_ordered_rebuild", f"WITH {DEDUPED}, {STATUS_SQL}, n AS (SELECT *, row_number() OVER (ORDER BY repository, commit, filepath) AS row_index FROM deduped) SELECT row_index, n.repository, n.commit, n.filepath, s.status FROM n JOIN status s ON n.repository = s.repository AND n.commit = s.commit AND n.filepath = s.filepath WHERE s.status = 'SUCCESS'")
def s14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After a resume: results in the order of the input rows, those that succeeded."""
    return audit.rebuilt(numbered_rows(deduped(spark, sf_dir), KEY), status(spark, sf_dir), KEY, "row_index").where("status = 'SUCCESS'").select("row_index", *KEY, "status")


VALID_SQL = "CASE WHEN coalesce(nodes < 3, true) THEN 'below_min_nodes_3' WHEN coalesce(edges < 2, true) THEN 'below_min_edges_2' WHEN l_partkey % 3 = 0 THEN 'missing_metric' WHEN l_suppkey % 5 = 0 OR graph_status IS NULL THEN 'graph_path_missing' END"


@query("f05_common_valid_samples", f"WITH {JOINED} SELECT repository, commit, filepath, {VALID_SQL} AS reason FROM joined")
def f05(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = joined(spark, sf_dir).withColumn("metric", F.when(F.col("l_partkey") % 3 != 0, F.col("price")))
    known = (F.col("l_suppkey") % 5 != 0) & F.col("graph_status").isNotNull()
    return rows.select(*KEY, decisions.valid_sample_reason(["price", "metric"], known).alias("reason"))


_F10 = {"additions": "l_quantity", "lines_code": "l_partkey", "num_tasks": "l_linenumber", "delta_tax": "l_tax", "delta_discount": "l_discount", "other_number": "l_suppkey", "verticesCount": "l_partkey % 9", "globalInput": "l_partkey % 7", "nodes": "l_suppkey % 9"}
_F10_FAMILY = {"additions": "process", "lines_code": "product", "num_tasks": "iac_oriented", "delta_tax": "delta", "delta_discount": "delta", "other_number": "unmapped", "verticesCount": "graph", "globalInput": "graph"}


@query("f10_feature_families", " UNION ALL ".join(f"SELECT '{f}' AS feature, '{family}' AS family, {'true' if f != 'globalInput' else 'false'} AS in_top4_run, count({_F10[f]}) AS there, round(avg({_F10[f]}), 6) AS mean FROM lineitem" for f, family in _F10_FAMILY.items()))
def f10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which columns of a wide table are features, of which family, and what they hold. Two columns hold no number, one is an id."""
    wide = table(spark, sf_dir, "lineitem").selectExpr(*(f"{x} AS {c}" for c, x in _F10.items()), "l_returnflag AS num_plays", "CAST(NULL AS DOUBLE) AS deletions", "l_orderkey AS commit", "1 AS failure_prone")
    numeric = features.numeric_columns(wide)
    named = [(c, family) for family in ("process", "product", "iac", "delta") for c in features.family(numeric, family)]
    named = [(c, features.ALIASES[f]) for c, f in named] + [(c, "unmapped") for c in features.unmapped(numeric)] + [(c, "graph") for c in features.graph_metrics() if c in numeric]
    top4 = features.combined_features(numeric, "top4")
    grid = spark.createDataFrame([(c, f, c in top4) for c, f in named], "feature string, family string, in_top4_run boolean")
    values = wide.select(*(F.col(c).cast("double").alias(c) for c, _ in named)).unpivot([], [c for c, _ in named], "feature", "value")
    return values.groupBy("feature").agg(F.count("value").alias("there"), F.round(F.avg("value"), 6).alias("mean")).join(F.broadcast(grid), "feature").select("feature", "family", "in_top4_run", "there", "mean")


@query("w08_repositories_without_graph", f"WITH {JOINED} SELECT DISTINCT repository FROM joined EXCEPT SELECT repository FROM joined WHERE reason IS NULL")
def w08(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = joined(spark, sf_dir)
    return rows.select("repository").subtract(rows.where("reason IS NULL").select("repository"))


@query("s12_upsert", "SELECT o_orderkey AS id, o_totalprice AS value FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45) UNION ALL SELECT l_orderkey, max(l_extendedprice) FROM lineitem WHERE l_quantity > 45 GROUP BY 1")
def s12(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("value"))
    new = table(spark, sf_dir, "lineitem").where("l_quantity > 45").groupBy(F.col("l_orderkey").alias("id")).agg(F.max("l_extendedprice").alias("value"))
    return audit.upsert(old, new, ["id"])


@query("s13_s14_resume", f"WITH {DEDUPED}, {STATUS_SQL} SELECT d.repository, d.commit, d.filepath FROM deduped d WHERE NOT EXISTS (SELECT 1 FROM status s WHERE s.repository = d.repository AND s.commit = d.commit AND s.filepath = d.filepath AND s.status IN ('SUCCESS', 'EMPTY_GRAPH'))")
def s13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.pending(deduped(spark, sf_dir), status(spark, sf_dir), KEY, ["SUCCESS", "EMPTY_GRAPH"]).select(*KEY)


@query("j03_semi_anti", "SELECT o_custkey, count(*) FILTER (o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')) AS with_return, count(*) FILTER (o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')) AS without FROM orders GROUP BY 1")
def j03(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, back = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    semi, anti = orders.join(back, "o_orderkey", "left_semi"), orders.join(back, "o_orderkey", "left_anti")
    both = semi.select("o_custkey", F.lit(1).alias("y"), F.lit(0).alias("n")).unionByName(anti.select("o_custkey", F.lit(0).alias("y"), F.lit(1).alias("n")))
    return both.groupBy("o_custkey").agg(F.sum("y").alias("with_return"), F.sum("n").alias("without"))


@query("w07_group_order", "SELECT o_orderkey, min(o_orderkey) OVER (PARTITION BY coalesce(CASE WHEN o_custkey % 5 > 0 THEN 'c' || o_custkey END, 'missing::row-' || o_orderkey)) AS group_first FROM orders")
def w07(spark: SparkSession, sf_dir: str) -> DataFrame:
    repo = F.when(F.col("o_custkey") % 5 > 0, F.concat(F.lit("c"), "o_custkey"))
    group = F.coalesce(repo, F.concat(F.lit("missing::row-"), "o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.min("o_orderkey").over(Window.partitionBy(group)).alias("group_first"))


@query("w04_keep_last", "SELECT user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def w04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.first_of_key(table(spark, sf_dir, "events"), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "value")


@query("w03_average_rank", "SELECT event_id, rank() OVER (PARTITION BY event_type ORDER BY round(value, 0)) + (count(*) OVER (PARTITION BY event_type, round(value, 0)) - 1) / 2.0::DOUBLE AS avg_rank FROM events")
def w03(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.operators.ranks import average_rank

    rows = table(spark, sf_dir, "events").select("event_id", "event_type", F.round("value", 0).alias("v"))
    return average_rank(rows, ["event_type"], "v", "avg_rank").select("event_id", "avg_rank")


WALK = f"""{SAMPLES}, c0 AS (SELECT repository, commit, min(committed_at) AS said, count(*) AS n, sum(label) AS pos FROM samples GROUP BY 1, 2),
c AS (SELECT *, row_number() OVER w - 1 AS idx, sum(n) OVER w AS nu, sum(pos) OVER w AS pu, count(*) OVER (PARTITION BY repository) AS commits FROM c0 WINDOW w AS (PARTITION BY repository ORDER BY said, commit)),
t AS (SELECT *, CASE WHEN greatest(round_even(idx * 0.2, 0), 1) >= idx THEN 1 ELSE greatest(round_even(idx * 0.2, 0), 1) END::INTEGER AS val_count FROM c WHERE commits >= 3 AND idx >= 2),
wf AS (SELECT t.repository, t.idx AS test_idx, t.commit AS test_commit, val_count, coalesce(l.nu, 0) AS train_size, t.nu - t.n - coalesce(l.nu, 0) AS val_size, t.n AS test_size,
  CASE WHEN coalesce(l.nu, 0) = 0 THEN 'empty_partition' WHEN l.pu = 0 OR l.pu = l.nu THEN 'train_single_class' WHEN t.pos = 0 OR t.pos = t.n THEN 'test_single_class' END AS reason FROM t LEFT JOIN c l ON l.repository = t.repository AND l.idx = t.idx - val_count - 1
  UNION ALL SELECT DISTINCT repository, NULL, NULL, NULL, NULL, NULL, NULL, 'too_few_commits' FROM c WHERE commits < 3)"""


@query("w1_walk_forward", f"WITH {WALK} SELECT repository, test_idx::INTEGER AS test_idx, test_commit, val_count, train_size::BIGINT AS train_size, val_size::BIGINT AS val_size, test_size::BIGINT AS test_size, reason FROM wf")
def w1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.walk_forward(samples(spark, sf_dir))


@query("w1_capped", f"WITH {WALK} SELECT repository, test_idx::INTEGER AS test_idx, test_commit FROM wf WHERE reason IS NULL ORDER BY repository, test_idx LIMIT 200")
def w1_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.capped(splits.walk_forward(samples(spark, sf_dir)), 200).select("repository", "test_idx", "test_commit")


MEMBERS = f"""{WALK}, m AS (SELECT s.*, wf.repository || '__wf_' || lpad(CAST(test_idx AS VARCHAR), 4, '0') AS split_id, CASE WHEN c.idx = test_idx THEN 'test' WHEN c.idx >= test_idx - val_count THEN 'validation' ELSE 'train' END AS partition
  FROM samples s JOIN c ON s.repository = c.repository AND s.commit = c.commit JOIN wf ON wf.repository = s.repository AND wf.reason IS NULL AND c.idx <= test_idx)"""


@query("w2_j04_j06_manifest", f"WITH {MEMBERS} SELECT split_id, partition, count(*) AS n, sum(label)::BIGINT AS positives, min(committed_at) AS first_at, max(committed_at) AS last_at FROM m GROUP BY 1, 2")
def w2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.manifest(samples(spark, sf_dir))
