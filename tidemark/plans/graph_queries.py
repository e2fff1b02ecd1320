"""Queries over tidemark.operators.graph (survey ids G1 to G16, S5 to S7): a graph for each conversation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scalars as s
from tidemark.operators import graph
from tidemark.plans.registry import query, table
from tidemark.sources.readers import read_dot, read_graphml

# turns are nodes, assistant turns tasks; each turn leads to the next (twice every third), the last back to the first
# in every other conversation, and every fifth turn to itself
GRAPH = """turns AS (SELECT conv_id AS graph_id, 't' || turn AS node_id, turn, role, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations),
nodes AS (SELECT graph_id, node_id, CASE WHEN role = 'assistant' THEN '<B>' || role || '</B>' ELSE role END AS label, CASE turn % 3 WHEN 0 THEN 'task' WHEN 1 THEN 'data input' ELSE 'other' END AS kind, role = 'assistant' AS task FROM turns),
edges AS (SELECT graph_id, node_id AS src, 't' || (turn + 1) AS dst, CASE turn % 3 WHEN 0 THEN 'ORDER' WHEN 1 THEN 'def' ELSE 'control flow' END AS label FROM turns, range(2) r(k) WHERE turn < last AND (k = 0 OR turn % 3 = 0)
  UNION ALL SELECT graph_id, node_id, 't0', 'USE' FROM turns WHERE turn = last AND graph_id % 2 = 0 AND last > 0 UNION ALL SELECT graph_id, node_id, node_id, 'guard' FROM turns WHERE turn % 5 = 4),
adj AS (SELECT DISTINCT graph_id, src, dst FROM edges),
tasks AS (SELECT graph_id, node_id FROM nodes n WHERE task OR (NOT EXISTS (SELECT 1 FROM nodes m WHERE m.graph_id = n.graph_id AND m.task) AND EXISTS (SELECT 1 FROM adj a WHERE a.graph_id = n.graph_id AND n.node_id IN (a.src, a.dst))))"""


def graphs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    turns = table(spark, sf_dir, "conversations").selectExpr("conv_id AS graph_id", "concat('t', turn) AS node_id", "turn", "role", "max(turn) OVER (PARTITION BY conv_id) AS last")
    nodes = turns.selectExpr("graph_id", "node_id", "map('label', CASE WHEN role = 'assistant' THEN concat('<B>', role, '</B>') ELSE role END, 'kind', CASE turn % 3 WHEN 0 THEN 'task' WHEN 1 THEN 'data input' ELSE 'other' END) AS attrs")
    lead = turns.where("turn < last").selectExpr("graph_id", "node_id AS src", "concat('t', turn + 1) AS dst", "map('label', CASE turn % 3 WHEN 0 THEN 'ORDER' WHEN 1 THEN 'def' ELSE 'control flow' END) AS attrs", "explode(CASE WHEN turn % 3 = 0 THEN array(0, 1) ELSE array(0) END) AS k").drop("k")
    back = turns.where("turn = last AND graph_id % 2 = 0 AND last > 0").selectExpr("graph_id", "node_id AS src", "'t0' AS dst", "map('label', 'USE') AS attrs")
    own = turns.where("turn % 5 = 4").selectExpr("graph_id", "node_id AS src", "node_id AS dst", "map('label', 'guard') AS attrs")
    return graph.sanitized(nodes, lead.unionByName(back).unionByName(own))


@query("g01_g02_sizes", f"WITH {GRAPH}, v AS (SELECT graph_id, count(*) AS vertices FROM nodes GROUP BY 1), e AS (SELECT graph_id, count(*) AS edges FROM edges GROUP BY 1) SELECT v.graph_id, vertices, coalesce(edges, 0) AS edges, round(coalesce(edges, 0) / vertices, 6) AS ratio FROM v LEFT JOIN e ON v.graph_id = e.graph_id")
def g02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.sizes(*graphs(spark, sf_dir)).withColumn("ratio", F.round("ratio", 6))


@query("g03_task_nodes", f"WITH {GRAPH} SELECT graph_id, node_id FROM tasks")
def g03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.task_nodes(*graphs(spark, sf_dir))


@query("g04_direct_fans", f"""WITH {GRAPH} SELECT g.graph_id, (SELECT count(*) FROM adj a JOIN tasks t ON t.graph_id = a.graph_id AND t.node_id = a.dst WHERE a.graph_id = g.graph_id) AS fan_in, (SELECT count(*) FROM adj a JOIN tasks t ON t.graph_id = a.graph_id AND t.node_id = a.src WHERE a.graph_id = g.graph_id) AS fan_out FROM (SELECT DISTINCT graph_id FROM tasks) g""")
def g04(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = graphs(spark, sf_dir)
    return graph.direct_fans(graph.task_nodes(nodes, edges), graph.adjacency(edges))


REACH = f"""{GRAPH}, fwd AS (SELECT t.graph_id, t.node_id AS start, a.dst AS node_id FROM tasks t JOIN adj a ON a.graph_id = t.graph_id AND a.src = t.node_id UNION SELECT f.graph_id, f.start, a.dst FROM fwd f JOIN adj a ON a.graph_id = f.graph_id AND a.src = f.node_id),
bwd AS (SELECT t.graph_id, t.node_id AS start, a.src AS node_id FROM tasks t JOIN adj a ON a.graph_id = t.graph_id AND a.dst = t.node_id UNION SELECT f.graph_id, f.start, a.src FROM bwd f JOIN adj a ON a.graph_id = f.graph_id AND a.dst = f.node_id)"""


@query("g05_indirect_fans", f"""WITH RECURSIVE {REACH}, x AS (SELECT graph_id, node_id,
  greatest((SELECT count(*) FROM bwd b WHERE b.graph_id = t.graph_id AND b.start = t.node_id AND b.node_id <> b.start) - (SELECT count(*) FROM adj a WHERE a.graph_id = t.graph_id AND a.dst = t.node_id), 0) AS i,
  greatest((SELECT count(*) FROM fwd b WHERE b.graph_id = t.graph_id AND b.start = t.node_id AND b.node_id <> b.start) - (SELECT count(*) FROM adj a WHERE a.graph_id = t.graph_id AND a.src = t.node_id), 0) AS o FROM tasks t)
SELECT graph_id, sum(i)::BIGINT AS indirect_in, sum(o)::BIGINT AS indirect_out FROM x GROUP BY 1""")
def g05(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = graphs(spark, sf_dir)
    return graph.indirect_fans(graph.task_nodes(nodes, edges), graph.adjacency(edges))


@query("g06_global_ends", f"""WITH RECURSIVE {REACH} SELECT g.graph_id,
  (SELECT count(*) FROM nodes n WHERE n.graph_id = g.graph_id AND n.node_id NOT IN (SELECT node_id FROM tasks t WHERE t.graph_id = g.graph_id) AND n.node_id NOT IN (SELECT dst FROM adj a WHERE a.graph_id = g.graph_id) AND n.node_id IN (SELECT node_id FROM bwd b WHERE b.graph_id = g.graph_id)) AS global_input,
  (SELECT count(*) FROM nodes n WHERE n.graph_id = g.graph_id AND n.node_id NOT IN (SELECT node_id FROM tasks t WHERE t.graph_id = g.graph_id) AND n.node_id NOT IN (SELECT src FROM adj a WHERE a.graph_id = g.graph_id) AND n.node_id IN (SELECT node_id FROM fwd b WHERE b.graph_id = g.graph_id)) AS global_output
FROM (SELECT DISTINCT graph_id FROM nodes) g""")
def g06(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = graphs(spark, sf_dir)
    return graph.global_ends(nodes, graph.task_nodes(nodes, edges), graph.adjacency(edges))


@query("g07_lack_of_cohesion", f"""WITH RECURSIVE {GRAPH}, und AS (SELECT graph_id, src, dst FROM adj UNION SELECT graph_id, dst, src FROM adj), cc AS (SELECT graph_id, node_id, node_id AS label FROM nodes UNION SELECT c.graph_id, u.dst, c.label FROM cc c JOIN und u ON u.graph_id = c.graph_id AND u.src = c.node_id),
l AS (SELECT graph_id, node_id, min(label) AS label FROM cc GROUP BY 1, 2), k AS (SELECT l.graph_id, label, count(*) AS k FROM l JOIN tasks t ON t.graph_id = l.graph_id AND t.node_id = l.node_id GROUP BY 1, 2)
SELECT graph_id, round(CASE WHEN sum(k) < 2 THEN 0 ELSE 1 - sum(k * (k - 1) / 2) / (sum(k) * (sum(k) - 1) / 2) END, 6) AS lack_of_cohesion FROM k GROUP BY 1""")
def g07(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = graphs(spark, sf_dir)
    return graph.lack_of_cohesion(nodes, graph.task_nodes(nodes, edges), graph.adjacency(edges)).withColumn("lack_of_cohesion", F.round("lack_of_cohesion", 6))


@query("g08_edge_labels", f"WITH {GRAPH} SELECT graph_id, count(*) FILTER (upper(label) = 'ORDER') AS order_edges, count(*) FILTER (upper(label) = 'DEF') AS def_edges, count(*) FILTER (upper(label) = 'USE') AS use_edges, count(DISTINCT upper(label)) AS labels FROM edges GROUP BY 1")
def g08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.edge_labels(graphs(spark, sf_dir)[1])


KIND = "CASE WHEN kind = 'task' THEN 'Task' WHEN kind = 'data input' THEN 'Data' ELSE 'Unknown' END"
DEGREES = f"{GRAPH}, deg AS (SELECT n.*, (SELECT count(*) FROM edges e WHERE e.graph_id = n.graph_id AND e.dst = n.node_id) AS degree_in, (SELECT count(*) FROM edges e WHERE e.graph_id = n.graph_id AND e.src = n.node_id) AS degree_out FROM nodes n)"


_HOT = ", ".join(f"CASE WHEN {KIND} = '{t}' THEN 1 ELSE 0 END AS is_{t.lower()}" for t in s.NODE_TYPES)


@query("g09_g10_node_features", f"""WITH {DEGREES}, x AS (SELECT *, CASE WHEN turn % 4 = 1 THEN label || ' {{{{ a b }}}} = 7' ELSE label END AS text FROM deg JOIN (SELECT graph_id, node_id, turn FROM turns) USING (graph_id, node_id)),
t AS (SELECT *, regexp_extract_all(text, '[\\p{{L}}\\p{{M}}\\p{{N}}\\p{{Pc}}]+|\\{{\\{{.*?\\}}\\}}') AS tokens FROM x)
SELECT graph_id, node_id, degree_in, degree_out, degree_in + degree_out AS degree_total, {KIND} AS node_type, CASE WHEN kind = 'task' THEN 1 ELSE 0 END AS task, {_HOT}, length(text)::DOUBLE AS label_length, len(tokens)::DOUBLE AS token_count,
  round(CASE WHEN len(tokens) > 0 THEN len(list_filter(tokens, lambda k: regexp_matches(k, '[0-9]')))::DOUBLE / len(tokens) ELSE 0 END, 6) AS numeric_fraction, CASE WHEN turn % 4 = 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS has_template, CASE WHEN turn % 4 = 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS has_equals,
  CASE WHEN turn % 5 = 2 THEN 4 WHEN turn % 5 = 3 THEN 3 ELSE 2 END AS attr_count, CASE WHEN turn % 5 IN (2, 3) THEN 1 ELSE 0 END AS has_location FROM t""".replace("\\\\", "\\"))
def g10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types are read from kind here: the label comes last of the four attributes that may name one. Some labels hold a template, some nodes a place."""
    nodes, edges = graphs(spark, sf_dir)
    turn = F.substr("node_id", F.lit(2)).cast("int")
    label = F.when(turn % 4 == 1, F.concat(F.col("attrs")["label"], F.lit(" {{ a b }} = 7"))).otherwise(F.col("attrs")["label"])
    place = F.when(turn % 5 == 2, F.create_map(F.lit("location"), F.lit("1:2"), F.lit("file"), F.lit("x.yml"))).when(turn % 5 == 3, F.create_map(F.lit("file"), F.lit("x.yml"))).otherwise(F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    nodes = nodes.withColumn("attrs", F.map_concat(F.create_map(F.lit("label"), label, F.lit("kind"), F.col("attrs")["kind"]), place))
    return graph.node_features(nodes, edges).withColumn("numeric_fraction", F.round("numeric_fraction", 6))


@query("g11_p23_coo", f"""WITH {GRAPH}, p AS (SELECT graph_id, node_id, (row_number() OVER (PARTITION BY graph_id ORDER BY node_id) - 1)::INTEGER AS i FROM nodes)
SELECT e.graph_id, a.i AS src_index, b.i AS dst_index, CASE WHEN contains(label, 'control') THEN 2 WHEN contains(label, 'guard') THEN 4 ELSE 0 END AS edge_type FROM edges e JOIN p a ON a.graph_id = e.graph_id AND a.node_id = e.src JOIN p b ON b.graph_id = e.graph_id AND b.node_id = e.dst""")
def g11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.coo(*graphs(spark, sf_dir))


@query("g12_p21_type_distribution", f"WITH {GRAPH} SELECT {KIND} AS node_type, count(*) AS n FROM nodes GROUP BY 1")
def g12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs(spark, sf_dir)[0].groupBy(s.node_type(F.col("attrs")).alias("node_type")).agg(F.count("*").alias("n"))


EDGE_KIND = "CASE WHEN contains(label, 'control') THEN 2 WHEN contains(label, 'guard') THEN 4 ELSE 0 END"


@query("g12_edge_type_distribution", f"WITH {GRAPH} SELECT {EDGE_KIND} AS edge_type, count(*) AS n FROM edges GROUP BY 1")
def g12_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs(spark, sf_dir)[1].groupBy(s.edge_type(F.col("attrs")).alias("edge_type")).agg(F.count("*").alias("n"))


def graphml_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(graph_id, xml) of all graphs: every eleventh has no text, every seventh is cut off."""
    nodes, edges = graphs(spark, sf_dir)
    plain = lambda c: F.replace(F.replace(c, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    data = lambda key, c: F.concat(F.lit(f'<data key="{key}">'), plain(c), F.lit("</data>"))
    a = nodes.groupBy("graph_id").agg(F.array_join(F.collect_list(F.concat(F.lit('<node id="'), "node_id", F.lit('">'), data("d0", F.col("attrs")["label"]), F.lit("</node>"))), "").alias("a"))
    b = edges.groupBy("graph_id").agg(F.array_join(F.collect_list(F.concat(F.lit('<edge source="'), "src", F.lit('" target="'), "dst", F.lit('">'), data("d1", F.col("attrs")["label"]), F.lit("</edge>"))), "").alias("b"))
    head = '<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><key id="d0" for="node" attr.name="label" attr.type="string"/><key id="d1" for="edge" attr.name="label" attr.type="string"/><graph edgedefault="directed">'
    whole = F.concat(F.lit(head), "a", F.coalesce("b", F.lit("")), F.lit("</graph></graphml>"))
    k = F.col("graph_id")
    return a.join(b, "graph_id", "left").select("graph_id", F.when(k % 11 == 0, F.lit(None)).when(k % 7 == 0, F.substr(whole, F.lit(1), F.length(whole) - 9)).otherwise(whole).alias("xml"))


@query("s05_graphml_edges", f"WITH {GRAPH} SELECT n.graph_id, n.graph_id % 7 = 0 AS bad, CASE WHEN n.graph_id % 7 > 0 THEN (SELECT count(*) FROM edges e WHERE e.graph_id = n.graph_id) ELSE 0 END AS edges, CASE WHEN n.graph_id % 7 > 0 THEN (SELECT min(label) FROM edges e WHERE e.graph_id = n.graph_id) END AS first_label, CASE WHEN n.graph_id % 7 > 0 THEN (SELECT max(src || '>' || dst) FROM edges e WHERE e.graph_id = n.graph_id) END AS last_edge FROM (SELECT DISTINCT graph_id FROM nodes) n WHERE n.graph_id % 11 > 0")
def s05_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges written as GraphML and read back; a text that does not parse is marked and ends nothing."""
    rows = read_graphml(graphml_texts(spark, sf_dir).where("xml IS NOT NULL"))
    bad, edges = F.col("bad").isNotNull(), F.coalesce("edges", F.array().cast("array<struct<src:string,dst:string,attrs:map<string,string>>>"))
    return rows.select("graph_id", bad.alias("bad"), F.when(bad, F.array().cast("array<struct<src:string,dst:string,attrs:map<string,string>>>")).otherwise(edges).alias("e")).select(
        "graph_id", "bad", F.size("e").cast("long").alias("edges"), F.array_min(F.transform("e", lambda x: x["attrs"]["label"])).alias("first_label"), F.array_max(F.transform("e", lambda x: F.concat(x["src"], F.lit(">"), x["dst"]))).alias("last_edge"))


@query("g13_graph_sample_reasons", f"""WITH {GRAPH}, v AS (SELECT n.graph_id, count(*) AS vertices, (SELECT count(*) FROM edges e WHERE e.graph_id = n.graph_id) AS edges FROM nodes n GROUP BY 1)
SELECT graph_id, CASE WHEN graph_id % 11 = 0 THEN 'graphml_path_missing' WHEN graph_id % 7 = 0 THEN 'graphml_parse_error' WHEN vertices < 3 THEN 'below_min_nodes_3' WHEN edges < 4 THEN 'below_min_edges_4' END AS reason FROM v""")
def g13_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.sample_reasons(graphml_texts(spark, sf_dir), min_edges=4).select("graph_id", "reason")


@query("g15_relation_means", f"""WITH {DEGREES}, te AS (SELECT DISTINCT graph_id, src, dst, {EDGE_KIND} AS k FROM edges), r AS (SELECT te.graph_id, te.dst, te.k, avg(s.degree_out) AS x FROM te JOIN deg s ON s.graph_id = te.graph_id AND s.node_id = te.src GROUP BY 1, 2, 3),
q AS (SELECT graph_id, dst, sum(x) AS x FROM r GROUP BY 1, 2) SELECT d.graph_id, d.node_id, round(d.degree_out + coalesce(q.x, 0), 6) AS x FROM deg d LEFT JOIN q ON q.graph_id = d.graph_id AND q.dst = d.node_id""")
def g15_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = graphs(spark, sf_dir)
    f = graph.degrees(nodes, edges).select("graph_id", "node_id", F.col("degree_out").cast("double").alias("x"))
    return graph.relation_means(f, edges, ["x"]).withColumn("x", F.round("x", 6))


@query("g15_gin_two_hops", f"""WITH {DEGREES}, h1 AS (SELECT d.graph_id, d.node_id, d.degree_out + coalesce((SELECT sum(s.degree_out) FROM adj a JOIN deg s ON s.graph_id = a.graph_id AND s.node_id = a.src WHERE a.graph_id = d.graph_id AND a.dst = d.node_id), 0) AS x FROM deg d)
SELECT d.graph_id, d.node_id, (d.x + coalesce((SELECT sum(s.x) FROM adj a JOIN h1 s ON s.graph_id = a.graph_id AND s.node_id = a.src WHERE a.graph_id = d.graph_id AND a.dst = d.node_id), 0))::DOUBLE AS x FROM h1 d""")
def g15_gin(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = graphs(spark, sf_dir)
    f, near = graph.degrees(nodes, edges).select("graph_id", "node_id", F.col("degree_out").cast("double").alias("x")), graph.adjacency(edges)
    for _ in range(2):
        f = graph.propagated(f, near, ["x"], "gin")
    return f


@query("g13_p15_p16_sample_reasons", f"""WITH {GRAPH}, v AS (SELECT n.graph_id, count(*) AS vertices, (SELECT count(*) FROM edges e WHERE e.graph_id = n.graph_id) AS edges FROM nodes n GROUP BY 1)
SELECT graph_id, CASE WHEN vertices = 0 OR edges = 0 THEN 'EMPTY_GRAPH' WHEN vertices < 4 THEN 'nodes below minimum' WHEN edges < 5 THEN 'edges below minimum' ELSE 'SUCCESS' END AS status FROM v""")
def g13(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = graphs(spark, sf_dir)
    size = graph.sizes(nodes, edges)
    v, e = F.col("vertices"), F.col("edges")
    low = F.lower(F.coalesce(F.try_element_at("attrs", F.lit("label")), F.lit("")))
    include = nodes.groupBy("graph_id").agg(F.bool_or(s.any_of(low, ("import_tasks", "include_tasks"))).alias("includes"))
    raw = edges.groupBy("graph_id").agg(F.bool_or(low == "_raw_params").alias("raw"))
    rows = size.join(include, "graph_id", "left").join(raw, "graph_id", "left")
    hollow = (v == 2) & (e == 1) & F.coalesce("includes", F.lit(False)) & F.coalesce("raw", F.lit(False))
    status = F.when((v == 0) | (e == 0), "EMPTY_GRAPH").when(hollow, "placeholder").when(v < 4, "nodes below minimum").when(e < 5, "edges below minimum").otherwise("SUCCESS")
    return rows.select("graph_id", status.alias("status"))


@query("g14_scaled_features", f"WITH {DEGREES}, t AS (SELECT avg(degree_in) AS m, CASE WHEN stddev_pop(degree_in) = 0 THEN 1 ELSE stddev_pop(degree_in) END AS sd FROM deg WHERE graph_id % 2 = 0) SELECT graph_id, node_id, round((degree_in - m) / sd, 6) AS degree_in FROM deg, t")
def g14(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = graph.degrees(*graphs(spark, sf_dir)).select("graph_id", "node_id", "degree_in")
    return graph.scaled(f, graph.fitted_scale(f.where("graph_id % 2 = 0"), ["degree_in"]), ["degree_in"]).withColumn("degree_in", F.round("degree_in", 6))


@query("g15_g16_mean_readout", f"""WITH {DEGREES}, h AS (SELECT d.graph_id, d.node_id, coalesce((SELECT avg(s.degree_out) FROM adj a JOIN deg s ON s.graph_id = a.graph_id AND s.node_id = a.src WHERE a.graph_id = d.graph_id AND a.dst = d.node_id), 0) AS x FROM deg d)
SELECT graph_id, round(avg(x), 6) AS x_mean, round(sum(x), 6) AS x_add, round(max(x), 6) AS x_max FROM h GROUP BY 1""")
def g15(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = graphs(spark, sf_dir)
    f = graph.degrees(nodes, edges).select("graph_id", "node_id", F.col("degree_out").cast("double").alias("x"))
    out = graph.readout(graph.propagated(f, graph.adjacency(edges), ["x"], "mean"), ["x"])
    return out.withColumns({c: F.round(c, 6) for c in ("x_mean", "x_add", "x_max")})


@query("g15_gcn", f"""WITH {DEGREES}, e AS (SELECT graph_id, src, dst FROM adj WHERE src <> dst UNION ALL SELECT graph_id, node_id, node_id FROM nodes), q AS (SELECT graph_id, dst AS n, count(*) AS d FROM e GROUP BY 1, 2)
SELECT e.graph_id, e.dst AS node_id, round(sum(s.degree_out / sqrt(a.d * b.d)), 6) AS x FROM e JOIN deg s ON s.graph_id = e.graph_id AND s.node_id = e.src JOIN q a ON a.graph_id = e.graph_id AND a.n = e.src JOIN q b ON b.graph_id = e.graph_id AND b.n = e.dst GROUP BY 1, 2""")
def g15_gcn(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = graphs(spark, sf_dir)
    f = graph.degrees(nodes, edges).select("graph_id", "node_id", F.col("degree_out").cast("double").alias("x"))
    return graph.propagated(f, graph.adjacency(edges), ["x"], "gcn").withColumn("x", F.round("x", 6))


@query("s06_s07_dot_source", f"WITH {GRAPH} SELECT graph_id, src, dst, label, count(*) AS n FROM edges GROUP BY ALL")
def s06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges written as text in the line format and read back."""
    nodes, edges = graphs(spark, sf_dir)
    a = nodes.select("graph_id", F.concat(F.lit("\t"), "node_id", F.lit(" [label=<"), F.col("attrs")["label"], F.lit("> shape=box]")).alias("line"))
    b = edges.select("graph_id", F.concat(F.lit("\t"), "src", F.lit(" -> "), "dst", F.lit(' [label="'), F.col("attrs")["label"], F.lit('" penwidth=2.5]')).alias("line"))
    text = a.unionByName(b).groupBy("graph_id").agg(F.concat(F.lit("digraph {\n\tnode [fontname=Courier]\n"), F.array_join(F.collect_list("line"), "\n"), F.lit("\n}")).alias("dot"))
    return read_dot(text)[1].groupBy("graph_id", "src", "dst", F.col("attrs")["label"].alias("label")).agg(F.count("*").alias("n"))


@query("s05_graphml_source", f"WITH {GRAPH} SELECT graph_id, count(*) AS vertices, min(label) AS first_label FROM nodes GROUP BY 1")
def s05(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes written as GraphML and read back."""
    label = F.replace(F.replace(F.col("attrs")["label"], F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    node = F.concat(F.lit('<node id="'), "node_id", F.lit('"><data key="d0">'), label, F.lit("</data></node>"))
    text = graphs(spark, sf_dir)[0].groupBy("graph_id").agg(F.concat(F.lit('<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><key id="d0" for="node" attr.name="label" attr.type="string"/><graph edgedefault="directed">'), F.array_join(F.collect_list(node), ""), F.lit("</graph></graphml>")).alias("xml"))
    rows = read_graphml(text).where("bad IS NULL").select("graph_id", F.explode("nodes").alias("n"))
    return rows.groupBy("graph_id").agg(F.count("*").alias("vertices"), F.min(F.col("n.attrs")["label"]).alias("first_label"))
