"""Metrics over very many small directed multigraphs at once.

Two flat tables: nodes(graph_id, node_id, attrs) and edges(graph_id, src, dst, attrs). Loops run over all
graphs together and stop when nothing changes; each round is written to the shared folder.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import scalars as s
from tidemark.operators.audit import first_reason
from tidemark.shared import discard, stored
from tidemark.sources.readers import read_graphml

NODE = ["graph_id", "node_id"]


def sanitized(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ids and attribute values as text."""
    text = lambda c: F.transform_values(c, lambda _, v: v.cast("string"))
    return (nodes.select("graph_id", F.col("node_id").cast("string").alias("node_id"), text("attrs").alias("attrs")),
            edges.select("graph_id", F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), text("attrs").alias("attrs")))


def sizes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """vertices (declared nodes), edges (parallel ones counted) and their ratio (0 without vertices)."""
    v = nodes.groupBy("graph_id").agg(F.count("*").alias("vertices"))
    e = edges.groupBy("graph_id").agg(F.count("*").alias("edges"))
    out = v.join(e, "graph_id", "full").select("graph_id", F.coalesce("vertices", F.lit(0)).alias("vertices"), F.coalesce("edges", F.lit(0)).alias("edges"))
    return out.withColumn("ratio", s.safe_ratio(F.col("edges").cast("double"), F.col("vertices")))


def adjacency(edges: DataFrame) -> DataFrame:
    """Parallel edges collapse."""
    return edges.select("graph_id", "src", "dst").distinct()


def task_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that are tasks; where a graph has none, all that have an edge."""
    ends = edges.select("graph_id", F.explode(F.array("src", "dst")).alias("node_id")).distinct().withColumn("_linked", F.lit(True))
    rows = nodes.select(*NODE, s.is_task_node(F.col("attrs")).alias("_task")).join(ends, NODE, "left")
    any_task = F.max("_task").over(Window.partitionBy("graph_id"))
    return rows.withColumn("_any", any_task).where("_task OR (NOT _any AND _linked)").select(*NODE)


def direct_fans(tasks: DataFrame, adjacent: DataFrame) -> DataFrame:
    """(graph_id, fan_in, fan_out): distinct neighbours, summed over task nodes; a self-loop counts."""
    into = adjacent.join(tasks.withColumnRenamed("node_id", "dst"), ["graph_id", "dst"]).groupBy("graph_id").agg(F.count("*").alias("fan_in"))
    out = adjacent.join(tasks.withColumnRenamed("node_id", "src"), ["graph_id", "src"]).groupBy("graph_id").agg(F.count("*").alias("fan_out"))
    graphs = tasks.select("graph_id").distinct()
    return graphs.join(into, "graph_id", "left").join(out, "graph_id", "left").select("graph_id", F.coalesce("fan_in", F.lit(0)).alias("fan_in"), F.coalesce("fan_out", F.lit(0)).alias("fan_out"))


def closure(starts: DataFrame, adjacent: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, node_id): starts, and what is reached from them along edges.

    Each round goes as far as two to the number of rounds before it, and writes only what is new."""
    near = adjacent.select("graph_id", "src", "dst")
    rounds, paths = [stored(starts.select(*keys, "node_id").distinct())], []
    while True:
        seen = reduce(DataFrame.unionByName, rounds)
        step = seen.join(near.withColumnRenamed("src", "node_id"), NODE).select(*keys, F.col("dst").alias("node_id")).distinct()
        new = stored(step.join(seen, [*keys, "node_id"], "left_anti"))
        if not new.limit(1).count():
            discard(new, *paths)
            return seen
        rounds.append(new)
        half = near.select("graph_id", "src", F.col("dst").alias("_by")).join(near.select("graph_id", F.col("src").alias("_by"), "dst"), ["graph_id", "_by"])
        near = stored(near.unionByName(half.select("graph_id", "src", "dst")).distinct())
        discard(*paths)
        paths = [near]


def reachable(starts: DataFrame, adjacent: DataFrame) -> DataFrame:
    """(graph_id, start, node_id): what each start reaches, itself never included."""
    return closure(starts.select("graph_id", F.col("node_id").alias("start"), "node_id"), adjacent, ["graph_id", "start"]).where("start != node_id")


def reversed_edges(adjacent: DataFrame) -> DataFrame:
    return adjacent.select("graph_id", F.col("dst").alias("src"), F.col("src").alias("dst"))


def indirect_fans(tasks: DataFrame, adjacent: DataFrame) -> DataFrame:
    """(graph_id, indirect_in, indirect_out): reached but not direct neighbours, at least 0 for each task, summed."""
    def one(adj: DataFrame, name: str) -> DataFrame:
        far = reachable(tasks, adj).groupBy("graph_id", F.col("start").alias("node_id")).agg(F.count("*").alias("far"))
        near = adj.groupBy("graph_id", F.col("src").alias("node_id")).agg(F.count("*").alias("near"))
        rows = tasks.join(far, NODE, "left").join(near, NODE, "left")
        return rows.groupBy("graph_id").agg(F.sum(F.greatest(F.coalesce("far", F.lit(0)) - F.coalesce("near", F.lit(0)), F.lit(0))).alias(name))

    return one(reversed_edges(adjacent), "indirect_in").join(one(adjacent, "indirect_out"), "graph_id")


def spread(starts: DataFrame, adjacent: DataFrame) -> DataFrame:
    """(graph_id, node_id): starts and all they reach, from all starts at once.

    The graph is contracted first. All starts act as one source. A node with one predecessor is reached if that is, so it
    joins the nearest ancestor that stays, four steps up at most; none of them stays in the first round, which ends short chains; in
    each later one it is drawn who does, by which chains, trees and cycles (left with their entry and a loop, which goes) halve or so. What nothing leads to goes too. Once a later round takes
    less than an eighth of the edges, the rest is walked from the source, a step a round. No table of paths is written: the edges of all
    rounds together are at most nine times those given, and a node is written once a round at most while it has edges."""
    dark = adjacent.select("graph_id", "src", "dst").where("src != dst").join(starts.select("graph_id", F.col("node_id").alias("dst")), ["graph_id", "dst"], "left_anti")
    first = dark.join(starts.select("graph_id", F.col("node_id").alias("src"), F.lit(True).alias("lit")).distinct(), ["graph_id", "src"], "left")
    edges = stored(_lit_edges(first))
    moves, trash, before = [], [edges], None
    while True:
        left, lit = edges.agg(F.count("*"), F.count_if("lit")).first()
        if not lit or len(moves) > 1 and 8 * left > 7 * before:
            break
        before = left
        moves.append(stored(_places(edges, len(moves))))
        edges = stored(_contracted(edges, moves[-1]))
        trash += [moves[-1], edges]
    reached = [stored(starts.select(*NODE).distinct())]
    reached += [m.where("kind = 'lit'").select(*NODE) for m in moves]
    front = stored(edges.where("lit").select("graph_id", F.col("dst").alias("node_id")).distinct())
    while front.limit(1).count():
        reached.append(front)
        step = edges.join(front.withColumnRenamed("node_id", "src"), ["graph_id", "src"], "left_semi").select("graph_id", F.col("dst").alias("node_id")).distinct()
        front = stored(step.join(reduce(DataFrame.unionByName, reached), NODE, "left_anti"))
    for m in reversed(moves):
        joined = m.where("kind = 'joins'").join(reduce(DataFrame.unionByName, reached).withColumnRenamed("node_id", "to"), ["graph_id", "to"], "left_semi")
        reached.append(stored(joined.select(*NODE)))
    out = stored(reduce(DataFrame.unionByName, reached).distinct())
    discard(front, *trash, *(r for r in reached if hasattr(r, "stored_at")))
    return out


def _lit_edges(edges: DataFrame) -> DataFrame:
    """Edges once each; those from reached nodes have no src, as all of these count as one source."""
    lit = F.coalesce("lit", F.lit(False))
    return edges.select("graph_id", F.when(~lit, F.col("src")).alias("src"), "dst", lit.alias("lit")).distinct()


def _places(edges: DataFrame, turn: int) -> DataFrame:
    """(graph_id, node_id, kind, to): what becomes of each node that an edge leads to: lit, stays, joins `to`, or dead."""
    stays = (F.pmod(F.xxhash64("graph_id", "dst", F.lit(turn)), F.lit(4)) == 0) & F.lit(turn > 0)
    kind = F.when(F.max("lit"), "lit").when((F.count("*") > 1) | F.first(stays), "stays").otherwise("asks")
    now = edges.groupBy("graph_id", "dst").agg(kind.alias("kind"), F.min("src").alias("to")).withColumnRenamed("dst", "node_id")
    for _ in range(2):
        asked = now.select("graph_id", F.col("node_id").alias("to"), F.col("kind").alias("_kind"), F.col("to").alias("_to"))
        asks = F.col("kind") == "asks"
        answer = F.when(F.col("_kind").isNull(), "dead").when(F.col("_kind") == "stays", "joins").otherwise(F.col("_kind"))
        to = F.when(asks & F.col("_kind").isin("asks", "joins"), F.col("_to")).otherwise(F.col("to"))
        now = now.join(asked, ["graph_id", "to"], "left").select(*NODE, F.when(asks, answer).otherwise(F.col("kind")).alias("kind"), to.alias("to"))
    return now.withColumn("kind", F.when(F.col("kind") == "asks", "stays").otherwise(F.col("kind")))


def _contracted(edges: DataFrame, places: DataFrame) -> DataFrame:
    """Edges into nodes that stay, from what their src became; those from dead nodes, or ones that nothing leads to, are left out."""
    kept = edges.join(places.where("kind = 'stays'").select("graph_id", F.col("node_id").alias("dst")), ["graph_id", "dst"], "left_semi")
    place = places.where("kind != 'dead'").select("graph_id", F.col("node_id").alias("src"), "kind", "to")
    lit = F.col("kind") == "lit"
    new = kept.join(place, ["graph_id", "src"]).select("graph_id", F.when(F.col("kind") == "joins", F.col("to")).otherwise(F.col("src")).alias("src"), "dst", lit.alias("lit"))
    return _lit_edges(new.where("lit OR src != dst"))


def global_ends(nodes: DataFrame, tasks: DataFrame, adjacent: DataFrame) -> DataFrame:
    """(graph_id, global_input, global_output): sources that reach a task, sinks that a task reaches; tasks are neither."""
    other = nodes.select(*NODE).join(tasks, NODE, "left_anti")

    def one(adj: DataFrame, name: str) -> DataFrame:
        bare = other.join(adj.select("graph_id", F.col("dst").alias("node_id")).distinct(), NODE, "left_anti")
        return bare.join(spread(tasks, reversed_edges(adj)), NODE, "left_semi").groupBy("graph_id").agg(F.count("*").alias(name))

    graphs = nodes.select("graph_id").distinct()
    out = graphs.join(one(adjacent, "global_input"), "graph_id", "left").join(one(reversed_edges(adjacent), "global_output"), "graph_id", "left")
    return out.na.fill(0)


def components(nodes: DataFrame, adjacent: DataFrame) -> DataFrame:
    """(graph_id, node_id, label): the least node of each node's weakly connected component.

    Each round a node takes the least label among its neighbours', and then its label's label, so that
    chains shrink by more than half a round; each round's table is deleted once the next is written."""
    both = stored(adjacent.unionByName(reversed_edges(adjacent)).where("src != dst").distinct())
    now = stored(nodes.select(*NODE, F.col("node_id").alias("label"), F.lit(True).alias("_moved")))
    while True:
        near = both.join(now.select("graph_id", F.col("node_id").alias("src"), "label"), ["graph_id", "src"]).groupBy("graph_id", F.col("dst").alias("node_id")).agg(F.min("label").alias("_least"))
        hooked = now.select(*NODE, "label").join(near, NODE, "left").select(*NODE, "label", F.coalesce(F.least("label", "_least"), "label").alias("_to"))
        # a root that one of its members knows a lesser label for follows it: trees hook onto trees, not leaf by leaf
        roots = hooked.groupBy("graph_id", F.col("label").alias("node_id")).agg(F.min("_to").alias("_root"))
        hooked = hooked.join(roots, NODE, "left").select(*NODE, "label", F.least("_to", F.coalesce("_root", "_to")).alias("_to"))
        hooked = stored(hooked)
        jump = hooked.select("graph_id", F.col("node_id").alias("_to"), F.col("_to").alias("_further"))
        new = stored(hooked.join(jump, ["graph_id", "_to"]).select(*NODE, F.col("_further").alias("_new"), "label").select(*NODE, F.col("_new").alias("label"), (F.col("_new") != F.col("label")).alias("_moved")))
        discard(now, hooked)
        now = new
        if not now.where("_moved").limit(1).count():
            discard(both)
            return now.drop("_moved")


def lack_of_cohesion(nodes: DataFrame, tasks: DataFrame, adjacent: DataFrame) -> DataFrame:
    """(graph_id, lack_of_cohesion): one less the share of task pairs that are connected; 0 under two tasks."""
    labels = components(nodes, adjacent).join(tasks, NODE)
    k = labels.groupBy("graph_id", "label").agg(F.count("*").alias("k"))
    out = k.groupBy("graph_id").agg(F.sum(F.col("k") * (F.col("k") - 1) / 2).alias("linked"), F.sum("k").alias("n"))
    return out.select("graph_id", F.when(F.col("n") < 2, 0.0).otherwise(1 - F.col("linked") / (F.col("n") * (F.col("n") - 1) / 2)).alias("lack_of_cohesion"))


def edge_labels(edges: DataFrame) -> DataFrame:
    label = F.upper(s.clean_label(F.coalesce(F.try_element_at("attrs", F.lit("label")), F.lit(""))))
    return edges.withColumn("_l", label).groupBy("graph_id").agg(*(F.count_if(F.col("_l") == x).alias(f"{x.lower()}_edges") for x in ("ORDER", "DEF", "USE")), F.countDistinct(F.when(F.col("_l") != "", F.col("_l"))).alias("labels"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """in, out and total degree of each node, parallel edges counted."""
    i = edges.groupBy("graph_id", F.col("dst").alias("node_id")).agg(F.count("*").alias("degree_in"))
    o = edges.groupBy("graph_id", F.col("src").alias("node_id")).agg(F.count("*").alias("degree_out"))
    out = nodes.join(i, NODE, "left").join(o, NODE, "left").na.fill(0, ["degree_in", "degree_out"])
    return out.withColumn("degree_total", F.col("degree_in") + F.col("degree_out"))


def node_features(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Task flag, degrees, one-hot type, text features, attribute count and location flag."""
    kind, label = s.node_type(F.col("attrs")), F.coalesce(F.try_element_at("attrs", F.lit("label")), F.try_element_at("attrs", F.lit("name")), F.lit(""))
    d = degrees(nodes, edges).withColumn("node_type", kind)
    hot = {f"is_{t.lower()}": (F.col("node_type") == t).cast("int") for t in s.NODE_TYPES}
    where = F.map_contains_key("attrs", "location") | F.map_contains_key("attrs", "file")
    return d.withColumns({"task": (F.col("node_type") == "Task").cast("int"), **hot, **s.text_features(label), "attr_count": F.size("attrs"), "has_location": where.cast("int")}).drop("attrs")


def coo(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, src_index, dst_index, edge_type): places of nodes in order of their ids."""
    place = nodes.select(*NODE, (F.row_number().over(Window.partitionBy("graph_id").orderBy("node_id")) - 1).alias("at"))
    a, b = (place.select("graph_id", F.col("node_id").alias(c), F.col("at").alias(f"{c}_index")) for c in ("src", "dst"))
    return edges.join(a, ["graph_id", "src"]).join(b, ["graph_id", "dst"]).select("graph_id", "src_index", "dst_index", s.edge_type(F.col("attrs")).alias("edge_type"))


def fitted_scale(features: DataFrame, columns: list[str]) -> DataFrame:
    """One row: mean and population deviation of each column (1 where it is 0)."""
    return features.agg(*(F.avg(c).alias(f"{c}_mean") for c in columns), *(F.when(F.stddev_pop(c) == 0, 1.0).otherwise(F.stddev_pop(c)).alias(f"{c}_std") for c in columns))


def scaled(features: DataFrame, scale: DataFrame, columns: list[str]) -> DataFrame:
    """features standardised by one fitted row."""
    out = features.crossJoin(F.broadcast(scale))
    return out.withColumns({c: (F.col(c) - F.col(f"{c}_mean")) / F.col(f"{c}_std") for c in columns}).select(*features.columns)


def propagated(features: DataFrame, adjacent: DataFrame, columns: list[str], how: str = "mean") -> DataFrame:
    """One hop: mean of neighbours, x plus their sum, or the symmetrically normalised sum with self-loops."""
    src = features.select("graph_id", F.col("node_id").alias("src"), *columns)
    if how == "gcn":
        loops = features.select("graph_id", F.col("node_id").alias("src"), F.col("node_id").alias("dst"))
        edges = adjacent.where("src != dst").unionByName(loops)
        deg = edges.groupBy("graph_id", F.col("dst").alias("n")).agg(F.count("*").cast("double").alias("d"))
        a = deg.select("graph_id", F.col("n").alias("src"), F.col("d").alias("ds"))
        b = deg.select("graph_id", F.col("n").alias("dst"), F.col("d").alias("dd"))
        rows = edges.join(src, ["graph_id", "src"]).join(a, ["graph_id", "src"]).join(b, ["graph_id", "dst"])
        weight = 1 / F.sqrt(F.col("ds") * F.col("dd"))
        return rows.groupBy("graph_id", F.col("dst").alias("node_id")).agg(*(F.sum(F.col(c) * weight).alias(c) for c in columns))
    f = F.avg if how == "mean" else F.sum
    near = adjacent.join(src, ["graph_id", "src"]).groupBy("graph_id", F.col("dst").alias("node_id")).agg(*(f(c).alias(f"_{c}") for c in columns))
    out = features.select(*NODE, *columns).join(near, NODE, "left")
    own = (lambda c: F.col(c)) if how == "gin" else (lambda c: F.lit(0.0))
    return out.select(*NODE, *((own(c) + F.coalesce(f"_{c}", F.lit(0.0))).alias(c) for c in columns))


def relation_means(features: DataFrame, edges: DataFrame, columns: list[str]) -> DataFrame:
    """One hop by relation: x plus, for each edge type, the mean of the distinct neighbours along edges of it."""
    typed = edges.select("graph_id", "src", "dst", s.edge_type(F.col("attrs")).alias("edge_type")).distinct()
    src = features.select("graph_id", F.col("node_id").alias("src"), *columns)
    near = typed.join(src, ["graph_id", "src"]).groupBy("graph_id", F.col("dst").alias("node_id"), "edge_type").agg(*(F.avg(c).alias(c) for c in columns))
    near = near.groupBy(*NODE).agg(*(F.sum(c).alias(f"_{c}") for c in columns))
    out = features.select(*NODE, *columns).join(near, NODE, "left")
    return out.select(*NODE, *((F.col(c) + F.coalesce(f"_{c}", F.lit(0.0))).alias(c) for c in columns))


def sample_reasons(texts: DataFrame, *, min_nodes: int = 3, min_edges: int = 2) -> DataFrame:
    """(graph_id, vertices, edges, reason) from (graph_id, xml): why a graph is no sample (no text, it does not
    parse, too few nodes or edges, no node features), else null."""
    parsed = read_graphml(texts)
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    rows = texts.select("graph_id", F.coalesce("xml", F.lit("")).alias("xml")).join(parsed.select("graph_id", F.greatest(size("nodes"), F.lit(0)).alias("vertices"), F.greatest(size("edges"), F.lit(0)).alias("edges"), F.col("bad").isNotNull().alias("bad"), F.coalesce(F.forall("nodes", lambda n: F.size(n["attrs"]) < 1), F.lit(True)).alias("bare")), "graph_id")
    return rows.select("graph_id", "vertices", "edges", first_reason([
        (F.col("xml") == "", "graphml_path_missing"), (F.col("bad"), "graphml_parse_error"), (F.col("vertices") < min_nodes, f"below_min_nodes_{min_nodes}"),
        (F.col("edges") < min_edges, f"below_min_edges_{min_edges}"), (F.col("bare"), "empty_node_features"),
    ]).alias("reason"))


def readout(features: DataFrame, columns: list[str]) -> DataFrame:
    """Mean, sum and maximum of each column by graph."""
    return features.groupBy("graph_id").agg(*(f(c).alias(f"{c}_{n}") for c in columns for n, f in (("mean", F.avg), ("add", F.sum), ("max", F.max))))
