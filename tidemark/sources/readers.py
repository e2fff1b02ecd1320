"""Readers and writers: typed samples, repository lists, tabular files, graph texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.operators.audit import first_of_key
from tidemark.operators.ranks import numbered_rows


def read_csv(spark: SparkSession, path: str | list[str], schema: str | StructType) -> DataFrame:
    """Headed CSV under a schema; a byte-order mark before the first name is no part of it."""
    return spark.read.csv(path, header=True, schema=schema, encoding="UTF-8", enforceSchema=True)


#: Texts that stand for a missing value.
MISSING = ["", "NA", "N/A", "n/a", "NaN", "nan", "null", "NULL", "None", "<NA>", "#N/A", "-nan", "-NaN"]
#: Types a text column may have, narrowest first, by the form of its values; string takes them all.
FORMS = {
    "boolean": r"(?i)(true|false)",
    "bigint": r"[+-]?[0-9]+",
    "double": r"(?i)[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?|[+-]?inf(inity)?",
    "timestamp": r"[0-9]{4}-[0-9]{2}-[0-9]{2}([ T][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]+)?)?)?(Z|[+-][0-9]{2}:?[0-9]{2})?",
}


def said(c: str) -> Column:
    """The text of a column without white space around it, null where it stands for a missing value."""
    text = F.trim(F.col(f"`{c}`"))
    return F.when(~text.isin(MISSING), text)


def fitting(c: str) -> Column:
    """The bits of the types of FORMS, in their order, that a text has the form of; null where it is null. Forms are tried one
    after the other, those of most values first, until one fits: none fits two but whole numbers, which are doubles too."""
    text, bit = F.col(f"`{c}`"), {kind: 1 << k for k, kind in enumerate(FORMS)}
    has = lambda kind: text.rlike(f"^({FORMS[kind]})$") & text.try_cast(kind).isNotNull()
    out = F.when(text.isNull(), F.lit(None).cast("int")).when(has("bigint"), bit["bigint"] | bit["double"])
    for kind in ("double", "timestamp", "boolean"):
        out = out.when(has(kind), bit[kind])
    return out.otherwise(0)


def inferred_types(rows: DataFrame) -> dict[str, str]:
    """For each text column the narrowest of FORMS that all its values have, else string; double for a column without
    any. One aggregate over all rows and columns, of the types that fit all values of a column; the driver gets one row."""
    texts = rows.select(*(said(c).alias(c) for c in rows.columns))
    bits = texts.select(*(fitting(c).alias(f"b{i}") for i, c in enumerate(rows.columns)))
    found = bits.agg(*(F.bit_and(b).alias(b) for b in bits.columns)).first()
    return {c: "double" if found[i] is None else next((kind for k, kind in enumerate(FORMS) if found[i] >> k & 1), "string") for i, c in enumerate(rows.columns)}


def read_inferred(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Headed CSV whose columns get the types that all their values allow; missing values are null. A column that is whole
    numbers but for one value is doubles or text throughout; text keeps its white space."""
    rows = spark.read.csv(path, header=True, encoding="UTF-8", inferSchema=False)
    rows = rows.toDF(*(c.lstrip("\ufeff") for c in rows.columns))
    types = inferred_types(rows)
    return rows.select(*(F.when(said(c).isNotNull(), F.col(f"`{c}`")).alias(c) if t == "string" else said(c).try_cast(t).alias(c) for c, t in types.items()))


def text_rows(spark: SparkSession, path: str | list[str], order: list[str], *, limit: int | None = None) -> DataFrame:
    """Headed CSV with all columns as text, a byte-order mark taken off the first name, and row_index, the 1-based place
    by order, which has to tell rows apart (files have no order of their own); the first limit rows, if given."""
    rows = spark.read.csv(path, header=True, encoding="UTF-8", inferSchema=False)
    rows = rows.toDF(*(c.lstrip("\ufeff") for c in rows.columns))
    out = numbered_rows(rows, order)
    return out if limit is None else out.where(F.col("row_index") <= limit)


def union_files(spark: SparkSession, paths: dict[str, str], name: str = "run") -> DataFrame:
    """The headed CSV files or folders of several runs, one after the other, with the run's name in front. All have
    the columns of the first: further or missing ones raise."""
    out = columns = None
    for run, path in paths.items():
        rows = spark.read.csv(path, header=True, inferSchema=False)
        columns = columns or rows.columns
        if rows.columns != columns:
            raise ValueError(f"{run} has columns {rows.columns}, not {columns}")
        rows = rows.select(F.lit(run).alias(name), *(F.col(f"`{c}`") for c in columns))
        out = rows if out is None else out.unionByName(rows)
    return out


def repo_list(lines: DataFrame) -> DataFrame:
    """(at, url, branch) from (at, value) lines `url[, branch]`: blanks and # lines skipped, branch master
    where none is given, the first line of each pair."""
    parts = F.split("value", ",")
    rows = lines.where(~F.col("value").rlike(r"^\s*(#|$)")).select("at", F.trim(parts[0]).alias("url"), F.coalesce(F.nullif(F.trim(F.get(parts, F.lit(1))), F.lit("")), F.lit("master")).alias("branch"))
    return rows.groupBy("url", "branch").agg(F.min("at").alias("at"))


def typed_samples(raw: DataFrame) -> DataFrame:
    """Labels to integers (0 where they are no number), times parsed (rows without one dropped), and sample_id."""
    at = F.try_to_timestamp("committed_at")
    out = raw.withColumns({"label": F.coalesce(F.col("label").try_cast("double").cast("int"), F.lit(0)), "committed_at": at})
    return out.where(F.col("committed_at").isNotNull()).withColumn("sample_id", F.concat_ws("::", "repository", "commit", "filepath"))


def write_table(df: DataFrame, path: str, *, force: bool = False, fmt: str = "parquet", by: list[str] | None = None) -> None:
    """Written whole or not at all; an existing table only with force."""
    w = df.write.mode("overwrite" if force else "errorifexists").format(fmt)
    w = w.option("header", True) if fmt == "csv" else w
    (w.partitionBy(*by) if by else w).save(path)


GRAPHML = """struct<key: array<struct<_id: string, `_attr.name`: string>>, graph: struct<node: array<struct<_id: string, data: array<struct<_key: string, _VALUE: string>>>>, edge: array<struct<_source: string, _target: string, data: array<struct<_key: string, _VALUE: string>>>>>, _bad: string>"""


def read_graphml(texts: DataFrame) -> DataFrame:
    """(graph_id, nodes, edges, bad) from (graph_id, xml): nodes (id, attrs) and edges (src, dst, attrs) as arrays,
    attribute keys resolved to their names; bad holds a text that does not parse."""
    parsed = texts.withColumn("g", F.from_xml("xml", GRAPHML, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad", "attributePrefix": "_", "valueTag": "_VALUE"}))
    names = F.map_from_entries(F.coalesce(F.transform("g.key", lambda k: F.struct(k["_id"].alias("a"), k["_attr.name"].alias("b"))), F.array().cast("array<struct<a:string,b:string>>")))
    parsed = parsed.withColumn("names", names)

    def attrs(data: Column) -> Column:
        pairs = F.transform(F.coalesce(data, F.array().cast("array<struct<_key:string,_VALUE:string>>")), lambda d: F.struct(F.coalesce(F.try_element_at("names", d["_key"]), d["_key"]).alias("a"), d["_VALUE"].alias("b")))
        return F.map_from_entries(pairs)

    nodes = F.transform("g.graph.node", lambda n: F.struct(n["_id"].alias("id"), attrs(n["data"]).alias("attrs")))
    edges = F.transform("g.graph.edge", lambda e: F.struct(e["_source"].alias("src"), e["_target"].alias("dst"), attrs(e["data"]).alias("attrs")))
    return parsed.select("graph_id", nodes.alias("nodes"), edges.alias("edges"), F.col("g._bad").alias("bad"))


ATTR = r'([\w.-]+)=("(?:[^"\\]|\\.)*"|<<.*?>>|[^\s\]]+)'


def dot_attributes(text: Column) -> Column:
    """key="quoted", key=<<html>> and key=bare to a map; quotes and one pair of angle brackets are taken off."""
    keys, values = F.regexp_extract_all(text, F.lit(ATTR), F.lit(1)), F.regexp_extract_all(text, F.lit(ATTR), F.lit(2))
    bare = F.transform(values, lambda v: F.when(v.startswith('"'), F.regexp_replace(F.substr(v, F.lit(2), F.length(v) - 2), r"\\(.)", "$1")).when(v.startswith("<<"), F.substr(v, F.lit(2), F.length(v) - 2)).otherwise(v))
    return F.map_from_arrays(keys, bare)


def read_dot(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes(graph_id, node_id, attrs) and edges(graph_id, src, dst, attrs) from (graph_id, dot) in the line
    format. Ends of edges that are not declared are nodes without attributes."""
    lines = texts.select("graph_id", F.explode(F.split("dot", "\n")).alias("line")).withColumn("line", F.trim(F.regexp_replace("line", r"[\t\r;]+", " ")))
    lines = lines.where(~F.col("line").rlike(r"^(digraph\b.*|\}|\{|node\b.*|)$"))
    tail = F.regexp_extract("line", r"\[(.*)\]\s*$", 1)
    edge = r"^(\S+)\s*->\s*(\S+?)(\s*\[.*\])?$"
    edges = lines.where(F.col("line").rlike(edge)).select("graph_id", F.regexp_extract("line", edge, 1).alias("src"), F.regexp_extract("line", edge, 2).alias("dst"), dot_attributes(tail).alias("attrs"))
    said = lines.where(~F.col("line").rlike(edge)).select("graph_id", F.regexp_extract("line", r"^(\S+)", 1).alias("node_id"), dot_attributes(tail).alias("attrs"), F.lit(0).alias("rank"))
    ends = edges.select("graph_id", F.explode(F.array("src", "dst")).alias("node_id")).distinct().select("graph_id", "node_id", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")).alias("attrs"), F.lit(1).alias("rank"))
    nodes = first_of_key(said.unionByName(ends), ["graph_id", "node_id"], [F.col("rank")]).drop("rank")
    return nodes, edges
