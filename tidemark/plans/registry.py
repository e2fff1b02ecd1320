"""Queries by name, each with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The sample table in SQL: one row for each order line, its customer as repository and its order as commit.
SAMPLES = """samples AS (SELECT 'c' || o_custkey AS repository, 'o' || o_orderkey AS commit, 'f' || l_linenumber AS filepath, o_orderdate AS committed_at,
  CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label, l_quantity AS quantity, l_extendedprice AS price, l_discount AS discount, l_tax AS tax, o_orderstatus AS status,
  o_custkey, o_orderkey, l_linenumber, l_partkey, l_suppkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample table: see SAMPLES."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    return orders.join(lines, orders["o_orderkey"] == lines["l_orderkey"]).selectExpr(
        "concat('c', o_custkey) AS repository", "concat('o', o_orderkey) AS commit", "concat('f', l_linenumber) AS filepath", "o_orderdate AS committed_at",
        "CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label", "l_quantity AS quantity", "l_extendedprice AS price", "l_discount AS discount", "l_tax AS tax", "o_orderstatus AS status",
        "o_custkey", "o_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
    )
