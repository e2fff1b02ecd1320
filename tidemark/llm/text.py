"""Expressions on text that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word: what stands between space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def words(text: Column) -> Column:
    """The words in order; an empty array for null and for text without words."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def utf8_bytes(text: Column) -> Column:
    """Length in UTF-8; 0 for null."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def others(df: DataFrame, results: list[str], keep: list[str] | None = None) -> list[Column]:
    """The columns of df, or those in keep, that are not named as a result: Spark tells names apart without regard to case."""
    taken = {x.lower() for x in results}
    return [F.col(quoted(c)) for c in keep or df.columns if c.lower() not in taken]


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def rows_where(df: DataFrame, condition: str, columns: list[str]) -> DataFrame:
    """columns of the rows of df that meet condition, a boolean column. where() would be pushed down
    with the whole computation of that column in it, once for every time the column's parts are used;
    an exploded filter stays where it is."""
    row = F.explode(F.filter(F.array(F.struct(*map(quoted, columns))), lambda _: F.col(condition)))
    return df.select(row.alias("_row")).select("_row.*")
