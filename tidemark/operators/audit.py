"""Filters that account for every row: deduplication, exclusion ledgers, required columns, resume."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def require_columns(df: DataFrame, columns: list[str]) -> None:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def require_unique(df: DataFrame, key: list[str]) -> None:
    """Raises where a key occurs twice; stops at the first that does."""
    found = df.groupBy(*key).count().where("count > 1").limit(1).collect()
    if found:
        raise ValueError(f"duplicate key: {found[0]}")


def numbered(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """df with _nth: 1 for the first row of each key in the given order (Parquet has no file order, so it is explicit)."""
    return df.withColumn("_nth", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))


def first_of_key(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    return numbered(df, key, order).where("_nth = 1").drop("_nth")


def duplicate_groups(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("duplicates")).where("duplicates > 1")


def first_reason(rules: list[tuple[Column, str]], otherwise: Column | None = None) -> Column:
    """The reason of the first rule that holds, else null (or otherwise): one CASE over the row."""
    out = otherwise if otherwise is not None else F.lit(None).cast("string")
    for condition, reason in reversed(rules):
        out = F.when(condition, F.lit(reason)).otherwise(out)
    return out


def all_reasons(rules: list[tuple[Column, str]], sep: str = ";") -> Column:
    return F.concat_ws(sep, *(F.when(c, F.lit(r)) for c, r in rules))


def ledger(df: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """(kept, excluded) from one tagged table: kept and excluded add up to df."""
    tagged = df.withColumn("reason", reason)
    return tagged.where("reason IS NULL").drop("reason"), tagged.where("reason IS NOT NULL")


def funnel(df: DataFrame, reason: str, key: list[str]) -> DataFrame:
    """Stage counts in one aggregate over the tagged table."""
    kept = F.col(reason).isNull()
    return df.agg(
        F.count("*").alias("input_rows"), F.count_if(kept).alias("kept_rows"), F.count_if(~kept).alias("excluded_rows"),
        F.countDistinct(*key).alias("distinct_keys"), F.countDistinct(F.when(kept, F.col(key[0]))).alias("kept_repositories"),
    )


def pending(rows: DataFrame, done: DataFrame, key: list[str], terminal: list[str]) -> DataFrame:
    """Rows whose key has no terminal status yet."""
    return rows.join(done.where(F.col("status").isin(*terminal)).select(*key).distinct(), key, "left_anti")


def rebuilt(rows: DataFrame, done: DataFrame, key: list[str], order: str) -> DataFrame:
    """Results of all rows that have one, in the order of the rows."""
    return rows.select(*key, order).join(done, key).orderBy(order)


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """old without the keys of new, and new."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new)
