"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where it is unset and the master is local, a
    temporary folder is made and set; on a cluster without the setting this raises."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if found:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(found)
        return found
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return sc.getCheckpointDir()


def fixed(df: DataFrame) -> DataFrame:
    """df written to the shared folder: rows and partitions stay as they are, whatever executor is lost."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """df written to the shared folder as a Parquet table and read again: columnar, for what is read more than once.
    discard() takes it away when nothing that is still to be computed reads it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what stored() wrote for these."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.stored_at)
        path.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for working columns that do not clash with those of df."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def bounded_batches(spark: SparkSession, records: int = 2_000, size: int = 8_000_000) -> None:
    """Arrow batches of so many rows and bytes at most, so that long texts do not fill a Python worker. The setting
    has to hold when the result is computed, which is after the operator returns, so it stays in the session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", records)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def measured_broadcasts(spark: SparkSession) -> None:
    """Joins broadcast a side only by the size its rows were measured to have while the query runs. Planning goes by the
    bytes of files, and what stored() writes may take twenty times as much in memory, on the driver too. The setting has
    to hold when the result is computed, which is after the operator returns, so it stays in the session."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "10MB")
