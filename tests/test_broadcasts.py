"""What the walk-forward queries broadcast goes by rows, not by the bytes of files."""

from pyspark.sql import functions as F

from tidemark.plans import learning_queries as learning
from tidemark.shared import stored

SF = "/root/testdata/sf0.001"


def test_small_files_of_large_rows_are_not_broadcast(spark):
    settings = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        learning.swept_members(spark, SF, [learning.BASE])
        wide = stored(spark.range(200_000).select("id", F.lit("x" * 400).alias("text")))  # 80 MB of rows in a file of under 1 MB
        few = spark.range(50).select((F.col("id") * 2).alias("id"))
        large = spark.range(400_000).join(wide, "id")
        assert large.agg(F.sum(F.length("text"))).first()[0] == 400 * 200_000
        assert "BroadcastHashJoin" not in large._jdf.queryExecution().toString()
        assert wide.join(few, "id").count() == 50
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
