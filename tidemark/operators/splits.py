"""Walk-forward splits: each commit of a repository is tested on by what came before it.

Whether a split is valid follows from prefix sums over commits, so no split is spelled out before it
is known to be valid; members() then spells out the valid ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.shared import stored


def commit_index(samples: DataFrame) -> DataFrame:
    """One row for each commit: idx in time order (ties by commit), rows and positives of it and of all up to it.
    A commit with several times counts at the earliest."""
    commits = samples.groupBy("repository", "commit").agg(F.min("committed_at").alias("committed_at"), F.count("*").alias("n"), F.sum("label").alias("pos"))
    order = Window.partitionBy("repository").orderBy("committed_at", "commit")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    return commits.withColumns({
        "idx": F.row_number().over(order) - 1, "n_upto": F.sum("n").over(upto), "pos_upto": F.sum("pos").over(upto),
        "commits": F.count("*").over(Window.partitionBy("repository")),
    })


def walk_forward(samples: DataFrame, ratio: float = 0.2, commits: DataFrame | None = None) -> DataFrame:
    """(repository, test_idx, test_commit, val_count, train/val/test_size, reason); reason is null where the split is valid.
    commits is the commit_index() of samples, where it is there already.

    Validation takes the last round(ratio * idx) commits before the test commit (half to even, one at least,
    one where that were all of them). Repositories of fewer than three commits are one row, too_few_commits.
    """
    commits = commit_index(samples) if commits is None else commits
    val = F.greatest(F.bround(F.col("idx") * ratio).cast("int"), F.lit(1))
    tests = commits.where("commits >= 3 AND idx >= 2").withColumn("val_count", F.when(val >= F.col("idx"), 1).otherwise(val))
    last = commits.select("repository", F.col("idx").alias("last_train"), F.col("n_upto").alias("train_size"), F.col("pos_upto").alias("train_pos"))
    tests = tests.withColumn("last_train", F.col("idx") - F.col("val_count") - 1).join(last, ["repository", "last_train"], "left")
    out = tests.select(
        "repository", F.col("idx").alias("test_idx"), F.col("commit").alias("test_commit"), "val_count", F.coalesce("train_size", F.lit(0)).alias("train_size"),
        (F.col("n_upto") - F.col("n") - F.coalesce("train_size", F.lit(0))).alias("val_size"), F.col("n").alias("test_size"),
        F.when(F.coalesce("train_size", F.lit(0)) == 0, "empty_partition").when((F.col("train_pos") == 0) | (F.col("train_pos") == F.col("train_size")), "train_single_class")
        .when((F.col("pos") == 0) | (F.col("pos") == F.col("n")), "test_single_class").alias("reason"),
    )
    few = commits.where("commits < 3").select("repository").distinct().select("repository", *(F.lit(None).cast(t).alias(c) for c, t in out.dtypes[1:-1]), F.lit("too_few_commits").alias("reason"))
    return out.unionByName(few)


def capped(splits: DataFrame, most: int) -> DataFrame:
    """The first valid splits in order of repository and time, over all repositories."""
    return splits.where("reason IS NULL").orderBy("repository", "test_idx").limit(most)


def split_name() -> Column:
    """A split's name from repository and test_idx."""
    return F.concat("repository", F.lit("__wf_"), F.lpad(F.col("test_idx").cast("string"), 4, "0"))


def members(samples: DataFrame, splits: DataFrame) -> DataFrame:
    """(split_id, partition, and the sample's columns) of all valid splits: a range join on commit position."""
    idx = commit_index(samples).select("repository", "commit", "idx")
    valid = splits.where("reason IS NULL").select("repository", "test_idx", "val_count")
    rows = samples.join(idx, ["repository", "commit"]).join(valid, "repository").where("idx <= test_idx")
    part = F.when(F.col("idx") == F.col("test_idx"), "test").when(F.col("idx") >= F.col("test_idx") - F.col("val_count"), "validation").otherwise("train")
    return rows.withColumns({"partition": part, "split_id": split_name()}).drop("idx", "val_count", "test_idx")


def by_size(samples: DataFrame, most: int) -> tuple[DataFrame, DataFrame | None]:
    """samples of repositories of up to most rows, and, where there are any, those of the others."""
    big = stored(samples.groupBy("repository").agg(F.count("*").alias("_n")).where(F.col("_n") > most).select("repository"))
    if not big.limit(1).count():
        return samples, None
    part = lambda how: samples.join(F.broadcast(big), "repository", how)  # at most one of `most` rows
    return part("left_anti"), part("left_semi")


def training() -> WindowSpec:
    """A window over after_training(): up to a test row, the training rows of its split."""
    return Window.partitionBy("repository").orderBy("_at", F.col("test_idx").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def after_training(samples: DataFrame, ratio: float = 0.2, *, once: bool = False) -> DataFrame:
    """Each row of samples as a training row (test_idx is null) and as one of the split that its commit tests, of each commit
    only one if once, with what walk_forward() has for that split: test_idx, val_count, train_size, train_pos, reason. A
    test row stands behind the training rows of its split in training(), so that running aggregates over rows whose
    test_idx is null give what is fitted to them: a repository is shuffled once and no split is spelled out.
    All rows of a repository are ordered in one task, so larger ones are for by_size() to part off. Rows without a commit
    count for whether splits are valid."""
    commit = Window.partitionBy("repository", "commit")
    rows = samples.where("repository IS NOT NULL").repartition("repository")
    rows = rows.withColumns({"_first": F.min("committed_at").over(commit), "_n": F.count("*").over(commit), "_pos": F.sum("label").over(commit), "_nth": F.row_number().over(commit.orderBy(F.lit(1)))})
    rows = rows.withColumn("_idx", F.dense_rank().over(Window.partitionBy("repository").orderBy("_first", "commit")) - 1)
    val = F.greatest(F.bround(F.col("_idx") * ratio).cast("int"), F.lit(1))
    val = F.when(val >= F.col("_idx"), 1).otherwise(val)
    place = lambda at, test, count: F.struct(at.cast("int").alias("_at"), test.cast("int").alias("test_idx"), count.cast("int").alias("val_count"))
    tests = F.when((F.col("_idx") >= 2) & ((F.col("_nth") == 1) | F.lit(not once)), place(F.col("_idx") - val - 1, F.col("_idx"), val))
    rows = rows.withColumn("_p", F.explode(F.array_compact(F.array(place(F.col("_idx"), F.lit(None), F.lit(None)), tests)))).select("*", "_p.*").drop("_p", "_first", "_nth", "_idx")
    train = F.col("test_idx").isNull()
    rows = rows.withColumns({"train_size": F.count_if(train).over(training()), "train_pos": F.sum(F.when(train, F.col("label"))).over(training())})
    reason = (
        F.when(F.col("train_size") == 0, "empty_partition").when((F.col("train_pos") == 0) | (F.col("train_pos") == F.col("train_size")), "train_single_class")
        .when((F.col("_pos") == 0) | (F.col("_pos") == F.col("_n")), "test_single_class")
    )
    return rows.withColumn("reason", F.when(~train, reason)).drop("_n", "_pos")


def manifest(samples: DataFrame, ratio: float = 0.2) -> DataFrame:
    """(split_id, partition, n, positives, first_at, last_at) of all valid splits, from sums over commits: no
    member is spelled out. Times are those of commits, the earliest of each."""
    commits = commit_index(samples)
    before = commits.select("repository", F.col("idx").alias("_at"), "committed_at", "n_upto", "pos_upto", F.first("committed_at").over(Window.partitionBy("repository").orderBy("idx")).alias("_first"))
    at = lambda name, place: before.select("repository", F.col("_at").alias(place), *(F.col(c).alias(f"{name}{c}") for c in ("committed_at", "n_upto", "pos_upto", "_first")))
    valid = walk_forward(samples, ratio).where("reason IS NULL").select("repository", "test_idx", "val_count")
    valid = valid.withColumns({"t": F.col("test_idx") - F.col("val_count") - 1, "v": F.col("test_idx") - F.col("val_count"), "w": F.col("test_idx") - 1})
    for name in ("t", "v", "w"):
        valid = valid.join(at(f"{name}_", name), ["repository", name])
    valid = valid.join(at("x_", "test_idx"), ["repository", "test_idx"])
    part = lambda name, n, pos, first, last: F.struct(F.lit(name).alias("partition"), F.expr(n).alias("n"), F.expr(pos).cast("long").alias("positives"), F.expr(first).alias("first_at"), F.expr(last).alias("last_at"))
    parts = F.array(
        part("train", "t_n_upto", "t_pos_upto", "t__first", "t_committed_at"),
        part("validation", "w_n_upto - t_n_upto", "w_pos_upto - t_pos_upto", "v_committed_at", "w_committed_at"),
        part("test", "x_n_upto - w_n_upto", "x_pos_upto - w_pos_upto", "x_committed_at", "x_committed_at"),
    )
    return valid.select(split_name().alias("split_id"), F.explode(parts).alias("p")).select("split_id", "p.*")


def require_no_overlap(rows: DataFrame, key: list[str]) -> None:
    """Raises where a row of members() is in two partitions of a split; stops at the first that is."""
    found = rows.groupBy("split_id", *key).agg(F.countDistinct("partition").alias("_n")).where("_n > 1").limit(1).collect()
    if found:
        raise ValueError(f"in two partitions: {found[0]}")
