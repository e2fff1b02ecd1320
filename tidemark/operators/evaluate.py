"""Evaluation of binary classifiers, grouped by any keys, and comparison of systems."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ranks import joined, running


def confusion(df: DataFrame, keys: list[str]) -> DataFrame:
    """tp, fp, fn, tn by keys from y_true and y_pred."""
    t, p = F.col("y_true") == 1, F.col("y_pred") == 1
    return df.groupBy(*keys).agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"))


def ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def count_metrics(df: DataFrame) -> DataFrame:
    """precision, recall, f1 (0 where undefined), accuracy and mcc (null where truth or prediction has one class)."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    root = F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn)
    return df.withColumns({
        "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn),
        "accuracy": ratio(tp + tn, tp + tn + fp + fn), "mcc": F.when(root == 0, F.lit(None)).otherwise((tp * tn - fp * fn) / root),
    })


def ranking_metrics(df: DataFrame, keys: list[str]) -> DataFrame:
    """auc_roc (ties half) and auc_pr (step-wise average precision, equal scores together) by keys; null
    where the truth has one class. Scores are aggregated before anything is ordered, so that what is
    ordered is one row for each distinct score, and no key's scores in one task."""
    by_score = df.groupBy(*keys, "y_score").agg(F.sum("y_true").cast("double").alias("pos"), F.count("*").cast("double").alias("n"))
    run = running(by_score, keys, "y_score", ["pos", "n"], descending=True)
    negatives, tp = F.col("n") - F.col("pos"), F.col("pos_upto")
    above = (tp - F.col("pos")) * negatives + 0.5 * F.col("pos") * negatives
    out = run.groupBy(*keys).agg(F.sum(F.col("pos") * tp / F.col("n_upto")).alias("ap"), F.sum(above).alias("u"), F.sum("pos").alias("p"), F.sum("n").alias("m"))
    both = (F.col("p") > 0) & (F.col("p") < F.col("m"))
    return out.select(*keys, F.when(both, F.col("ap") / F.col("p")).alias("auc_pr"), F.when(both, F.col("u") / (F.col("p") * (F.col("m") - F.col("p")))).alias("auc_roc"))


def metrics(df: DataFrame, keys: list[str]) -> DataFrame:
    counts = count_metrics(confusion(df, keys))
    ranks = ranking_metrics(df, keys)
    if not keys:
        return counts.crossJoin(F.broadcast(ranks))  # one row each
    return joined(counts, ranks, keys)


NAMES = ["precision", "recall", "f1", "accuracy", "mcc", "auc_pr", "auc_roc"]


def long_metrics(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.unpivot(keys, NAMES, "metric", "value")


def paired(df: DataFrame, system: str, key: str) -> DataFrame:
    """(metric, a, b, key, x, y): every pair of systems on each common split, from (system, key, metric, value)."""
    left = df.select(F.col(system).alias("a"), key, "metric", F.col("value").alias("x"))
    right = df.select(F.col(system).alias("b"), key, "metric", F.col("value").alias("y"))
    return left.join(right, [key, "metric"]).where("a < b AND x IS NOT NULL AND y IS NOT NULL")


def compare(pairs: DataFrame) -> DataFrame:
    """n, means, mean delta (y - x), wins, ties and losses of b."""
    return pairs.groupBy("metric", "a", "b").agg(
        F.count("*").alias("n"), F.avg("x").alias("mean_a"), F.avg("y").alias("mean_b"), F.avg(F.col("y") - F.col("x")).alias("delta"),
        F.count_if(F.col("y") > F.col("x")).alias("wins"), F.count_if(F.col("y") == F.col("x")).alias("ties"), F.count_if(F.col("y") < F.col("x")).alias("losses"),
    )


def normal_tail(z: Column) -> Column:
    """P(|Z| > |z|) by the rational approximation 7.1.26 of Abramowitz and Stegun, absolute error under 1.5e-7."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1.0 / (1.0 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return poly * F.exp(-x * x)


#: Pairs up to which p is exact, where none tie and none are equal.
EXACT = 50


def exact_p(w: Column, n: Column) -> Column:
    """Two-sided p of the smaller rank sum w of n untied differences: how many of the 2^n choices of signs have
    a sum of w at most, counted by adding one rank after the other."""
    start = F.transform(F.sequence(F.lit(0), w.cast("int")), lambda i: F.when(i == 0, 1.0).otherwise(0.0))
    add = lambda ways, k: F.transform(ways, lambda x, i: x + F.coalesce(F.when(i >= k, F.get(ways, i - k)), F.lit(0.0)))
    ways = F.aggregate(F.sequence(F.lit(1), n.cast("int")), start, add)
    return F.least(F.lit(1.0), 2 * F.aggregate(ways, F.lit(0.0), lambda a, b: a + b) / F.pow(F.lit(2.0), n))


def wilcoxon(pairs: DataFrame) -> DataFrame:
    """n, W (the smaller signed-rank sum), z with tie correction and two-sided p, exact for few differences that do
    not tie, else from z; null under two differences. Equal pairs are dropped. Differences are rounded to 12
    places, so that equal ones tie."""
    keys = ["metric", "a", "b"]
    d = pairs.withColumn("d", F.round(F.col("y") - F.col("x"), 12)).withColumn("size", F.abs("d"))
    equal = d.where("d = 0").groupBy(*keys).agg(F.count("*").alias("equal"))
    sizes = d.where("d != 0").groupBy(*keys, "size").agg(F.count("*").cast("double").alias("t"), F.count_if(F.col("d") > 0).cast("double").alias("up"))
    sizes = running(sizes, keys, "size", ["t"])
    sizes = sizes.withColumn("rank", F.col("t_upto") - F.col("t") + (F.col("t") + 1) / 2)
    t, n = F.col("t"), F.col("n")
    out = sizes.groupBy(*keys).agg(F.sum("t").alias("n"), F.sum(F.col("rank") * F.col("up")).alias("plus"), F.sum(F.col("rank") * (t - F.col("up"))).alias("minus"), F.sum(t * t * t - t).alias("tie"))
    z = (F.least("plus", "minus") - n * (n + 1) / 4) / F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("tie") / 48)
    out = out.join(equal, keys, "left").withColumns({"w": F.least("plus", "minus"), "z": F.when(n >= 2, z)})
    exact = (n >= 2) & (n <= EXACT) & (F.col("tie") == 0) & F.col("equal").isNull()
    p = F.when(exact, exact_p(F.when(exact, F.col("w")), F.when(exact, n))).otherwise(normal_tail(F.col("z")))
    return out.withColumn("p", p).select(*keys, n.cast("long").alias("n"), "w", "z", "p")


def reliability(rows: DataFrame, grid: list[tuple[int, int, int]]) -> DataFrame:
    """For each system and cell of the grid (least size, positives and negatives of a split): splits and predictions
    kept and removed, their rates, pooled metrics of what is kept, and their differences from keeping all."""
    names = ["min_size", "min_pos", "min_neg"]
    size = rows.groupBy("system", "split_id").agg(F.count("*").alias("size"), F.sum("y_true").alias("pos"))
    cell = F.explode(F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(names, c, strict=True))) for c in grid)))
    cells = size.withColumn("g", cell).select("system", "split_id", "size", "pos", "g.*").withColumn("ok", F.expr("size >= min_size AND pos >= min_pos AND size - pos >= min_neg"))
    counts = cells.groupBy("system", *names).agg(F.count_if("ok").alias("kept_splits"), F.count_if(~F.col("ok")).alias("removed_splits"), F.sum(F.when(F.col("ok"), F.col("size")).otherwise(0)).alias("predictions"),
                                                 F.sum(F.when(F.col("ok"), 0).otherwise(F.col("size"))).alias("removed_predictions"), F.sum(F.when(F.col("ok"), F.col("pos")).otherwise(0)).alias("_pos"))
    counts = counts.withColumns({"kept_rate": F.col("kept_splits") / (F.col("kept_splits") + F.col("removed_splits")), "positive_rate": F.when(F.col("predictions") > 0, F.col("_pos") / F.col("predictions"))}).drop("_pos")
    kept = rows.join(cells.where("ok").select("system", "split_id", *names), ["system", "split_id"])
    whole = metrics(rows, ["system"]).select("system", *(F.col(c).alias(f"_{c}") for c in NAMES))
    out = counts.join(metrics(kept, ["system", *names]), ["system", *names], "left").join(whole, "system")
    return out.select(*counts.columns, *NAMES, *((F.col(c) - F.col(f"_{c}")).alias(f"delta_{c}") for c in NAMES))


LEVELS = ("pooled", "repository", "split")


def levels(rows: DataFrame) -> DataFrame:
    """(system, level, part, counts and metrics) of tagged predictions (system, repository, split_id, y_true, y_score, y_pred): of
    all of a system's, of each of its repositories and of each split: rows are tripled and all
    levels grouped together, counts in one aggregate and ranks in another."""
    part = {"pooled": F.lit(""), "repository": F.col("repository").cast("string"), "split": F.col("split_id").cast("string")}
    groups = F.array(*(F.struct(F.lit(k).alias("level"), part[k].alias("part")) for k in LEVELS))
    each = rows.select("system", F.inline(groups), "y_true", "y_score", "y_pred")
    return metrics(each, ["system", "level", "part"])


def comparisons(found: DataFrame) -> DataFrame:
    """Each pair of systems of levels() on the splits that both have: compare() and wilcoxon() of each metric that is defined in
    both. Metrics are rounded to nine places, so that equal ones tie."""
    pairs = paired(long_metrics(found.where("level = 'split'"), ["system", "part"]), "system", "part").withColumns({c: F.round(c, 9) for c in ("x", "y")})
    return joined(compare(pairs), wilcoxon(pairs).withColumnRenamed("n", "unequal"), ["metric", "a", "b"], "left")
