"""Features selected on every split at once: rounds of elimination whose state, the features left, is keyed by split and fold."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import evaluate, models, ranks, trees
from tidemark.shared import stored

#: All training rows of a split; other folds leave one out.
WHOLE = -1


def with_folds(train: DataFrame, cv: int, seed: int) -> DataFrame:
    """train with fold and folds: the rows of each label dealt in turn, in an order of hashes, to as many folds as the
    rarer label has rows, cv at most; fewer than two are none."""
    order = F.xxhash64(F.lit(seed), "split_id", "sample_id")
    rows = train.where("label IS NOT NULL").withColumns({"_order": F.struct(order.alias("a"), F.col("sample_id").alias("b")), "_one": F.lit(1).cast("long")})
    rows = ranks.running(rows, ["split_id", "label"], "_order", ["_one"])
    sizes = train.groupBy("split_id").agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("n")).select("split_id", F.least("p", "n", F.lit(cv)).cast("int").alias("folds"))
    rows = rows.join(sizes, "split_id").withColumn("fold", F.when(F.col("folds") > 1, ((F.col("_one_upto") - 1) % F.col("folds")).cast("int")))
    return rows.drop("_order", "_one", "_one_upto")


def only(x: Column, left: Column) -> Column:
    """x with null for features that are not in left: nothing splits by them."""
    return F.transform(x, lambda v, i: F.when(F.array_contains(left, i), v))


class Forests:
    """Forests over the features left, of every key: what they weigh and how they score rows left out."""

    def __init__(self, rows: DataFrame, judged: DataFrame, keys: list[str], size: int, how: dict):
        self.rows, self.judged, self.keys, self.size, self.how = rows, judged, keys, size, how

    def fit(self, left: DataFrame, n: int, of: str = "round") -> tuple[DataFrame, DataFrame]:
        """(keys, weight) and scored rows (keys, partition, sample_id, y_true, y_score, y_pred, n, of), from left (keys, left), n features each."""
        depth = self.how["depth"]
        masked = lambda df: df.join(left, self.keys).withColumn("x", only(F.col("x"), F.col("left"))).drop("left")
        fits = trees.fit_trees(masked(self.rows), self.keys, self.size, features=max(1, math.isqrt(n)), **self.how)
        scored = trees.tree_scores(masked(self.judged), fits, self.keys, depth).withColumn("y_score", F.col("by_depth")[depth])
        scored = scored.select(*self.keys, "partition", "sample_id", F.col("label").alias("y_true"), "y_score", F.when(F.col("y_score") >= 0.5, 1).otherwise(0).alias("y_pred"))
        return trees.importances(fits, self.keys, self.size), stored(scored.withColumns({"n": F.lit(n), "of": F.lit(of)}))


def select_on_splits(train: DataFrame, held: DataFrame, size: int, *, step: float = 0.1, cv: int = 3, count: int | None = None, seed: int = 42, count_trees: int = 10, depth: int = 5) -> tuple[DataFrame, DataFrame]:
    """(split_id, selector, used: features in order) of rfe, rfecv and validation_rfe on every split, and the rows of
    validation and test scored by the forests over the features selected: (selector, split_id, partition, sample_id, y_true, y_score, y_pred).

    train (split_id, sample_id, label, x of size doubles without null); held also has partition, validation or test.
    A round fits a forest for every split, and every split without one of its folds, and drops the step features of
    least weight (of equal ones the first). rfe stops at count, or half of the features, 20 at most. rfecv takes the
    number of features, of those that rounds pass, with the best mean MCC over folds (0 where it is undefined), fewest of equal ones, and the
    features that the whole training rows leave of it. validation_rfe scores models.candidate_counts() of features, ranked by how long they were
    left, on validation rows by MCC, else F1, else accuracy; fewest of equal ones. Splits with one label are left out;
    all features stay where rfecv has no folds, or validation_rfe no validation rows."""
    keys, how = ["split_id", "fold"], {"trees": count_trees, "depth": depth, "seed": seed}
    dealt = stored(with_folds(train, cv, seed).where("folds > 0"))
    folds = F.concat(F.array(F.lit(WHOLE)), F.when(F.col("folds") > 1, F.sequence(F.lit(0), F.col("folds") - 1)).otherwise(F.array().cast("array<int>")))
    rows = stored(dealt.select("split_id", "sample_id", "label", "x", F.explode(F.filter(folds, lambda f: ~f.eqNullSafe(F.col("fold")))).alias("_f")).withColumnRenamed("_f", "fold"))
    judged = dealt.where("folds > 1").select("split_id", "fold", F.lit("fold").alias("partition"), "sample_id", "label", "x")
    judged = stored(judged.unionByName(held.select("split_id", F.lit(WHOLE).alias("fold"), "partition", "sample_id", "label", "x")))
    forests = Forests(rows, judged, keys, size, how)
    left = rows.select(*keys).distinct().withColumn("left", F.sequence(F.lit(0), F.lit(size - 1)))
    n, by, passed, scored = size, models.stride(size, step), [], None
    while True:
        weight, more = forests.fit(left, n)
        scored = more if scored is None else scored.unionByName(more)
        # those of most weight first, of equal ones the last
        ranked = F.transform(F.reverse(F.array_sort(F.transform("left", lambda i: F.struct(F.coalesce(F.col("weight")[i], F.lit(0.0)).alias("w"), i.alias("i"))))), lambda s: s["i"])
        held_now = stored(left.join(weight, keys, "left").select(*keys, F.array_sort("left").alias("left"), ranked.alias("ranked"), F.lit(n).alias("n")))
        passed.append(held_now)
        if n == 1:
            break
        n = max(1, n - by)
        left = held_now.select(*keys, F.slice("ranked", 1, n).alias("left"))
    every = passed[0]
    for more in passed[1:]:
        every = every.unionByName(more)
    sizes = [size - by * k for k in range(len(passed) - 1)] + [1] if len(passed) > 1 else [size]

    whole = stored(every.where(F.col("fold") == WHOLE).drop("fold"))
    again = Forests(rows.where(F.col("fold") == WHOLE), judged.where(F.col("fold") == WHOLE), keys, size, how)
    named = lambda selector, of, used: (F.lit(selector).alias("selector"), F.lit(of).alias("of") if isinstance(of, str) else of.alias("of"), F.col("m"), used.alias("used"))
    to = max(1, min(size, count or max(1, min(20, size // 2))))
    first = whole.where(F.col("n") == min(k for k in sizes if k >= to)).select("split_id", F.lit(to).alias("m"), F.slice("ranked", 1, to).alias("left"))
    if to not in sizes:
        scored = scored.unionByName(again.fit(first.select("split_id", F.lit(WHOLE).alias("fold"), "left"), to, "rfe")[1])
    out = first.select("split_id", *named("rfe", "round" if to in sizes else "rfe", F.array_sort("left")))
    metrics = evaluate.count_metrics(evaluate.confusion(scored.where("partition <> 'test' AND of = 'round'"), [*keys, "n"]))
    folded = metrics.where(F.col("fold") != WHOLE).groupBy("split_id", "n").agg(F.round(F.avg(F.coalesce("mcc", F.lit(0.0))), 12).alias("score"))
    best = folded.groupBy("split_id").agg(F.max_by("n", F.struct("score", -F.col("n"))).alias("m"))
    best = whole.select("split_id").distinct().join(best, "split_id", "left").withColumn("m", F.coalesce("m", F.lit(size)))
    out = out.unionByName(best.join(whole, "split_id").where("n = m").select("split_id", *named("rfecv", "round", F.col("left"))))
    # ranks by how long a feature was left, of equal ones their own order
    long = whole.select("split_id", "n", F.explode("left").alias("i")).groupBy("split_id", "i").agg(F.min("n").alias("until"))
    order = stored(long.groupBy("split_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("until", "i"))), lambda s: s["i"]).alias("order")))
    counts = models.candidate_counts(size, step)
    extra = [m for m in counts if m not in sizes]
    validated = metrics.where(F.col("fold") == WHOLE).drop("fold")
    for m in extra:  # prefixes that no round passes
        more = again.fit(order.select("split_id", F.lit(WHOLE).alias("fold"), F.slice("order", 1, m).alias("left")), m, "prefix")[1]
        scored = scored.unionByName(more)
        validated = validated.unionByName(evaluate.count_metrics(evaluate.confusion(more.where("partition = 'validation'"), ["split_id", "n"])))
    validated = validated.where(F.col("n").isin(counts)).select("split_id", "n", F.coalesce("mcc", "f1", "accuracy").alias("score"))
    best = validated.groupBy("split_id").agg(F.max_by("n", F.struct(F.round("score", 12), -F.col("n"))).alias("m"))
    best = order.join(best, "split_id", "left").withColumn("m", F.coalesce("m", F.lit(size)))
    of = F.when(F.col("m").isin(sizes), "round").otherwise("prefix")
    out = stored(out.unionByName(best.select("split_id", *named("validation_rfe", of, F.array_sort(F.slice("order", F.lit(1), F.col("m")))))))
    final = scored.where((F.col("fold") == WHOLE) & (F.col("partition") != "fold")).join(out.select("split_id", "selector", "of", F.col("m").alias("n")), ["split_id", "of", "n"])
    return out.select("split_id", "selector", "used"), final.select("selector", "split_id", "partition", "sample_id", "y_true", "y_score", "y_pred")
