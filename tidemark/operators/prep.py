"""Learning data for all splits in one job: balancing, imputation, scaling and Gaussian naive Bayes, keyed by split.

Everything fitted comes from training rows; long form (split_id, partition, sample_id, label, feature, value).
"""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import evaluate, moments, ranks, splits
from tidemark.shared import bounded_batches, measured_broadcasts, stored


#: Rows of a class that are drawn from in one group, about.
DRAWN_FROM = 100_000


def draws_of_buckets(replace: bool, seed: int):
    """How many rows each bucket of a class gives, exactly as if they were drawn one by one from the whole class: by a
    multivariate hypergeometric law without replacement, a multinomial law with it."""

    @F.pandas_udf("array<long>")
    def drawn(many: pd.Series, wanted: pd.Series, key: pd.Series) -> pd.Series:
        out = []
        for n, want, k in zip(many, wanted, key, strict=True):
            rng, n = np.random.default_rng([seed & 0xFFFFFFFF, k & 0xFFFFFFFFFFFFFFFF]), np.asarray(n, dtype=np.int64)
            if replace:
                out.append(rng.multinomial(want, n / n.sum()))
                continue
            given, left = np.zeros_like(n), n.sum()
            for b, size in enumerate(n):
                left -= size
                given[b] = want if not left else rng.hypergeometric(size, left, want) if want else 0
                want -= given[b]
            out.append(given)
        return pd.Series(out)

    return drawn


def balanced(train: DataFrame, strategy: str, seed: int = 42, *, keys: list[str] | None = None, row_id: str = "sample_id") -> DataFrame:
    """Training rows with each class of a split at the size of the smallest (random_undersampling, without
    replacement) or largest (random_oversampling: every class is drawn with replacement). A split of one
    class stays as it is. Draws follow from hashes of seed, split, label and row.

    A class is dealt to buckets of about DRAWN_FROM rows by a hash. How many rows each gives is drawn first; then each
    bucket draws its own, so that no class is put in order in one task. Rows of train are read twice, three times where a
    class has more buckets than one; picks meet them by a shuffle, as they may be as many as the rows."""
    keys = keys or ["split_id"]
    if strategy == "none":
        return train
    if strategy not in ("random_undersampling", "random_oversampling"):
        raise ValueError(f"unknown strategy {strategy}")
    replace = strategy == "random_oversampling"
    within = [*keys, "label", "_bucket"]

    def counted(buckets: int) -> tuple[DataFrame, DataFrame]:
        rows = train.withColumn("_bucket", F.pmod(F.xxhash64(F.lit(seed + 1), *keys, row_id), F.lit(buckets)).cast("int") if buckets > 1 else F.lit(0))
        return rows, stored(rows.groupBy(*within).agg(F.count("*").alias("_m")))

    rows, many = counted(1)
    buckets = -(-(many.agg(F.max("_m")).first()[0] or 0) // DRAWN_FROM) or 1
    if buckets > 1:
        rows, many = counted(buckets)
    many = many.groupBy(*keys, "label").agg(F.array_sort(F.collect_list(F.struct("_bucket", "_m"))).alias("_each"), F.sum("_m").alias("_n"))
    per = Window.partitionBy(*keys)
    many = many.withColumns({"_classes": F.count("*").over(per), "_want": (F.max("_n") if replace else F.min("_n")).over(per)})
    drawn = draws_of_buckets(replace, seed)(F.col("_each._m"), "_want", F.xxhash64(*keys, "label"))
    given = many.withColumn("_given", drawn).select(*keys, "label", "_classes", F.explode(F.arrays_zip(F.col("_each._bucket").alias("b"), F.col("_each._m").alias("m"), F.col("_given").alias("g"))).alias("_x"))
    given = stored(given.select(*keys, "label", F.col("_x.b").alias("_bucket"), F.col("_x.m").alias("_m"), F.when(F.col("_classes") > 1, F.col("_x.g")).alias("_g")))
    # picks, or how many a bucket gives, come behind the rows of their bucket; no _g: each row once
    held = rows.withColumn("_order", F.xxhash64(F.lit(seed), *keys, row_id))
    if replace:
        picks = given.repartition(*within).select(*within, "_m", "_g", F.explode(F.expr("CASE WHEN coalesce(_g, _m) > 0 THEN sequence(1L, coalesce(_g, _m)) END")).alias("_i"))
        at = F.when(F.col("_g").isNull(), F.col("_i")).otherwise(F.pmod(F.xxhash64(F.lit(seed), *within, "_i"), F.col("_m")) + 1)
        given = picks.select(*within, at.cast("int").alias("_drawn")).groupBy(*within, "_drawn").agg(F.count("*").alias("_times"))
    else:
        given = given.select(*within, F.coalesce("_g", "_m").alias("_times"))
    both = held.unionByName(given, allowMissingColumns=True)
    order = Window.partitionBy(*within).orderBy(F.col("_times").isNotNull(), "_order", row_id)
    both = both.withColumn("_at", F.row_number().over(order))
    if not replace:
        out = both.withColumn("_most", F.max("_times").over(Window.partitionBy(*within))).where("_times IS NULL AND _at <= _most")
        return out.select(*train.columns)
    both = both.withColumn("_at", F.coalesce("_drawn", "_at"))
    both = both.withColumn("_most", F.max("_times").over(Window.partitionBy(*within, "_at"))).where("_times IS NULL AND _most > 0")
    return both.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_most")))).select(*train.columns)


def long_features(rows: DataFrame, features: list[str], keys: list[str]) -> DataFrame:
    doubles = rows.select(*keys, *(F.col(c).cast("double").alias(c) for c in features))
    return doubles.unpivot(keys, features, "feature", "value").withColumn("value", F.when(F.isnan("value") | (F.abs("value") == float("inf")), None).otherwise(F.col("value")))


def clean(c: str) -> Column:
    """A feature as a double, null where it is not finite."""
    x = F.col(c).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def fitted_columns(held: Column, every: Column, median: Column) -> list[Column]:
    """median, low, high, mean, std and reason from the state of the values there are, how many rows there are, and the
    median: mean and population deviation are those after imputation."""
    imputed = moments.merged(held, moments.repeated(every - held["n"], median))
    std = F.sqrt(moments.variance(imputed))
    reason = F.when(held["n"] == 0, "all_missing").when(held["low"] == held["high"], "zero_variance")
    return [
        median.alias("median"), held["low"].alias("low"), held["high"].alias("high"), F.when(held["n"] > 0, imputed["mean"]).alias("mean"),
        F.when(held["n"] > 0, F.when(std == 0, 1.0).otherwise(std)).alias("std"), reason.alias("reason"),
    ]


def fitted(train: DataFrame) -> DataFrame:
    """(split_id, feature, median, low, high, mean, std, reason) of training values: features without any value
    or, once imputed, with one value only are removed; mean and population deviation are those after imputation."""
    keys = ["split_id", "feature"]
    counted = train.where("value IS NOT NULL").groupBy(*keys, "value").agg(F.count("*").alias("n"))
    medians = ranks.quantiles(counted, keys, "value", "n", {"median": 0.5})
    held = train.groupBy(*keys).agg(moments.state(F.col("value")).alias("_held"), F.count("*").alias("_all"))
    return held.join(medians, keys, "left").select(*keys, *fitted_columns(F.col("_held"), F.col("_all"), F.col("median")))


#: Rows of a repository up to which its prefixes are fitted in one row of Spark; others go by running states and digits of ranks.
GATHERED = 100_000


def prefix_states(at: np.ndarray, values: np.ndarray, last: np.ndarray) -> np.ndarray:
    """n, mean, m2, low, high and median (NaN of none) of the values at places up to each of last; at and last ascend, NaN is
    no value. A value is put in its place among those before it, and merged with their mean and squares."""
    at, values, held, out = at.tolist(), values.tolist(), [], []
    k, mean, m2 = 0, 0.0, 0.0
    for upto in last.tolist():
        while k < len(at) and at[k] <= upto:
            x, k = values[k], k + 1
            if x == x:
                bisect.insort(held, x)
                apart = x - mean
                mean += apart / len(held)
                m2 += apart * (x - mean)
        n = len(held)
        if n:
            low, high = held[(n - 1) // 2], held[n // 2]
            out.append((n, mean, m2, held[0], held[-1], low + (high - low) / 2))
        else:
            out.append((0.0, 0.0, 0.0, *[np.nan] * 3))
    return np.array(out, dtype=float).reshape(len(out), 6)


@F.pandas_udf(T.ArrayType(T.ArrayType(T.DoubleType())))
def states_of_splits(at: pd.Series, values: pd.Series, last: pd.Series, test: pd.Series) -> pd.Series:
    """For each split of a repository: where its test rows start, how many they are, and prefix_states() of each feature."""
    out = []
    for a, v, upto, t in zip(at, values, last, test, strict=True):
        start, stop = np.searchsorted(a, t, "left"), np.searchsorted(a, t, "right")
        out.append(list(np.column_stack([start, stop - start, *(prefix_states(a, x, upto) for x in v)])))
    return pd.Series(out)


def _prefixes(samples: DataFrame, features: list[str], ratio: float) -> tuple[DataFrame, tuple[DataFrame, DataFrame, DataFrame] | None]:
    """What is fitted to the training rows of every valid walk-forward split: (split_id, fits: array of what prefix_fitted()
    has for each feature, tests: array of test rows) and, or None, (rows, fits as prefix_fitted() has them, splits) of
    repositories of more than GATHERED rows, which are not put in one row."""
    bounded_batches(samples.sparkSession)
    measured_broadcasts(samples.sparkSession)
    rows = stored(samples.select("repository", "commit", "committed_at", "label", *(clean(c).alias(c) for c in features)))
    commits = stored(splits.commit_index(rows))
    valid = splits.walk_forward(rows, ratio, commits).where("reason IS NULL").withColumn("idx", F.col("test_idx") - F.col("val_count") - 1)
    big = stored(commits.groupBy("repository").agg(F.max("n_upto").alias("_n")).where(F.col("_n") > GATHERED).select("repository"))
    large = None
    if big.limit(1).count():
        part = lambda df, how: df.join(F.broadcast(big), "repository", how)  # at most one of GATHERED rows
        many = part(rows, "left_semi").join(commits.select("repository", "commit", "idx"), ["repository", "commit"])
        large = (many, *_ranged_fits(many, part(valid, "left_semi"), features))
        rows, valid = part(rows, "left_anti"), part(valid, "left_anti")
    # places of commits, as commit_index() numbers them; all by repository, so that rows are shuffled once
    first = F.min("committed_at").over(Window.partitionBy("repository", "commit"))
    each = rows.drop("label").repartition("repository").withColumn("_first", first)
    each = each.withColumn("at", F.dense_rank().over(Window.partitionBy("repository").orderBy("_first", "commit")) - 1)
    held = each.where("commit IS NOT NULL").groupBy("repository").agg(F.sort_array(F.collect_list(F.struct("at", *features))).alias("rows"))
    wanted = valid.select("repository", F.struct("idx", "test_idx", "test_commit", F.col("train_size").alias("_all")).alias("w"))
    wanted = wanted.groupBy("repository").agg(F.sort_array(F.collect_list("w")).alias("wanted"))
    of = lambda c: F.transform("rows", lambda r: r[c])
    found = states_of_splits(of("at"), F.array(*map(of, features)), F.transform("wanted", lambda w: w["idx"]), F.transform("wanted", lambda w: w["test_idx"]))
    found = held.join(wanted, "repository").withColumn("found", found)

    def fit(w: Column, i: int) -> Column:
        x = lambda k: F.nanvl(w["found"][2 + 6 * i + k], F.lit(None).cast("double"))
        state = F.struct(*(x(k).alias(name) for k, name in enumerate(("n", "mean", "m2", "low", "high"))))
        return F.struct(F.lit(features[i]).alias("feature"), state.alias("held"), x(5).alias("median"))

    def one(w: Column) -> Column:
        tests = F.when(w["wanted"]["test_commit"].isNotNull(), F.slice("rows", w["found"][0].cast("int") + 1, w["found"][1].cast("int")))
        return F.struct(w["wanted"]["test_idx"].alias("test_idx"), w["wanted"]["_all"].alias("_all"), F.array(*(fit(w, i) for i in range(len(features)))).alias("fits"), tests.alias("tests"))

    small = found.select("repository", F.explode(F.transform(F.arrays_zip("wanted", "found"), one)).alias("s")).select("repository", "s.*")
    return small.withColumn("split_id", splits.split_name()), large


def _ranged_fits(rows: DataFrame, valid: DataFrame, features: list[str]) -> tuple[DataFrame, DataFrame]:
    """What prefix_fitted() gives for rows (with idx) and splits of repositories of any size, by running states over commits and
    medians of prefixes; and the splits."""
    rows, valid = stored(rows), stored(valid.withColumn("split_id", splits.split_name()))
    held = rows.groupBy("repository", "idx").agg(*(moments.state(F.col(c)).alias(c) for c in features))
    fits = valid.select("repository", "split_id", "idx", F.col("train_size").alias("_all")).join(moments.running_states(held, ["repository"], "idx", features), ["repository", "idx"])
    fits = fits.select("repository", "split_id", "idx", "_all", F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).alias("_held")) for c in features))).alias("f"))
    fits = stored(fits.select("repository", "split_id", "idx", "_all", "f.*"))
    values = rows.select("repository", "idx", F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).alias("value")) for c in features))).alias("f")).select("repository", "idx", "f.*").where("value IS NOT NULL")
    last = (F.col("_held.n") - 1).cast("long")
    asked = fits.where("_held.n > 0").select("repository", "split_id", "feature", "idx", F.explode(F.array(F.floor(last / 2), F.ceil(last / 2))).alias("place"))
    middle = ranks.prefix_order(values, asked, ["repository", "feature"], "idx", "value", "place")
    medians = middle.groupBy("split_id", "feature").agg((F.min("value") + (F.max("value") - F.min("value")) / 2).alias("median"))
    fits = fits.join(medians, ["split_id", "feature"], "left")
    return fits.select("split_id", "feature", *fitted_columns(F.col("_held"), F.col("_all"), F.col("median"))), valid


def prefix_fitted(samples: DataFrame, features: list[str], ratio: float = 0.2) -> DataFrame:
    """(split_id, feature, median, low, high, mean, std, reason) as fitted() gives them for the training rows of every
    valid walk-forward split. Those are all rows up to a commit, so each row is read once, whatever splits it trains: by
    repository, or for repositories of more than GATHERED rows by running states over commits and medians of prefixes."""
    small, large = _prefixes(samples, features, ratio)
    out = small.select("split_id", "_all", F.inline("fits")).select("split_id", "feature", *fitted_columns(F.col("held"), F.col("_all"), F.col("median")))
    return out.unionByName(large[1]) if large else out


def prefix_scaled(samples: DataFrame, features: list[str], how: str = "standard", ratio: float = 0.2) -> DataFrame:
    """(split_id, feature, value) of the test rows of every valid walk-forward split: as transformed() gives them by what
    prefix_fitted() fits."""
    small, large = _prefixes(samples, features, ratio)
    fits = small.where("tests IS NOT NULL").select("split_id", "_all", "tests", F.posexplode("fits").alias("_i", "f"))
    fits = fits.select("split_id", "f.feature", F.transform("tests", lambda r: F.array(*(r[c] for c in features))[F.col("_i")]).alias("_values"), *fitted_columns(F.col("f.held"), F.col("_all"), F.col("f.median")))
    out = fits.where("reason IS NULL").select("split_id", "feature", "median", "low", "high", "mean", "std", F.explode("_values").alias("value"))
    out = out.select("split_id", "feature", scaled_value(how).alias("value"))
    if large:
        rows, fitted_to, valid = large
        tests = rows.join(valid.select("repository", F.col("test_commit").alias("commit"), "split_id"), ["repository", "commit"])
        out = out.unionByName(transformed(long_features(tests, features, ["split_id"]), fitted_to, how))
    return out


def transformed(rows: DataFrame, fit: DataFrame, how: str = "standard") -> DataFrame:
    """Values imputed and scaled by what was fitted to their split; removed features are left out."""
    out = rows.join(fit.where("reason IS NULL"), ["split_id", "feature"])
    return out.select(*rows.columns[:-1], scaled_value(how).alias("value"))


def scaled_value(how: str) -> Column:
    """value, imputed and scaled by median, low, high, mean and std."""
    x = F.coalesce("value", "median")
    return {"standard": (x - F.col("mean")) / F.col("std"), "minmax": (x - F.col("low")) / (F.col("high") - F.col("low")), "none": x}[how]


def prefix_bayes(samples: DataFrame, features: list[str], ratio: float = 0.2) -> DataFrame:
    """Test rows of all valid walk-forward splits (split_id, label, y_score, y_pred) by Gaussian naive Bayes.

    What the model needs are means and deviations by label, and training rows of a split are all up to a commit: so
    they are running aggregates over a repository's rows, which are shuffled once, and no training row is spelled out;
    repositories of more than GATHERED rows go by running states over commits. Rows without a value of some feature
    are left out. Variances get 1e-9 of the split's largest feature variance added."""
    rows = samples.where(" AND ".join(f"{f} IS NOT NULL" for f in features)).select("repository", "commit", "committed_at", "label", *(F.col(f).cast("double").alias(f) for f in features))
    rows, large = splits.by_size(rows, GATHERED)
    of = lambda k, c: F.when(F.col("test_idx").isNull() & F.col("commit").isNotNull() & (F.col("label") == k), c)
    over = lambda c: c.over(splits.training())
    found = splits.after_training(rows, ratio)
    # features are taken from a value of the first commit, which all prefixes hold: sums far from zero lose no deviations
    first = F.min(F.when(F.col("test_idx").isNull() & F.col("commit").isNotNull(), F.struct("_at", *features))).over(Window.partitionBy("repository"))
    found = found.withColumn("_c", first).withColumns({f: F.col(f) - F.col(f"_c.{f}") for f in features}).drop("_c")
    found = found.withColumns(
        {f"n{k}": over(F.count(of(k, F.lit(1)))).cast("double") for k in (0, 1)}
        | {f"m{k}_{i}": over(F.avg(of(k, F.col(f)))) for i, f in enumerate(features) for k in (0, 1)}
        | {f"v{k}_{i}": over(F.var_pop(of(k, F.col(f)))) for i, f in enumerate(features) for k in (0, 1)}
    ).where("test_idx IS NOT NULL AND reason IS NULL AND commit IS NOT NULL")
    held = lambda k, i: F.struct(F.col(f"n{k}").alias("n"), F.col(f"m{k}_{i}").alias("mean"), (F.col(f"v{k}_{i}") * F.col(f"n{k}")).alias("m2"), F.col(f"m{k}_{i}").alias("low"), F.col(f"m{k}_{i}").alias("high"))
    whole = [moments.variance(moments.merged(held(0, i), held(1, i))) for i in range(len(features))]
    found = found.withColumns({"eps": _eps(whole), "prior": F.log(F.col("n1") / F.col("n0"))})
    found = found.withColumns({f"v{k}_{i}": F.col(f"v{k}_{i}") + F.col("eps") for i in range(len(features)) for k in (0, 1)})
    out = _bayes_scores(found.withColumn("split_id", splits.split_name()), features)
    return out.unionByName(_ranged_bayes(large, features, ratio)) if large else out


def _eps(variances: list[Column]) -> Column:
    return (F.greatest(*variances) if len(variances) > 1 else variances[0]) * 1e-9


def _bayes_scores(rows: DataFrame, features: list[str]) -> DataFrame:
    """(split_id, label, y_score, y_pred) of rows with prior and, by label and feature, means m<k>_<i> and variances v<k>_<i>."""
    odds = F.col("prior")
    for i, f in enumerate(features):
        far = [F.pow(F.col(f) - F.col(f"m{k}_{i}"), F.lit(2.0)) / F.col(f"v{k}_{i}") for k in (0, 1)]
        odds = odds + 0.5 * (F.log(f"v0_{i}") - F.log(f"v1_{i}") + far[0] - far[1])
    out = rows.select("split_id", "label", (1 / (1 + F.exp(-odds))).alias("y_score"))
    return out.withColumn("y_pred", F.when(F.col("y_score") >= 0.5, 1).otherwise(0))


def _ranged_bayes(rows: DataFrame, features: list[str], ratio: float) -> DataFrame:
    """What prefix_bayes() gives for rows of repositories of any size, by running states over commits."""
    rows = stored(rows)
    found = splits.walk_forward(rows, ratio).where("reason IS NULL")
    found = found.select("repository", splits.split_name().alias("split_id"), F.col("test_commit").alias("commit"), (F.col("test_idx") - F.col("val_count") - 1).alias("idx"))
    index = splits.commit_index(rows).select("repository", "commit", "idx")
    states = {f"s{k}_{i}": moments.state(F.when(F.col("label") == k, F.col(f))) for i, f in enumerate(features) for k in (0, 1)}
    commits = rows.groupBy("repository", "commit").agg(*(c.alias(n) for n, c in states.items())).join(index, ["repository", "commit"])
    fits = found.join(moments.running_states(commits.drop("commit"), ["repository"], "idx", list(states)), ["repository", "idx"])
    whole = [moments.variance(moments.merged(F.col(f"s0_{i}"), F.col(f"s1_{i}"))) for i in range(len(features))]
    fits = fits.withColumns({"eps": _eps(whole), "prior": F.log(F.col("s1_0.n") / F.col("s0_0.n"))})
    each = [(f"s{k}_{i}", f"{k}_{i}") for i in range(len(features)) for k in (0, 1)]
    fits = fits.select("repository", "split_id", "commit", "prior", *(c for s, n in each for c in (F.col(f"{s}.mean").alias(f"m{n}"), (moments.variance(F.col(s)) + F.col("eps")).alias(f"v{n}"))))
    return _bayes_scores(rows.join(fits, ["repository", "commit"]), features)


def ranked_bayes(train: DataFrame, features: list[str], keys: list[str]) -> DataFrame:
    """(keys, prior, ranked) by keys, in one pass over training rows with one column a feature: prior is the log odds of
    label 1; ranked has what Gaussian naive Bayes needs of each feature, fitted after imputing by the median and
    standard scaling, those first whose class means lie furthest apart, to nine places. Features without any value or with one value
    only are left out. Variances get 1e-9 added: scaled, the largest feature variance is 1."""
    aggs = [F.count_if(F.col("label") == k).cast("double").alias(f"_n{k}") for k in (0, 1)]
    for i, c in enumerate(features):
        aggs += [F.percentile(clean(c), 0.5).alias(f"_med{i}"), *(moments.state(F.when(F.col("label") == k, clean(c))).alias(f"_s{k}_{i}") for k in (0, 1))]
    n = [F.col("_n0"), F.col("_n1")]
    fits = train.groupBy(*keys).agg(*aggs).where("_n0 > 0 AND _n1 > 0")
    own = lambda k, i: F.col(f"_s{k}_{i}")
    fits = fits.withColumns({f"_i{k}_{i}": moments.merged(own(k, i), moments.repeated(n[k] - own(k, i)["n"], F.col(f"_med{i}"))) for i in range(len(features)) for k in (0, 1)})
    fits = fits.withColumns({f"_w{i}": moments.merged(F.col(f"_i0_{i}"), F.col(f"_i1_{i}")) for i in range(len(features))})
    fits = fits.withColumns({f"_std{i}": F.sqrt(moments.variance(F.col(f"_w{i}"))) for i in range(len(features))})
    parts = []
    for i, c in enumerate(features):
        std = F.when(F.col(f"_std{i}") == 0, 1.0).otherwise(F.col(f"_std{i}"))
        imputed = [F.col(f"_i{k}_{i}") for k in (0, 1)]
        m = [(imputed[k]["mean"] - F.col(f"_w{i}.mean")) / std for k in (0, 1)]
        v = [moments.variance(imputed[k]) / (std * std) + 1e-9 for k in (0, 1)]
        fit = F.struct((-F.round(F.abs(m[1] - m[0]), 9)).alias("order"), F.lit(c).alias("feature"), F.col(f"_med{i}").alias("median"), F.col(f"_w{i}.mean").alias("mean"), std.alias("std"), *(f(k) for k in (0, 1) for f in (lambda k: m[k].alias(f"m{k}"), lambda k: v[k].alias(f"v{k}"))))
        parts.append(F.when(F.least(own(0, i)["low"], own(1, i)["low"]) < F.greatest(own(0, i)["high"], own(1, i)["high"]), fit))
    return fits.select(*keys, F.log(n[1] / n[0]).alias("prior"), F.array_sort(F.array_compact(F.array(*parts))).alias("ranked"))


def prefix_log_odds(rows: DataFrame, features: list[str]) -> DataFrame:
    """rows with log_odds: of label 1 by the first feature of ranked, by the first two, and so on."""
    values = F.create_map(*(v for c in features for v in (F.lit(c), F.col(c).cast("double"))))

    def step(so_far, f):
        raw = values[f["feature"]]
        raw = F.when(raw.isNull() | F.isnan(raw) | (F.abs(raw) == float("inf")), f["median"]).otherwise(raw)
        z = (raw - f["mean"]) / f["std"]
        gain = 0.5 * (F.log(f["v0"]) - F.log(f["v1"]) + (z - f["m0"]) * (z - f["m0"]) / f["v0"] - (z - f["m1"]) * (z - f["m1"]) / f["v1"])
        return F.concat(so_far, F.array(F.element_at(so_far, -1) + gain))

    odds = F.aggregate("ranked", F.array(F.col("prior")), step)
    return rows.withColumn("log_odds", F.slice(odds, F.lit(2), F.size("ranked")))


def best_prefix(validation: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, size): how many ranked features score best on validation rows (label, log_odds) by MCC, else F1, else
    accuracy; of equal ones the fewest. Every number of features is tried."""
    each = validation.select(*keys, F.col("label").alias("y_true"), F.posexplode("log_odds").alias("_at", "_odds"))
    each = each.withColumn("y_pred", F.when(F.col("_odds") >= 0, 1).otherwise(0)).withColumn("_size", F.col("_at") + 1)
    scored = evaluate.count_metrics(evaluate.confusion(each, [*keys, "_size"])).withColumn("_score", F.coalesce("mcc", "f1", "accuracy"))
    return scored.groupBy(*keys).agg(F.max_by("_size", F.struct("_score", -F.col("_size"))).alias("size"))


def class_weights(rows: DataFrame) -> DataFrame:
    per = rows.groupBy("label").agg(F.count("*").alias("n"))
    return per.select("label", (F.sum("n").over(Window.partitionBy()) / F.greatest("n", F.lit(1))).alias("weight"))


def best_epoch(history: DataFrame, keys: list[str], metric: str, loss: str) -> DataFrame:
    """The epoch of the best metric, or where it is undefined of the least loss; the earliest of equal ones."""
    score = F.coalesce(F.col(metric), -F.col(loss))
    return history.groupBy(*keys).agg(F.max_by("epoch", F.struct(score, -F.col("epoch"))).alias("best_epoch"), F.max(score).alias("best_score"))
