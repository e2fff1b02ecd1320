"""Queries over preparation, models and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import scalars as s
from tidemark.operators import evaluate, graph, hops, linear, models, prep, search, selection, splits, trees, walks
from tidemark.plans.audit_queries import FEATURES, MEMBERS, status
from tidemark.plans.graph_queries import DEGREES, graphs
from tidemark.plans.profile_queries import rounded
from tidemark.plans.registry import query, samples, table
from tidemark.shared import fixed, measured_broadcasts, stored

# two systems score every event; a split is a user's day of the week
PRED = """pred AS (SELECT sys AS system, 'u' || (user_id % 40) || 'd' || dayofweek(ts) AS split_id, user_id % 7 AS repository, event_id, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS y_true, score AS y_score, CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS y_pred
  FROM (SELECT *, 'a' AS sys, round(1 / (1 + exp(-(value - 20) / 10)), 2) AS score FROM events UNION ALL SELECT *, 'b', round(1 / (1 + exp(-(value - 30 + CASE WHEN event_type = 'purchase' THEN 8 ELSE 0 END) / 10)), 2) FROM events))"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    y = F.when(F.col("event_type") == "purchase", 1).otherwise(0)
    base = e.select("event_id", F.concat(F.lit("u"), F.col("user_id") % 40, F.lit("d"), F.dayofweek("ts") - 1).alias("split_id"), (F.col("user_id") % 7).alias("repository"), y.alias("y_true"), "value")
    systems = F.explode(F.array(F.struct(F.lit("a").alias("system"), ((F.col("value") - 20) / 10).alias("x")), F.struct(F.lit("b").alias("system"), ((F.col("value") - 30 + F.col("y_true") * 8) / 10).alias("x"))))
    out = base.withColumn("s", systems).select("s.system", "split_id", "repository", "event_id", "y_true", F.round(s.sigmoid(F.col("s.x")), 2).alias("y_score"))
    return out.withColumn("y_pred", F.when(F.col("y_score") >= 0.5, 1).otherwise(0))


def metrics_sql(keys: str, source: str = "pred", name: str = "met") -> str:
    on = " AND ".join(f"c.{k.strip()} = r.{k.strip()}" for k in keys.split(","))
    return f"""{name}_c AS (SELECT {keys}, sum(y_true * y_pred)::DOUBLE AS tp, sum((1 - y_true) * y_pred)::DOUBLE AS fp, sum(y_true * (1 - y_pred))::DOUBLE AS fn, sum((1 - y_true) * (1 - y_pred))::DOUBLE AS tn FROM {source} GROUP BY {keys}),
{name}_s AS (SELECT {keys}, y_score, sum(y_true)::DOUBLE AS pos, count(*)::DOUBLE AS n FROM {source} GROUP BY {keys}, y_score),
{name}_w AS (SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS seen, sum(pos) OVER (PARTITION BY {keys}) AS p, sum(n) OVER (PARTITION BY {keys}) AS m FROM {name}_s WINDOW w AS (PARTITION BY {keys} ORDER BY y_score DESC)),
{name}_r AS (SELECT {keys}, sum(pos * tp / seen) / nullif(any_value(p), 0) AS ap, sum((tp - pos) * (n - pos) + 0.5 * pos * (n - pos)) / nullif(any_value(p) * (any_value(m) - any_value(p)), 0) AS auc, any_value(p) AS p, any_value(m) AS m FROM {name}_w GROUP BY {keys}),
{name} AS (SELECT {', '.join('c.' + k.strip() for k in keys.split(','))}, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, tn::BIGINT AS tn, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS precision, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS recall, CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END AS f1, (tp + tn) / (tp + tn + fp + fn) AS accuracy,
  (tp * tn - fp * fn) / nullif(sqrt(tp + fp) * sqrt(tp + fn) * sqrt(tn + fp) * sqrt(tn + fn), 0) AS mcc, CASE WHEN p > 0 AND p < m THEN ap END AS auc_pr, CASE WHEN p > 0 AND p < m THEN auc END AS auc_roc FROM {name}_c c JOIN {name}_r r ON {on})"""


ROUNDED = ", ".join(f"round({m}, 6) AS {m}" for m in evaluate.NAMES)
AVERAGED = ", ".join(f"round(avg({m}), 6) AS {m}" for m in evaluate.NAMES)


@query("v01_v02_v03_v04_split_metrics", f"WITH {PRED}, {metrics_sql('system, split_id')} SELECT system, split_id, tp, fp, fn, tn, {ROUNDED} FROM met")
def v01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.metrics(predictions(spark, sf_dir), ["system", "split_id"]), *evaluate.NAMES)


@query("v05_repository_means", f"WITH {PRED}, {metrics_sql('system, repository, split_id')} SELECT system, repository, {AVERAGED} FROM met GROUP BY 1, 2")
def v05(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = evaluate.metrics(predictions(spark, sf_dir), ["system", "repository", "split_id"])
    return m.groupBy("system", "repository").agg(*(F.round(F.avg(c), 6).alias(c) for c in evaluate.NAMES))


@query("v06_aggregate_metrics", f"WITH {PRED}, {metrics_sql('system, split_id')}, l AS ({' UNION ALL '.join(f'SELECT system, {chr(39)}{m}{chr(39)} AS metric, {m} AS value FROM met' for m in evaluate.NAMES)}) SELECT system, metric, round(avg(value), 6) AS mean, round(median(value), 6) AS median, count(*) - count(value) AS undefined, count(*) AS splits FROM l GROUP BY 1, 2")
def v06(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = evaluate.long_metrics(evaluate.metrics(predictions(spark, sf_dir), ["system", "split_id"]), ["system", "split_id"])
    return rounded(long.groupBy("system", "metric").agg(F.avg("value").alias("mean"), F.median("value").alias("median"), F.count_if(F.col("value").isNull()).alias("undefined"), F.count("*").alias("splits")), "mean", "median")


@query("v07_pooled_metrics", f"WITH {PRED}, {metrics_sql('system')} SELECT system, tp, fp, fn, tn, {ROUNDED} FROM met")
def v07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.metrics(predictions(spark, sf_dir), ["system"]), *evaluate.NAMES)


@query("v07_pooled_by_repository", f"WITH {PRED}, {metrics_sql('system, repository')} SELECT system, repository, tp, fp, fn, tn, {ROUNDED} FROM met")
def v07_repo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.metrics(predictions(spark, sf_dir), ["system", "repository"]), *evaluate.NAMES)


_T = "1 / (1 + 0.3275911 * abs(z) / sqrt(2))"
TAIL_SQL = f"({_T}) * (0.254829592 + ({_T}) * (-0.284496736 + ({_T}) * (1.421413741 + ({_T}) * (-1.453152027 + ({_T}) * 1.061405429)))) * exp(-z * z / 2)"
PAIRS = f"{PRED}, {metrics_sql('system, split_id')}, l AS ({' UNION ALL '.join(f'SELECT system, split_id, {chr(39)}{m}{chr(39)} AS metric, {m} AS value FROM met' for m in evaluate.NAMES)}), pr AS (SELECT x.metric, x.split_id, x.system AS a, y.system AS b, x.value AS x, y.value AS y FROM l x JOIN l y ON x.split_id = y.split_id AND x.metric = y.metric AND x.system < y.system WHERE x.value IS NOT NULL AND y.value IS NOT NULL)"


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = evaluate.long_metrics(evaluate.metrics(predictions(spark, sf_dir), ["system", "split_id"]), ["system", "split_id"])
    # rounded so that equal metrics tie whatever the order of the sums behind them
    return evaluate.paired(long, "system", "split_id").withColumns({c: F.round(c, 9) for c in ("x", "y")})


@query("v08_v11_j05_comparison", f"WITH {PAIRS} SELECT metric, a, b, count(*) AS n, round(avg(x), 6) AS mean_a, round(avg(y), 6) AS mean_b, round(avg(round(y, 9) - round(x, 9)), 6) AS delta, count(*) FILTER (round(y, 9) > round(x, 9)) AS wins, count(*) FILTER (round(y, 9) = round(x, 9)) AS ties, count(*) FILTER (round(y, 9) < round(x, 9)) AS losses FROM pr GROUP BY 1, 2, 3")
def v08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.compare(pairs(spark, sf_dir)), "mean_a", "mean_b", "delta")


@query("v09_wilcoxon", f"""WITH {PAIRS}, d AS (SELECT metric, a, b, round(round(y, 9) - round(x, 9), 12) AS d FROM pr), k AS (SELECT *, rank() OVER (PARTITION BY metric ORDER BY abs(d)) + (count(*) OVER (PARTITION BY metric, abs(d)) - 1) / 2 AS r FROM d WHERE d <> 0),
t AS (SELECT metric, sum(c * c * c - c) AS tie FROM (SELECT metric, abs(d) AS s, count(*)::DOUBLE AS c FROM k GROUP BY 1, 2) GROUP BY 1), g AS (SELECT metric, a, b, count(*) AS n, least(coalesce(sum(r) FILTER (d > 0), 0), coalesce(sum(r) FILTER (d < 0), 0)) AS w FROM k GROUP BY 1, 2, 3)
SELECT metric, a, b, n, w, round(z, 5) AS z, round({TAIL_SQL}, 5) AS p FROM (SELECT *, (w - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - tie / 48) AS z FROM g JOIN t USING (metric))""")
def v09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.wilcoxon(pairs(spark, sf_dir)), "z", "p", places=5)


@query("v09_wilcoxon_of_few", f"""WITH {PAIRS}, d AS (SELECT metric || ':' || string_split(split_id, 'd')[1] AS metric, round(round(y, 9) - round(x, 9), 12) AS d FROM pr),
k AS (SELECT *, rank() OVER (PARTITION BY metric ORDER BY abs(d)) AS r, count(*) OVER (PARTITION BY metric, abs(d)) AS c FROM d WHERE d <> 0),
g AS (SELECT metric, count(*) AS n, max(c) AS ties, least(coalesce(sum(r) FILTER (d > 0), 0), coalesce(sum(r) FILTER (d < 0), 0)) AS w FROM k GROUP BY 1),
s AS (SELECT metric, n, w FROM g WHERE ties = 1 AND n >= 2 AND metric NOT IN (SELECT metric FROM d WHERE d = 0)),
c AS (SELECT metric, n, w, mask, list_sum(list_transform(range(n), lambda i: CASE WHEN (mask >> CAST(i AS INTEGER)) & 1 = 1 THEN i + 1 ELSE 0 END)) AS total FROM s, range(128) m(mask) WHERE mask < (1 << CAST(n AS INTEGER)))
SELECT metric, n, w::DOUBLE AS w, round(least(1.0, 2.0::DOUBLE * count(*) FILTER (total <= w) / (1 << CAST(n AS INTEGER))), 6) AS p FROM c GROUP BY metric, n, w""")
def v09_few(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact p over the days of each user, where no difference is zero or ties."""
    few = pairs(spark, sf_dir).withColumn("metric", F.concat_ws(":", "metric", F.substring_index("split_id", "d", 1)))
    d = few.withColumn("d", F.abs(F.round(F.col("y") - F.col("x"), 12)))
    plain = d.groupBy("metric").agg(F.count("*").alias("n"), F.countDistinct("d").alias("m"), F.min("d").alias("least")).where("n = m AND least > 0 AND n >= 2")
    return evaluate.wilcoxon(few.join(plain.select("metric"), "metric", "left_semi")).select("metric", "n", "w", F.round("p", 6).alias("p"))


CELLS = [(a, b, c) for a in (1, 10, 40) for b in (0, 2, 8) for c in (0, 9)]
GRID = f"""{PRED}, st AS (SELECT system, split_id, count(*) AS size, sum(y_true) AS pos FROM pred GROUP BY 1, 2), g AS (SELECT a AS min_size, b AS min_pos, c AS min_neg FROM (SELECT unnest([1, 10, 40]) AS a), (SELECT unnest([0, 2, 8]) AS b), (SELECT unnest([0, 9]) AS c)),
cells AS (SELECT *, size >= min_size AND pos >= min_pos AND size - pos >= min_neg AS ok FROM st, g), kept AS (SELECT p.*, min_size, min_pos, min_neg FROM pred p JOIN cells USING (system, split_id) WHERE ok),
n AS (SELECT system, min_size, min_pos, min_neg, count(*) FILTER (ok) AS kept_splits, count(*) FILTER (NOT ok) AS removed_splits, coalesce(sum(size) FILTER (ok), 0)::BIGINT AS predictions, coalesce(sum(size) FILTER (NOT ok), 0)::BIGINT AS removed_predictions,
  round(count(*) FILTER (ok) / count(*), 6) AS kept_rate, round(sum(pos) FILTER (ok) / sum(size) FILTER (ok), 6) AS positive_rate FROM cells GROUP BY 1, 2, 3, 4)"""
DELTAS = ", ".join(f"round(met.{m} - whole.{m}, 6) AS delta_{m}" for m in evaluate.NAMES)


@query("v10_f09_split_reliability", f"WITH {GRID}, {metrics_sql('system, min_size, min_pos, min_neg', 'kept')}, {metrics_sql('system', 'pred', 'whole')} SELECT n.*, {', '.join(f'round(met.{m}, 6) AS {m}' for m in evaluate.NAMES)}, {DELTAS} FROM n LEFT JOIN met USING (system, min_size, min_pos, min_neg) JOIN whole ON whole.system = n.system")
def v10(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluate.reliability(predictions(spark, sf_dir), CELLS)
    return rounded(out, "kept_rate", "positive_rate", *evaluate.NAMES, *(f"delta_{m}" for m in evaluate.NAMES))


@query("v07_every_score", f"WITH raw AS (SELECT event_type AS system, CASE WHEN user_id % 3 = 0 THEN 1 ELSE 0 END AS y_true, value AS y_score, CASE WHEN value >= 20 THEN 1 ELSE 0 END AS y_pred FROM events), {metrics_sql('system', 'raw')} SELECT system, tp, fp, fn, tn, {ROUNDED} FROM met")
def v07_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores as they are, nearly all of them different."""
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("system"), F.when(F.col("user_id") % 3 == 0, 1).otherwise(0).alias("y_true"), F.col("value").alias("y_score"), F.when(F.col("value") >= 20, 1).otherwise(0).alias("y_pred"))
    return rounded(evaluate.metrics(rows, ["system"]), *evaluate.NAMES)


@query("v12_a19_test_size_buckets", f"WITH {PRED}, {metrics_sql('system, split_id')}, z AS (SELECT *, tp + fp + fn + tn AS size FROM met) SELECT system, CASE WHEN size >= 0 AND size <= 20 THEN '(0, 20]' WHEN size <= 40 THEN '(20, 40]' WHEN size <= 1000 THEN '(40, 1000]' END AS bin, count(*) AS splits, sum(size)::BIGINT AS predictions, median(size)::DOUBLE AS median_size, round(avg(mcc), 6) AS mcc, round(avg(coalesce(mcc, 0)), 6) AS mcc_zero, count(*) FILTER (tp + fp > tp + fn) AS over_predicting FROM z GROUP BY 1, 2")
def v12(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = evaluate.metrics(predictions(spark, sf_dir), ["system", "split_id"]).withColumn("size", F.expr("tp + fp + fn + tn"))
    out = m.groupBy("system", s.bucket(F.col("size"), [0, 20, 40, 1000]).alias("bin")).agg(F.count("*").alias("splits"), F.sum("size").alias("predictions"), F.median("size").alias("median_size"), F.avg("mcc").alias("mcc"), F.avg(F.coalesce("mcc", F.lit(0.0))).alias("mcc_zero"), F.count_if(F.col("fp") > F.col("fn")).alias("over_predicting"))
    return rounded(out, "mcc", "mcc_zero")


@query("v13_gap_diagnostics", f"WITH {PAIRS} SELECT metric, round(avg(y - x), 6) AS gap, round(corr(x, y), 5) AS corr, count(*) FILTER (round(y, 9) < round(x, 9)) AS lower FROM pr GROUP BY 1")
def v13(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pairs(spark, sf_dir).groupBy("metric").agg(F.round(F.avg(F.col("y") - F.col("x")), 6).alias("gap"), F.round(F.corr("x", "y"), 5).alias("corr"), F.count_if(F.col("y") < F.col("x")).alias("lower"))
    return out


@query("a22_pooled_delta", f"WITH {PRED}, {metrics_sql('system')}, l AS ({' UNION ALL '.join(f'SELECT system, {chr(39)}{m}{chr(39)} AS metric, {m} AS value FROM met' for m in evaluate.NAMES)}) SELECT metric, round(max(value) FILTER (system = 'a'), 6) AS a, round(max(value) FILTER (system = 'b'), 6) AS b, round(max(value) FILTER (system = 'b') - max(value) FILTER (system = 'a'), 6) AS delta FROM l GROUP BY 1")
def a22(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = evaluate.long_metrics(evaluate.metrics(predictions(spark, sf_dir), ["system"]), ["system"])
    wide = long.groupBy("metric").pivot("system", ["a", "b"]).agg(F.max("value"))
    return rounded(wide.withColumn("delta", F.col("b") - F.col("a")), "a", "b", "delta")


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All valid splits spelled out; some prices are missing. Rows are named by all they hold, repeated keys too."""
    rows = samples(spark, sf_dir)
    out = splits.members(rows, splits.walk_forward(rows)).withColumn("price", F.expr("CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE price END"))
    return out.withColumn("sample_id", F.concat_ws("::", "commit", "filepath", "l_partkey", "l_suppkey", "quantity"))


MEMBER_ROWS = f"{MEMBERS}, mm AS (SELECT * REPLACE (CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE price END AS price) FROM m)"
TRAIN_LONG = f"{MEMBER_ROWS}, tl AS ({' UNION ALL '.join(f'SELECT split_id, {chr(39)}{c}{chr(39)} AS feature, {c} AS value FROM mm WHERE partition = {chr(39)}train{chr(39)}' for c in FEATURES)})"
FITTED = f"{TRAIN_LONG}, md AS (SELECT split_id, feature, median(value) AS median, min(value) AS low, max(value) AS high, count(value) AS there FROM tl GROUP BY 1, 2), fit AS (SELECT t.split_id, t.feature, any_value(median) AS median, any_value(low) AS low, any_value(high) AS high, avg(coalesce(value, median)) AS mean, stddev_pop(coalesce(value, median)) AS std, CASE WHEN any_value(there) = 0 THEN 'all_missing' WHEN any_value(low) = any_value(high) THEN 'zero_variance' END AS reason FROM tl t JOIN md ON t.split_id = md.split_id AND t.feature = md.feature GROUP BY 1, 2)"


def balance_counts(spark: SparkSession, sf_dir: str, strategy: str) -> DataFrame:
    """Training rows of each label on every valid split before and after they are drawn, in the task that has a repository's rows."""
    rows = stored(samples(spark, sf_dir).select("repository", "commit", "committed_at", "label", "filepath", "l_partkey", "l_suppkey", "quantity"))
    rows = rows.withColumn("sample_id", F.concat_ws("::", "commit", "filepath", "l_partkey", "l_suppkey", "quantity"))
    small, large = splits.by_size(rows, walks.GATHERED)
    out = walks.balance_counts(small, strategy)
    if large:
        part = splits.members(large, splits.walk_forward(large))
        train = stored(part.where("partition = 'train'").select("split_id", "label", "sample_id"))
        after = prep.balanced(train, strategy).groupBy("split_id", "label").agg(F.count("*").alias("after"))
        out = out.unionByName(train.groupBy("split_id", "label").agg(F.count("*").alias("before")).join(after, ["split_id", "label"]))
    return out


BALANCE = f"WITH {MEMBERS}, cn AS (SELECT split_id, label, count(*) AS n FROM m WHERE partition = 'train' GROUP BY 1, 2) SELECT split_id, label, n AS before, %s(n) OVER (PARTITION BY split_id) AS after FROM cn"


@query("m01_undersampling", BALANCE % "min")
def m01_under(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balance_counts(spark, sf_dir, "random_undersampling")


@query("m01_oversampling", BALANCE % "max")
def m01_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balance_counts(spark, sf_dir, "random_oversampling")


def gappy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples, some of whose prices are missing."""
    return samples(spark, sf_dir).withColumn("price", F.expr("CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE price END"))


@query("m02_m04_fitted_features", f"WITH {FITTED} SELECT split_id, feature, round(median, 4) AS median, round(mean * 1.000000001, 4) AS mean, round(CASE WHEN std = 0 THEN 1 ELSE std END * 1.000000001, 4) AS std, coalesce(reason, 'used') AS reason FROM fit")
def m02(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = prep.prefix_fitted(gappy(spark, sf_dir), FEATURES)
    return out.select("split_id", "feature", F.round("median", 4).alias("median"), *(F.round(F.col(c) * 1.000000001, 4).alias(c) for c in ("mean", "std")), F.coalesce("reason", F.lit("used")).alias("reason"))


def scaled_tests(spark: SparkSession, sf_dir: str, how: str) -> DataFrame:
    out = prep.prefix_scaled(gappy(spark, sf_dir), FEATURES, how)
    return out.groupBy("split_id", "feature").agg(F.count("*").alias("n"), (F.round(F.sum("value"), 4) + 0.0).alias("total"))


SCALED = f"WITH {FITTED}, te AS ({' UNION ALL '.join(f'SELECT split_id, {chr(39)}{c}{chr(39)} AS feature, {c} AS value FROM mm WHERE partition = {chr(39)}test{chr(39)}' for c in FEATURES)}) SELECT te.split_id, te.feature, count(*) AS n, round(sum(SCALED), 4) + 0.0 AS total FROM te JOIN fit ON te.split_id = fit.split_id AND te.feature = fit.feature AND reason IS NULL GROUP BY 1, 2"


@query("m03_scaled_tests", SCALED.replace("SCALED", "(coalesce(value, median) - mean) / std"))
def m03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scaled_tests(spark, sf_dir, "standard")


@query("m03_min_max_tests", SCALED.replace("SCALED", "(coalesce(value, median) - low) / (high - low)"))
def m03_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scaled_tests(spark, sf_dir, "minmax")


@query("m03_unscaled_tests", SCALED.replace("SCALED", "coalesce(value, median)"))
def m03_none(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scaled_tests(spark, sf_dir, "none")


@query("a23_selection_frequency", f"WITH {FITTED} SELECT feature, count(DISTINCT split_id) FILTER (reason IS NULL) AS used, count(DISTINCT split_id) FILTER (reason IS NOT NULL) AS removed FROM fit GROUP BY 1")
def a23(spark: SparkSession, sf_dir: str) -> DataFrame:
    fits = prep.prefix_fitted(gappy(spark, sf_dir), FEATURES)
    return fits.groupBy("feature").agg(F.count_if(F.col("reason").isNull()).alias("used"), F.count_if(F.col("reason").isNotNull()).alias("removed"))


#: far: small differences a long way from zero.
BAYES_FEATURES = ["quantity", "dis", "tx", "price", "far", "day"]


def _bayes_sql() -> str:
    stats = ", ".join(f"sum(CASE WHEN label = {k} THEN 1 ELSE 0 END)::DOUBLE AS n{k}" for k in (0, 1))
    for f in BAYES_FEATURES:
        stats += f", var_pop({f}) AS w_{f}" + "".join(f", avg({f}) FILTER (label = {k}) AS m{k}_{f}, var_pop({f}) FILTER (label = {k}) AS v{k}_{f}" for k in (0, 1))
    gain = " + ".join(f"0.5 * (ln(v0_{f} + eps) - ln(v1_{f} + eps) + pow(te.{f} - m0_{f}, 2) / (v0_{f} + eps) - pow(te.{f} - m1_{f}, 2) / (v1_{f} + eps))" for f in BAYES_FEATURES)
    return f"""WITH {MEMBERS}, x AS (SELECT split_id, partition, label, quantity::DOUBLE AS quantity, round(discount * 100)::DOUBLE AS dis, round(tax * 100)::DOUBLE AS tx, price::DOUBLE AS price, (1000000000 + round(tax * 100))::DOUBLE AS far, date_diff('day', DATE '1970-01-01', committed_at::DATE)::DOUBLE AS day FROM m), tr AS (SELECT split_id, {stats} FROM x WHERE partition = 'train' GROUP BY 1),
e AS (SELECT *, greatest({', '.join(f'w_{f}' for f in BAYES_FEATURES)}) * 1e-9 AS eps FROM tr), o AS (SELECT te.split_id, te.label, ln(n1 / n0) + {gain} AS odds FROM x te JOIN e ON te.split_id = e.split_id WHERE te.partition = 'test')
SELECT split_id, count(*) AS n, sum(label)::BIGINT AS positives, sum(CASE WHEN odds >= 0 THEN 1 ELSE 0 END)::BIGINT AS predicted, round(avg(CASE WHEN odds > 700 THEN 1.0 WHEN odds < -700 THEN 0.0 ELSE 1 / (1 + exp(-odds)) END::DOUBLE), 3) AS mean_score FROM o GROUP BY 1"""


@query("m07_naive_bayes_by_prefix_sums", _bayes_sql())
def m07_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = samples(spark, sf_dir).withColumns({"dis": F.round(F.col("discount") * 100), "tx": F.round(F.col("tax") * 100), "far": 1e9 + F.round(F.col("tax") * 100), "day": F.unix_date(F.col("committed_at").cast("date"))})
    out = prep.prefix_bayes(rows, BAYES_FEATURES)
    return out.groupBy("split_id").agg(F.count("*").alias("n"), F.sum("label").cast("long").alias("positives"), F.sum("y_pred").cast("long").alias("predicted"), F.round(F.avg("y_score"), 3).alias("mean_score"))


GRAPH_FEATURES = [*FEATURES, "nodes", "edges"]
#: Sizes a sample's graph has at least; without: samples without a graph count too.
THRESHOLDS = {"none": None, "3:2": (3, 2), "5:4": (5, 4), "8:6": (8, 6), "10:6": (10, 6)}
#: (sweep, run, strategy, seed, threshold, features): each sweep changes one thing of the first run.
BASE = ("base", "e1", "random_oversampling", 42, "none", FEATURES)
RUNS = [
    BASE,
    *(("balance", x, x, 42, "none", FEATURES) for x in ("none", "random_undersampling")),
    *(("seed", str(x), "random_oversampling", x, "none", FEATURES) for x in (7, 123)),
    *(("threshold", x, "random_oversampling", 42, x, FEATURES) for x in THRESHOLDS if x != "none"),
    ("family", "process", "random_oversampling", 42, "none", ["quantity", "price"]),
    ("family", "product", "random_oversampling", 42, "none", ["discount", "tax"]),
    ("experiment", "e2", "random_oversampling", 42, "none", GRAPH_FEATURES),
]


def swept_rows(spark: SparkSession, sf_dir: str, runs: list[tuple]) -> tuple[DataFrame, DataFrame]:
    """(splits: threshold, split_id, reason) and the samples at every threshold of the runs, which their repositories' names
    begin with. Rows count each, equal ones too."""
    measured_broadcasts(spark)
    rows = samples(spark, sf_dir)
    if any(x[4] != "none" or set(x[5]) - set(FEATURES) for x in runs):
        sizes = status(spark, sf_dir).select("repository", "commit", "filepath", "nodes", "edges")
        rows = rows.join(sizes, ["repository", "commit", "filepath"], "left")
    else:
        rows = rows.withColumns({c: F.lit(None).cast("int") for c in ("nodes", "edges")})
    wanted = {x[4] for x in runs}
    held = [F.when(F.lit(True) if least is None else (F.col("nodes") >= least[0]) & (F.col("edges") >= least[1]), F.lit(x)) for x, least in THRESHOLDS.items() if x in wanted]
    rows = rows.withColumn("threshold", F.explode(F.array_compact(F.array(*held))))
    rows = rows.withColumn("repository", F.concat_ws("|", "threshold", "repository"))
    rows = stored(rows.select("threshold", "repository", "commit", "filepath", "committed_at", "label", "l_partkey", "l_suppkey", *GRAPH_FEATURES))
    name = F.concat("repository", F.lit("__wf_"), F.lpad(F.col("test_idx").cast("string"), 4, "0"))
    all_splits = splits.walk_forward(rows).select(F.substring_index("repository", "|", 1).alias("threshold"), name.alias("split_id"), "reason")
    same = Window.partitionBy("repository", "commit", "filepath", "l_partkey", "l_suppkey", "quantity").orderBy("price", "discount", "tax", "label")
    rows = rows.repartition(walks.tasks(rows), "repository").withColumn("_nth", F.row_number().over(same))
    rows = rows.withColumn("sample_id", F.concat_ws("::", "commit", "filepath", "l_partkey", "l_suppkey", "quantity", "_nth"))
    rows = rows.withColumn("price", F.expr("CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE price END"))
    return all_splits, rows.select("threshold", "repository", "commit", "committed_at", "label", "sample_id", *GRAPH_FEATURES)


def spelled_out(rows: DataFrame) -> DataFrame:
    """Members of all valid splits of rows as swept_rows() has them, stored."""
    part = splits.members(rows, splits.walk_forward(rows))
    return stored(part.select("threshold", "split_id", "partition", "sample_id", "label", *GRAPH_FEATURES))


def swept_members(spark: SparkSession, sf_dir: str, runs: list[tuple]) -> tuple[DataFrame, DataFrame]:
    """(splits: threshold, split_id, reason) and members of the valid ones, at every threshold of the runs."""
    all_splits, rows = swept_rows(spark, sf_dir, runs)
    return all_splits, spelled_out(rows)


def swept(rows: DataFrame, runs: list[tuple]) -> DataFrame:
    """Balance, impute, scale, select and fit naive Bayes on every valid split of every run, each repository's in the task that
    has its rows: walks.bayes() of swept_rows()."""
    small, large = splits.by_size(rows, walks.GATHERED)
    out = walks.bayes(small, GRAPH_FEATURES, [(f"{x[0]}:{x[1]}", *x[2:]) for x in runs])
    if large:
        used, test = swept_keyed(spelled_out(large), runs)
        out = out.unionByName(test, allowMissingColumns=True).unionByName(used, allowMissingColumns=True)
    return out


def sweep(spark: SparkSession, sf_dir: str, runs: list[tuple]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(splits: threshold, split_id of valid ones, reason), (models: run, split_id, used features) and (test rows: run,
    split_id, sample_id, y_true, y_score, y_pred) of swept()."""
    all_splits, rows = swept_rows(spark, sf_dir, runs)
    out = stored(swept(rows, runs))
    return all_splits, out.where("used IS NOT NULL").select("run", "split_id", "used"), out.where("used IS NULL").drop("used")


def swept_keyed(part: DataFrame, runs: list[tuple]) -> tuple[DataFrame, DataFrame]:
    """Models and test rows as sweep() has them, from members of splits in one keyed job: for repositories of any size."""
    keys = ["strategy", "seed", "threshold", "split_id"]
    spark, fits = part.sparkSession, None
    for strategy, seed in dict.fromkeys(x[2:4] for x in runs):
        some = [x[4] for x in runs if x[2:4] == (strategy, seed)]
        train = part.where((F.col("partition") == "train") & F.col("threshold").isin(some))
        train = prep.balanced(train, strategy, seed, keys=["threshold", "split_id"]).withColumns({"strategy": F.lit(strategy), "seed": F.lit(seed)})
        fit = prep.ranked_bayes(train, GRAPH_FEATURES, keys)
        fits = fit if fits is None else fits.unionByName(fit)
    grid = spark.createDataFrame([(f"{x[0]}:{x[1]}", *x[2:]) for x in runs], "run string, strategy string, seed int, threshold string, features array<string>")
    fits = stored(fits).join(F.broadcast(grid), keys[:3]).withColumn("ranked", F.filter("ranked", lambda f: F.array_contains("features", f["feature"])))
    fits = fits.where(F.size("ranked") > 0).select("run", "threshold", "split_id", "prior", "ranked")
    odds = prep.prefix_log_odds(part.where("partition <> 'train'").join(fits, ["threshold", "split_id"]), GRAPH_FEATURES)
    odds = stored(odds.select("run", "split_id", "partition", "sample_id", "label", "log_odds"))
    best = stored(prep.best_prefix(odds.where("partition = 'validation'"), ["run", "split_id"]))
    used = fits.join(best, ["run", "split_id"]).select("run", "split_id", F.expr("transform(slice(ranked, 1, size), f -> f.feature)").alias("used"))
    test = odds.where("partition = 'test'").join(best, ["run", "split_id"]).withColumn("y_score", 1 / (1 + F.exp(-F.element_at("log_odds", F.col("size")))))
    test = test.select("run", "split_id", "sample_id", F.col("label").alias("y_true"), "y_score", F.when(F.col("y_score") >= 0.5, 1).otherwise(0).alias("y_pred"))
    return used, test


@query("m06_m07_walk_forward_bayes")
def m07(spark: SparkSession, sf_dir: str) -> DataFrame:
    test = swept(swept_rows(spark, sf_dir, [BASE])[1], [BASE]).where("used IS NULL")
    return rounded(test.select(F.substring_index("split_id", "|", -1).alias("split_id"), "sample_id", "y_true", "y_score", "y_pred"), "y_score", places=4)


def plain_names(rows: DataFrame) -> DataFrame:
    """rows with names of splits without the threshold that they begin with."""
    return rows.withColumn("split_id", F.substring_index("split_id", "|", -1))


def linear_predictions(rows: DataFrame, features: list[str]) -> DataFrame:
    """Test rows (model, split_id, y_true, y_score, y_pred) of each linear model on every split of swept_rows()."""
    small, large = splits.by_size(rows, walks.GATHERED)
    out = plain_names(walks.linear_predictions(small, features)).drop("sample_id")
    return out.unionByName(linear_keyed(spelled_out(large), features)) if large else out


def linear_keyed(part: DataFrame, features: list[str]) -> DataFrame:
    """linear_predictions() from members of splits, for repositories of any size."""
    train = prep.balanced(part.where("partition = 'train'"), "random_oversampling")
    fits = stored(prep.ranked_bayes(train, features, ["split_id"])).select("split_id", "ranked")
    ready = lambda rows: rows.join(fits, "split_id").select("split_id", F.col("label").alias("y_true"), "label", linear.scaled(features).alias("x"))
    train, test, out = stored(ready(train)), ready(part.where("partition = 'test'")), None
    for kind in linear.LOSSES:
        weights = linear.fit_linear(train, ["split_id"], len(features) + 1, kind)
        scored = linear.score_linear(test, weights, ["split_id"]).withColumn("model", F.lit(kind))
        out = scored if out is None else out.unionByName(scored)
    return out.withColumn("split_id", F.substring_index("split_id", "|", -1))


@query("m06_m08_walk_forward_linear")
def m08_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test metrics of logistic regression and a linear SVM on every valid split: balance, impute, scale and fit, all
    splits in one keyed job."""
    small, large = splits.by_size(swept_rows(spark, sf_dir, [BASE])[1], walks.GATHERED)
    out = plain_names(walks.linear_predictions(small, FEATURES, by_split=True))
    return out.unionByName(evaluate.metrics(linear_keyed(spelled_out(large), FEATURES), ["model", "split_id"])) if large else out


#: Trees of the forests that select features on every split.
FOREST_TREES = 5
#: Trees, and features each node looks at (0: all), of the models of every split.
TREES = {"decision_tree": (1, 0), "random_forest": (10, 2)}


def tree_predictions(rows: DataFrame, features: list[str], kinds: tuple[str, ...] = tuple(TREES)) -> DataFrame:
    """Test rows (model, split_id, y_true, y_score, y_pred) of each model of TREES named on every split of swept_rows()."""
    small, large = splits.by_size(rows, walks.GATHERED)
    out = plain_names(walks.tree_predictions(small, features, {k: TREES[k] for k in kinds})).drop("sample_id")
    return out.unionByName(trees_keyed(spelled_out(large), features, kinds)) if large else out


def trees_keyed(part: DataFrame, features: list[str], kinds: tuple[str, ...] = tuple(TREES)) -> DataFrame:
    """tree_predictions() from members of splits, for repositories of any size."""
    train = prep.balanced(part.where("partition = 'train'"), "random_oversampling")
    fits = stored(prep.ranked_bayes(train, features, ["split_id"])).select("split_id", "ranked")
    ready = lambda rows: rows.join(fits, "split_id").select("split_id", "partition", "sample_id", "label", F.slice(linear.scaled(features), 2, len(features)).alias("x"))
    train, held, out = stored(ready(train)), stored(ready(part.where("partition <> 'train'"))), None
    for kind in kinds:
        count, looked = TREES[kind]
        scored = stored(trees.tree_scores(held, trees.fit_trees(train, ["split_id"], len(features), count, features=looked), ["split_id"]))
        best = trees.best_depth(scored.where("partition = 'validation'"), ["split_id"])
        test = scored.where("partition = 'test'").join(best, "split_id").withColumn("y_score", F.col("by_depth")[F.col("depth")])
        test = test.select(F.lit(kind).alias("model"), F.substring_index("split_id", "|", -1).alias("split_id"), F.col("label").alias("y_true"), "y_score", F.when(F.col("y_score") >= 0.5, 1).otherwise(0).alias("y_pred"))
        out = test if out is None else out.unionByName(test)
    return out


@query("m06_m08_m09_walk_forward_trees")
def m08_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test metrics of a decision tree and a random forest on every valid split: balance, impute and fit all splits level
    by level in one keyed job, each cut at the depth of 1 to 5 that scores best on its validation rows."""
    small, large = splits.by_size(swept_rows(spark, sf_dir, [BASE])[1], walks.GATHERED)
    out = plain_names(walks.tree_predictions(small, FEATURES, TREES, by_split=True))
    return out.unionByName(evaluate.metrics(trees_keyed(spelled_out(large), FEATURES), ["model", "split_id"])) if large else out


def ready_rows(part: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Balanced training rows, and those of validation and test, of members of splits, as x: imputed and scaled features."""
    train = prep.balanced(part.where("partition = 'train'"), "random_oversampling")
    fits = stored(prep.ranked_bayes(train, FEATURES, ["split_id"])).select("split_id", "ranked")
    ready = lambda rows: stored(rows.join(fits, "split_id").select("split_id", "partition", "sample_id", "label", F.slice(linear.scaled(FEATURES), 2, len(FEATURES)).alias("x")))
    return ready(train), ready(part.where("partition <> 'train'"))


@query("m05_m06_selection_on_every_split")
def m05_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What rfe, rfecv and validation_rfe select on every valid split, and how the forest over it scores on the test rows."""
    small, large = splits.by_size(swept_rows(spark, sf_dir, [BASE])[1], walks.GATHERED)
    out = walks.selected(small, FEATURES, count_trees=FOREST_TREES)
    return plain_names(out.unionByName(selected_keyed(spelled_out(large))) if large else out)


def selected_keyed(part: DataFrame) -> DataFrame:
    """m05_splits() from members of splits, for repositories of any size."""
    used, scored = selection.select_on_splits(*ready_rows(part), len(FEATURES), count_trees=FOREST_TREES)
    names = F.array(*map(F.lit, FEATURES))
    used = used.select("split_id", "selector", F.array_join(F.transform("used", lambda i: F.get(names, i)), ",").alias("used"))
    return used.join(evaluate.metrics(scored.where("partition = 'test'"), ["selector", "split_id"]), ["selector", "split_id"])


@query("m06_m09_search_on_every_split")
def m09_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test metrics of each model on every valid split, by the best of ten configurations drawn, and which it was. Forests grow all
    the trees of a configuration, 100, 200 or 400."""
    small, large = splits.by_size(swept_rows(spark, sf_dir, [BASE])[1], walks.GATHERED)
    out = walks.searched(small, FEATURES)
    if large:
        found = stored(search.search_on_splits(*ready_rows(spelled_out(large)), len(FEATURES)))
        chosen = found.select("model", "split_id", "parameters", "validation_score").distinct()
        out = out.unionByName(evaluate.metrics(found, ["model", "split_id"]).join(chosen, ["model", "split_id"]))
    return plain_names(out)


@query("a21_v14_feature_family_sweep")
def v14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pooled metrics, rates, valid and skipped splits and feature usage of each run: a configuration column through one job."""
    all_splits, used, test = sweep(spark, sf_dir, RUNS)
    test = stored(test)
    rates = test.groupBy("run").agg(F.avg("y_true").alias("true_rate"), F.avg("y_pred").alias("predicted_rate"), F.countDistinct("split_id").alias("splits"))
    counts = all_splits.groupBy("threshold").agg(F.count("*").alias("_all"))
    usage = used.select("run", F.explode("used").alias("feature")).groupBy("run", "feature").agg(F.count("*").alias("n"))
    usage = usage.groupBy("run").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "feature", F.col("n").cast("string")))), ",").alias("feature_usage"))
    grid = spark.createDataFrame([(f"{x[0]}:{x[1]}", *x[2:5], len(x[5])) for x in RUNS], "run string, strategy string, seed int, threshold string, feature_count int")
    out = grid.join(counts, "threshold", "left").join(evaluate.metrics(test, ["run"]), "run", "left").join(rates, "run", "left").join(usage, "run", "left")
    splits_used = F.coalesce("splits", F.lit(0))
    return out.withColumn("skipped_splits", F.coalesce("_all", F.lit(0)) - splits_used).withColumn("splits", splits_used).drop("_all")


def temporal(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Train, validation and test by time over the whole sample table, which is joined and written once: fits read it many times."""
    rows = stored(samples(spark, sf_dir).select("repository", "commit", "filepath", "committed_at", F.col("label").cast("double"), *FEATURES, (F.col("l_partkey") % 100).cast("double").alias("part")))
    bounds = rows.agg(F.percentile_approx(F.unix_timestamp("committed_at"), [0.7, 0.85], 10_000).alias("q")).first()["q"]
    t = F.unix_timestamp("committed_at")
    return rows.where(t <= bounds[0]), rows.where((t > bounds[0]) & (t <= bounds[1])), rows.where(t > bounds[1])


@query("m08_m10_models")
def m08(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, _, test = temporal(spark, sf_dir)
    rows = None
    for name in models.MODELS:
        part = models.fit_and_score(name, train, test, FEATURES).select(F.lit(name).alias("model"), F.col("label").cast("int").alias("y_true"), "y_pred", "y_score")
        rows = part if rows is None else rows.unionByName(part)
    return evaluate.metrics(stored(rows), ["model"])


@query("m09_parameter_search")
def m09(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of ten configurations of each model, or of its whole grid, refitted and tested: a row for each model."""
    train, validation, test = map(fixed, temporal(spark, sf_dir))
    rows, found = None, []
    for name in models.SPACE:
        best, score = models.search(name, train, validation, FEATURES)
        found.append((name, float(score), str(sorted(best.items()))))
        part = models.fit_and_score(name, train.unionByName(validation), test, FEATURES, **best).select(F.lit(name).alias("model"), F.col("label").cast("int").alias("y_true"), "y_pred", "y_score")
        rows = part if rows is None else rows.unionByName(part)
    found = spark.createDataFrame(found, "model string, validation_score double, parameters string")
    return evaluate.metrics(stored(rows), ["model"]).join(F.broadcast(found), "model")


@query("m05_feature_selection")
def m05(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each selector keeps each feature."""
    train, validation, _ = temporal(spark, sf_dir)
    train, validation = fixed(train), fixed(validation)
    names, fits = [*FEATURES, "part"], {}
    found = [(m, f, f in chosen) for m in models.SELECTORS for chosen in [models.select_features(train, validation, names, method=m, fits=fits)] for f in names]
    return train.agg(F.count("*").alias("train_rows")).crossJoin(spark.createDataFrame(found, "selector string, feature string, selected boolean"))


@query("m11_best_epoch", "WITH h AS (SELECT user_id % 50 AS run, event_id % 20 AS epoch, avg(value) AS loss, CASE WHEN event_id % 20 > 12 THEN NULL ELSE round(avg(value) / 100, 3) END AS mcc FROM events GROUP BY 1, 2), x AS (SELECT *, coalesce(mcc, -loss) AS score FROM h) SELECT run, epoch AS best_epoch, round(score, 6) AS best_score FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY score DESC, epoch) AS n FROM x) WHERE n = 1")
def m11(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 50).alias("run"), (F.col("event_id") % 20).alias("epoch")).agg(F.avg("value").alias("loss"))
    h = h.withColumn("mcc", F.when(F.col("epoch") <= 12, F.round(F.col("loss") / 100, 3)))
    return rounded(prep.best_epoch(h, ["run"], "mcc", "loss"), "best_score")


@query("g18_class_weights", "WITH c AS (SELECT quality AS label, count(*) AS n FROM labels GROUP BY 1) SELECT label, round(sum(n) OVER () / greatest(n, 1), 6) AS weight FROM c")
def g18(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(prep.class_weights(table(spark, sf_dir, "labels").select(F.col("quality").alias("label"))), "weight")


@query("g17_graph_classifier")
def g17(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graphs by pooled features of hops 0 to 2, whether they have an even id, by weighted logistic regression."""
    nodes, edges = graphs(spark, sf_dir)
    columns = ["degree_in", "degree_out", "label_length"]
    hop = graph.node_features(nodes, edges).select("graph_id", "node_id", *(F.col(c).cast("double").alias(c) for c in columns))
    pooled, near = None, graph.adjacency(edges)
    for k in range(3):
        part = graph.readout(hop, columns)
        part = part.select("graph_id", *(F.col(c).alias(f"h{k}_{c}") for c in part.columns[1:]))
        pooled = part if pooled is None else pooled.join(part, "graph_id")
        hop = graph.propagated(hop, near, columns, "mean")
    names = pooled.columns[1:]
    rows = pooled.withColumn("label", (F.col("graph_id") % 2 == 0).cast("double"))
    train = rows.where("graph_id % 5 != 0")
    weighted = train.join(F.broadcast(prep.class_weights(train.select("label"))), "label")
    out = models.fit_and_score("logistic_regression", weighted, rows.where("graph_id % 5 = 0"), names, weightCol="weight")
    return out.select("graph_id", F.col("label").cast("int").alias("y_true"), "y_pred", "y_score")


GRAPH_COLUMNS = ["degree_in", "label_length"]
GRAPH_PENALTIES = [0.1, 1.0, 10.0]


def graph_samples(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Samples, each with the graph of one conversation, and the nodes' features and edges of the graphs."""
    nodes, edges = graphs(spark, sf_dir)
    count = table(spark, sf_dir, "conversations").agg(F.countDistinct("conv_id").alias("_graphs"))
    rows = samples(spark, sf_dir).crossJoin(F.broadcast(count)).withColumn("graph_id", F.pmod(F.col("o_orderkey") + F.col("l_linenumber"), F.col("_graphs")))
    rows = rows.withColumn("sample_id", F.concat_ws("::", "commit", "filepath", "l_partkey", "l_suppkey"))
    known = nodes.select("graph_id").distinct()
    rows = rows.select("repository", "commit", "committed_at", "label", "sample_id", "graph_id").join(known, "graph_id", "left_semi")
    return stored(rows), graph.node_features(nodes, edges).select("graph_id", "node_id", *GRAPH_COLUMNS), graph.adjacency(edges)


@query("g17_split_scales", f"""WITH {DEGREES}, {MEMBERS}, g AS (SELECT count(DISTINCT conv_id) AS graphs FROM conversations), x AS (SELECT graph_id, degree_in::DOUBLE AS degree_in, length(label)::DOUBLE AS label_length FROM deg),
tr AS (SELECT split_id, x.* FROM m CROSS JOIN g JOIN x ON x.graph_id = (o_orderkey + l_linenumber) % graphs WHERE partition = 'train')
SELECT split_id, count(*) AS nodes, {', '.join(f"round(avg({c}) * 1.000000001, 6) AS m_{c}, round(CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END, 6) AS d_{c}" for c in GRAPH_COLUMNS)} FROM tr GROUP BY 1""")
def g17_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and deviation of node features over the training graphs of every valid split. Means are whole numbers over small
    ones, so they are moved off the halves of the last place before rounding."""
    rows, features, adjacent = graph_samples(spark, sf_dir)
    found = hops.split_scales(rows, hops.hop_table(features, adjacent, GRAPH_COLUMNS, 0), GRAPH_COLUMNS)
    names = [f"{p}_{c}" for c in GRAPH_COLUMNS for p in "md"]
    found = found.withColumns({f"m_{c}": F.col(f"m_{c}") * 1.000000001 for c in GRAPH_COLUMNS})
    return rounded(found.select("split_id", "nodes", *names), *names)


#: Graphs up to which every task gets the table of hops.
GRAPHS_AT_HAND = 50_000


def graph_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, features, adjacent = graph_samples(spark, sf_dir)
    found = stored(hops.hop_table(features, adjacent, GRAPH_COLUMNS))
    if found.count() > GRAPHS_AT_HAND:
        return graph_keyed(rows, found)
    small, large = splits.by_size(rows, walks.GATHERED)
    out = walks.graph_predictions(small, found, GRAPH_COLUMNS, GRAPH_PENALTIES)
    return out.unionByName(graph_keyed(large, found).select(*out.columns)) if large else out


def graph_keyed(rows: DataFrame, found: DataFrame) -> DataFrame:
    """graph_predictions() from members of splits, for repositories of any size and any number of graphs."""
    scales = stored(hops.split_scales(rows, found, GRAPH_COLUMNS))
    each = stored(hops.split_graphs(rows, found, scales, GRAPH_COLUMNS))
    return hops.classified(each, 1 + 3 * 2 * len(GRAPH_COLUMNS), GRAPH_PENALTIES)


@query("g17_walk_forward_graphs")
def g17_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graphs of the test commit of every valid split, by weighted logistic regression over readouts of hops 0 to 2."""
    out = graph_predictions(spark, sf_dir)
    return rounded(out.select("split_id", "sample_id", "y_true", "y_score", "y_pred", "penalty"), "y_score", places=4)


LEVEL_SQL = f"""{PRED}, lv AS (SELECT system, 'pooled' AS level, '' AS part, y_true, y_score, y_pred FROM pred UNION ALL SELECT system, 'repository', repository::VARCHAR, y_true, y_score, y_pred FROM pred UNION ALL SELECT system, 'split', split_id, y_true, y_score, y_pred FROM pred), {metrics_sql('system, level, part', 'lv')}"""


@query("v14_benchmark_levels", f"WITH {LEVEL_SQL} SELECT system, level, part, tp, fp, fn, tn, {ROUNDED} FROM met")
def v14_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The levels of the full benchmark over the two systems that score events."""
    return rounded(evaluate.levels(predictions(spark, sf_dir)), *evaluate.NAMES)


def benchmark_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(system, repository, split_id, y_true, y_score, y_pred) of every model on every valid split, written once: tabular features
    (e1), those with sizes of graphs (e2) and hops of graphs (e3). The decision tree stands for the trees."""
    runs = [BASE, next(x for x in RUNS if x[0] == "experiment")]
    rows = swept_rows(spark, sf_dir, runs)[1]
    bayes = swept(rows, runs).where("used IS NULL")
    named = {"base:e1": "e1:naive_bayes", "experiment:e2": "e2:naive_bayes"}
    columns = ["split_id", "y_true", "y_score", "y_pred"]
    tag = lambda rows, system: rows.select(system.alias("system"), *columns)
    out = tag(bayes.withColumn("split_id", F.substring_index("split_id", "|", -1)), F.element_at(F.create_map(*(F.lit(v) for kv in named.items() for v in kv)), F.col("run")))
    for experiment, features in (("e1", FEATURES), ("e2", GRAPH_FEATURES)):
        out = out.unionByName(tag(linear_predictions(rows, features), F.concat(F.lit(f"{experiment}:"), "model")))
    out = out.unionByName(tag(tree_predictions(rows, FEATURES, ("decision_tree",)), F.concat(F.lit("e1:"), "model")))
    out = out.unionByName(tag(graph_predictions(spark, sf_dir), F.lit("e3:graph_hops")))
    return stored(out.withColumn("repository", F.regexp_extract("split_id", "^(.*)__wf_", 1)))


@query("v14_full_benchmark")
def v14_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(level, system, other, part, metric, value): metrics of each system, pooled, by repository and by split, and for each pair
    of systems, at level comparison with part naming the figure, how they differ on the splits that both have."""
    found = stored(evaluate.levels(benchmark_predictions(spark, sf_dir)))
    own = evaluate.long_metrics(found, ["level", "system", "part"]).withColumn("other", F.lit(None).cast("string"))
    pairs = evaluate.comparisons(found).withColumnsRenamed({"a": "system", "b": "other"})
    figures = [c for c in pairs.columns if c not in ("metric", "system", "other")]
    pairs = pairs.withColumns({c: F.col(c).cast("double") for c in figures}).unpivot(["metric", "system", "other"], figures, "part", "value").withColumn("level", F.lit("comparison"))
    return rounded(own.unionByName(pairs).select("level", "system", "other", "part", "metric", "value"), "value")
