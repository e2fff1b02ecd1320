"""Queries over tidemark.operators.profile."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scalars as s
from tidemark.operators import decisions, profile
from tidemark.plans.audit_queries import JOINED, joined
from tidemark.plans.registry import SAMPLES, query, samples, table


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


def with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples with missing and infinite values, as profiles meet them."""
    return samples(spark, sf_dir).selectExpr("quantity", "CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE price END AS price", "CASE WHEN l_suppkey % 50 = 1 THEN CAST('Infinity' AS DOUBLE) ELSE discount END AS discount", "tax", "1.0D AS constant", "CASE WHEN l_partkey % 20 = 0 THEN 100000D ELSE 0D END AS rare", "label")


GAPS = f"{SAMPLES}, gaps AS (SELECT quantity, CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE price END AS price, CASE WHEN l_suppkey % 50 = 1 THEN 'Infinity'::DOUBLE ELSE discount END AS discount, tax, 1.0::DOUBLE AS constant, CASE WHEN l_partkey % 20 = 0 THEN 100000 ELSE 0 END::DOUBLE AS rare, label FROM samples)"
GAP_COLUMNS = ["quantity", "price", "discount", "tax", "constant", "rare"]
LONG = f"{GAPS}, long AS ({' UNION ALL '.join(f'SELECT {chr(39)}{c}{chr(39)} AS col, {c} AS v FROM gaps' for c in GAP_COLUMNS)}), fin AS (SELECT col, CASE WHEN isfinite(v) THEN v END AS x, v FROM long)"
PROFILE = f"""{LONG}, top AS (SELECT col, max(n) AS top FROM (SELECT col, x, count(*) AS n FROM fin WHERE x IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
prof AS (SELECT f.col, count(x) AS cnt, avg(x) AS mean, var_samp(x) AS var, min(x) AS mn, quantile_cont(x, 0.25) AS q25, quantile_cont(x, 0.5) AS med, quantile_cont(x, 0.75) AS q75, max(x) AS mx, count(*) - count(v) AS missing, count(*) FILTER (isinf(v)) AS infinite,
  count(*) FILTER (x < 0) AS negative, count(*) FILTER (x = 0) AS zero, any_value(top) AS top, count(*) AS n FROM fin f JOIN top t ON f.col = t.col GROUP BY f.col)"""


@query("a01_null_counts", f"WITH {GAPS} SELECT 'price' AS column, count(*) FILTER (price IS NULL) AS nulls, round(count(*) FILTER (price IS NULL) / count(*), 6) AS ratio FROM gaps UNION ALL SELECT 'tax', count(*) FILTER (tax IS NULL), round(count(*) FILTER (tax IS NULL) / count(*), 6) FROM gaps".replace("AS column", 'AS "column"'))
def a01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(profile.null_counts(with_gaps(spark, sf_dir).select("price", "tax")), "ratio")


@query("a01_shape", f"WITH {SAMPLES}, t AS (SELECT quantity, discount, CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE tax END AS tax FROM samples), g AS (SELECT quantity, discount, tax, count(*) AS n FROM t GROUP BY ALL) SELECT sum(n)::BIGINT AS rows, 3 AS columns, sum(n - 1)::BIGINT AS duplicate_rows, coalesce(sum(n) FILTER (quantity IS NULL OR discount IS NULL OR tax IS NULL), 0)::BIGINT AS rows_with_null FROM g")
def a01_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.shape(samples(spark, sf_dir).selectExpr("quantity", "discount", "CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE tax END AS tax"))


@query("a02_label_summary", """WITH l AS (SELECT CASE WHEN doc_id % 17 = 0 THEN 7 ELSE quality END AS raw, CASE WHEN doc_id % 17 <> 0 THEN quality END AS q FROM documents LEFT JOIN labels USING (doc_id))
SELECT count(*) AS rows, count(*) FILTER (q = 0) AS negatives, count(*) FILTER (q = 1) AS positives, count(*) FILTER (q IS NULL) AS missing, count(*) FILTER (raw = 7) AS invalid, round(count(*) FILTER (q = 1) / count(*), 6) AS positive_ratio,
  round(greatest(count(*) FILTER (q = 1), count(*) FILTER (q = 0)) / least(count(*) FILTER (q = 1), count(*) FILTER (q = 0)), 6) AS imbalance FROM l""")
def a02(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return rounded(profile.label_summary(rows, F.when(F.col("doc_id") % 17 == 0, 7).otherwise(F.col("quality"))), "positive_ratio", "imbalance")


REPOS = f"{SAMPLES}, r AS (SELECT repository, count(*) AS rows, count(DISTINCT commit) AS commits, count(*) FILTER (label = 0) AS negatives, count(*) FILTER (label = 1) AS positives FROM samples GROUP BY 1)"


@query("a03_a17_repository_profile", f"WITH {REPOS} SELECT *, CASE WHEN negatives = 0 THEN 'only_positive' WHEN positives = 0 THEN 'only_negative' END AS single_class FROM r")
def a03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.repository_profile(samples(spark, sf_dir))


@query("a03_repository_summary", f"WITH {REPOS} SELECT round(avg(rows), 6) AS mean, median(rows)::DOUBLE AS median, min(rows) AS min, max(rows) AS max, count(*) FILTER (rows < 20) AS lt_20, count(*) FILTER (negatives = 0) AS only_positive, count(*) FILTER (positives = 0) AS only_negative FROM r")
def a03_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = profile.repository_profile(samples(spark, sf_dir))
    return rounded(r.agg(F.avg("rows").alias("mean"), F.median("rows").alias("median"), F.min("rows").alias("min"), F.max("rows").alias("max"), F.count_if(F.col("rows") < 20).alias("lt_20"), F.count_if(F.col("negatives") == 0).alias("only_positive"), F.count_if(F.col("positives") == 0).alias("only_negative")), "mean")


@query("a03_top_repositories", f"WITH {REPOS} SELECT repository, rows, commits FROM r ORDER BY rows DESC, repository LIMIT 20")
def a03_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.ranked_top(profile.repository_profile(samples(spark, sf_dir)), "rows", "repository", 20).select("repository", "rows", "commits")


@query("a05_temporal_profile", f"WITH {SAMPLES} SELECT strftime(committed_at, '%Y-%m') AS month, count(*) AS rows, count(*) FILTER (label = 0) AS label_0, count(*) FILTER (label = 1) AS label_1 FROM samples GROUP BY 1")
def a05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.monthly(samples(spark, sf_dir), "committed_at")


DATED = f"{SAMPLES}, dated AS (SELECT CASE WHEN l_partkey % 8 = 0 THEN 'bad' WHEN l_partkey % 8 = 1 THEN NULL WHEN l_partkey % 50 = 2 THEN '1985-03-04 05:06:07' ELSE strftime(committed_at, '%Y-%m-%d %H:%M:%S') END AS said FROM samples)"


def dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_partkey")
    return samples(spark, sf_dir).select(F.when(k % 8 == 0, "bad").when(k % 8 == 1, F.lit(None)).when(k % 50 == 2, "1985-03-04 05:06:07").otherwise(F.date_format("committed_at", "yyyy-MM-dd HH:mm:ss")).alias("said"))


@query("a05_temporal_summary", f"WITH {DATED}, t AS (SELECT said, TRY_CAST(said AS TIMESTAMP) AS d FROM dated) SELECT count(*) FILTER (said IS NOT NULL AND d IS NULL) AS unparsable, min(d) AS first_at, max(d) AS last_at, count(*) FILTER (d > TIMESTAMP '1997-01-01') AS future, count(*) FILTER (year(d) < 1990) AS before_1990 FROM t")
def a05_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.temporal_summary(dated(spark, sf_dir), "said", F.lit("1997-01-01").cast("timestamp"))


@query("a05_years", f"WITH {DATED}, t AS (SELECT TRY_CAST(said AS TIMESTAMP) AS d FROM dated) SELECT year(d)::INTEGER AS year, count(*) AS rows FROM t WHERE d IS NOT NULL GROUP BY 1")
def a05_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.yearly(dated(spark, sf_dir), "said")


@query("a06_a14_numeric_profile", f"""WITH {PROFILE} SELECT col AS "column", cnt AS count, round(mean, 4) AS mean, round(sqrt(var), 4) AS std, mn AS min, q25, med AS median, q75, mx AS max, missing, infinite, negative, zero, round(zero / cnt, 6) AS zero_ratio, round(var, 2) AS variance, round(top / cnt, 6) AS dominant_ratio, round(missing / n, 6) AS missing_ratio FROM prof""")
def a06(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = profile.numeric_profile(with_gaps(spark, sf_dir), GAP_COLUMNS)
    return rounded(rounded(rounded(out, "zero_ratio", "dominant_ratio", "missing_ratio"), "mean", "std", places=4), "variance", places=2)


WARN = f"""{PROFILE}, rules AS (SELECT col, unnest(list_filter([CASE WHEN missing / n > 0.3 THEN 'missing' END, CASE WHEN infinite > 0 THEN 'infinite' END, CASE WHEN var = 0 THEN 'zero_variance' END, CASE WHEN top / cnt >= 1 THEN 'constant' END, CASE WHEN top / cnt > 0.9 AND top < cnt THEN 'quasi_constant' END, CASE WHEN zero / cnt > 0.9 THEN 'zeros' END], lambda x: x IS NOT NULL)) AS rule FROM prof)
SELECT col AS "column", rule FROM rules UNION ALL SELECT DISTINCT p.col, 'outliers' FROM prof p JOIN fin f ON f.col = p.col WHERE cnt >= 4 AND q75 <> q25 AND (v < q25 - 3 * (q75 - q25) OR v > q75 + 3 * (q75 - q25))"""


@query("a07_numeric_warnings", f"WITH {WARN}")
def a07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.numeric_warnings(with_gaps(spark, sf_dir), GAP_COLUMNS)


@query("a08_family_rollup", f"""WITH {PROFILE}, f AS (SELECT CASE WHEN col IN ('quantity', 'price') THEN 'process' WHEN col IN ('discount', 'tax') THEN 'product' ELSE 'other' END AS family, * FROM prof)
SELECT family, count(*) AS columns, sum(missing)::BIGINT AS missing, round(avg(missing / n), 6) AS mean_missing_ratio, count(*) FILTER (top / cnt >= 1) AS constant, round(avg(mean), 4) AS mean, median(med) AS median, min(mn) AS min, max(mx) AS max FROM f GROUP BY 1""")
def a08(spark: SparkSession, sf_dir: str) -> DataFrame:
    families = {"quantity": "process", "price": "process", "discount": "product", "tax": "product", "constant": "other", "rare": "other"}
    out = profile.family_rollup(profile.numeric_profile(with_gaps(spark, sf_dir), GAP_COLUMNS), families)
    return rounded(rounded(out, "mean_missing_ratio"), "mean", places=4)


@query("a09_coverage", f"""WITH {JOINED}, k AS (SELECT *, CASE WHEN reason IS NULL THEN 1 ELSE 0 END AS ok FROM joined)
SELECT CASE grouping_id(label, repository) WHEN 3 THEN 'all' WHEN 1 THEN 'label' ELSE 'repository' END AS section, coalesce(CAST(label AS VARCHAR), repository, '*') AS key, count(*) AS rows, sum(ok)::BIGINT AS valid, round(sum(ok) / count(*), 6) AS ratio FROM k GROUP BY GROUPING SETS ((), (label), (repository))""")
def a09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(profile.coverage(joined(spark, sf_dir), F.col("reason").isNull()), "ratio")


@query("a09_coverage_by_metrics", f"""WITH {JOINED}, k AS (SELECT *, CASE WHEN coalesce(nodes, 0) <> 0 OR coalesce(TRY_CAST(CASE WHEN edges % 3 = 0 THEN 'x' ELSE CAST(edges AS VARCHAR) END AS DOUBLE), 0) <> 0 THEN 1 ELSE 0 END AS ok FROM joined)
SELECT CASE grouping_id(label, repository) WHEN 3 THEN 'all' WHEN 1 THEN 'label' ELSE 'repository' END AS section, coalesce(CAST(label AS VARCHAR), repository, '*') AS key, count(*) AS rows, sum(ok)::BIGINT AS valid, round(sum(ok) / count(*), 6) AS ratio FROM k GROUP BY GROUPING SETS ((), (label), (repository))""")
def a09_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where no column tells the status: rows with any metric that is a number other than 0."""
    rows = joined(spark, sf_dir).withColumn("said", F.when(F.col("edges") % 3 == 0, "x").otherwise(F.col("edges").cast("string")))
    return rounded(profile.coverage(rows, profile.metric_validity(rows, ["nodes", "said"])), "ratio")


@query("a10_usable_graphs_by_file", f"""WITH {JOINED}, f AS (SELECT DISTINCT '/data/g' || l_partkey || '.xml' AS file FROM lineitem WHERE l_suppkey % 4 > 0), g AS (SELECT *, CASE WHEN l_partkey % 6 = 0 THEN '  ' ELSE '/data/g' || l_partkey || '.xml' END AS path FROM joined),
k AS (SELECT repository, label, coalesce(CASE WHEN trim(path) <> '' AND graph_status = 'SUCCESS' AND path IN (SELECT file FROM f) THEN 1 ELSE 0 END, 0) AS ok FROM g), r AS (SELECT repository, max(ok) AS m FROM k GROUP BY 1)
SELECT 'overall' AS section, 'usable_graphs' AS key, sum(ok)::DOUBLE AS value FROM k UNION ALL SELECT 'overall', 'usable_graph_ratio', round(sum(ok) / count(*), 6) FROM k UNION ALL SELECT 'label', '0', sum(ok) FILTER (label = 0) FROM k UNION ALL SELECT 'label', '1', sum(ok) FILTER (label = 1) FROM k
UNION ALL SELECT 'repositories', 'represented', sum(m) FROM r UNION ALL SELECT 'repositories', 'excluded', sum(1 - m) FROM r""")
def a10_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("/data/g"), "l_partkey", F.lit(".xml"))
    rows = joined(spark, sf_dir).withColumn("path", F.when(F.col("l_partkey") % 6 == 0, "  ").otherwise(name)).drop("status").withColumnRenamed("graph_status", "status")
    files = table(spark, sf_dir, "lineitem").where("l_suppkey % 4 > 0").select(name.alias("file")).distinct()
    return rounded(profile.usable_graphs(decisions.resolved_paths(rows, files, "/none")), "value")


@query("a10_usable_graphs", f"WITH {JOINED}, r AS (SELECT repository, count(*) FILTER (graph_status = 'SUCCESS') AS usable, count(*) AS rows FROM joined GROUP BY 1) SELECT sum(usable)::BIGINT AS usable, sum(rows)::BIGINT AS rows, count(*) FILTER (usable > 0) AS represented, count(*) FILTER (usable = 0) AS excluded_repositories FROM r")
def a10(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = joined(spark, sf_dir).groupBy("repository").agg(F.count_if(F.col("graph_status") == "SUCCESS").alias("usable"), F.count("*").alias("rows"))
    return r.agg(F.sum("usable").alias("usable"), F.sum("rows").alias("rows"), F.count_if(F.col("usable") > 0).alias("represented"), F.count_if(F.col("usable") == 0).alias("excluded_repositories"))


@query("a11_leakage", f"""WITH {SAMPLES}, f AS (SELECT repository, filepath, count(DISTINCT commit) AS c, count(DISTINCT commit) FILTER (label = 0) AS c0, count(DISTINCT commit) FILTER (label = 1) AS c1, count(*) AS n, sum(label) AS pos FROM samples GROUP BY 1, 2), r AS (SELECT repository, count(DISTINCT commit) AS c, count(*) AS n FROM samples GROUP BY 1)
SELECT (SELECT count(*) FROM f WHERE c > 1) AS files_in_several_commits, (SELECT sum(n)::BIGINT FROM f WHERE c > 1) AS rows_affected, (SELECT sum(pos)::BIGINT FROM f WHERE c > 1) AS positives_affected, (SELECT count(*) FROM f WHERE c0 > 1) AS files_in_several_commits_label_0, (SELECT count(*) FROM f WHERE c1 > 1) AS files_in_several_commits_label_1, (SELECT count(*) FROM r WHERE c > 1) AS repositories_of_several_commits, (SELECT sum(n)::BIGINT FROM r WHERE c > 1) AS rows_in_them""")
def a11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.leakage(samples(spark, sf_dir))


CORR = f"""{GAPS}, p AS (SELECT 'quantity' AS a, 'price' AS b, quantity AS x, price AS y FROM gaps WHERE price IS NOT NULL UNION ALL SELECT 'quantity', 'tax', quantity, tax FROM gaps UNION ALL SELECT 'price', 'tax', price, tax FROM gaps WHERE price IS NOT NULL),
k AS (SELECT *, rank() OVER (PARTITION BY a, b ORDER BY x) + (count(*) OVER (PARTITION BY a, b, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY a, b ORDER BY y) + (count(*) OVER (PARTITION BY a, b, y) - 1) / 2 AS ry FROM p)"""


@query("a12_j09_correlations", f"WITH {CORR}, e AS (SELECT avg(CASE WHEN quantity IS NOT DISTINCT FROM price THEN 1.0 ELSE 0.0 END::DOUBLE) AS qp, avg(CASE WHEN quantity = tax THEN 1.0 ELSE 0.0 END::DOUBLE) AS qt, avg(CASE WHEN price IS NOT DISTINCT FROM tax THEN 1.0 ELSE 0.0 END::DOUBLE) AS pt FROM gaps) SELECT a, b, round(corr(x, y), 6) AS pearson, round(corr(rx, ry), 6) AS spearman, round(CASE WHEN b = 'price' THEN (SELECT qp FROM e) WHEN a = 'quantity' THEN (SELECT qt FROM e) ELSE (SELECT pt FROM e) END, 6) AS equal_ratio FROM k GROUP BY 1, 2")
def a12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(profile.correlations(with_gaps(spark, sf_dir), ["quantity", "price", "tax"]), "pearson", "spearman", "equal_ratio")


_STRONG = {"quantity": "quantity", "twice": "quantity * 2", "near": "CASE WHEN l_orderkey % 1000 = 3 THEN quantity + 1 ELSE quantity END", "cubed": "CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE quantity * quantity * quantity END", "tax": "tax"}


def _strong_sql() -> str:
    pairs = [(a, b) for i, a in enumerate(_STRONG) for b in list(_STRONG)[i + 1 :]]
    long = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {a} AS x, {b} AS y FROM w" for a, b in pairs)
    return f"""WITH {SAMPLES}, w AS (SELECT {', '.join(f'({x})::DOUBLE AS {c}' for c, x in _STRONG.items()).replace('l_orderkey', 'o_orderkey')} FROM samples), p AS ({long}), q AS (SELECT a, b, avg(CASE WHEN x IS NOT DISTINCT FROM y THEN 1.0 ELSE 0.0 END::DOUBLE) AS equal_ratio FROM p GROUP BY 1, 2),
k AS (SELECT a, b, x, y, rank() OVER (PARTITION BY a, b ORDER BY x) + (count(*) OVER (PARTITION BY a, b, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY a, b ORDER BY y) + (count(*) OVER (PARTITION BY a, b, y) - 1) / 2 AS ry FROM p WHERE x IS NOT NULL AND y IS NOT NULL),
c AS (SELECT a, b, corr(x, y) AS pearson, corr(rx, ry) AS spearman FROM k GROUP BY 1, 2)
SELECT a, b, round(pearson, 6) AS pearson, round(spearman, 6) AS spearman, round(greatest(abs(pearson), abs(spearman)), 6) AS max_abs, round(equal_ratio, 6) AS equal_ratio, equal_ratio > 0.99 AS near_duplicate FROM c JOIN q USING (a, b) WHERE greatest(abs(pearson), abs(spearman)) > 0.95"""


@query("a12_strong_pairs", _strong_sql())
def a12_strong(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = samples(spark, sf_dir).selectExpr(*(f"CAST({x.replace('l_orderkey', 'o_orderkey')} AS DOUBLE) AS {c}" for c, x in _STRONG.items()))
    return rounded(profile.strong_pairs(profile.correlations(rows, list(_STRONG))), "pearson", "spearman", "max_abs", "equal_ratio")


@query("a13_a16_value_counts", f"WITH {JOINED} SELECT coalesce(graph_status, 'MISSING_STATUS') AS value, count(*) AS n FROM joined GROUP BY 1")
def a13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.value_counts(joined(spark, sf_dir), "graph_status", "MISSING_STATUS")


@query("a18_j07_threshold_grid", f"""WITH {JOINED}, g AS (SELECT n.v AS min_nodes, e.v AS min_edges FROM (SELECT unnest([3, 5, 8]) AS v) n, (SELECT unnest([2, 4, 6]) AS v) e), x AS (SELECT min_nodes, min_edges, repository, label, coalesce(nodes >= min_nodes AND edges >= min_edges, false) AS ok FROM joined, g WHERE graph_status IS NOT NULL)
SELECT min_nodes, min_edges, count(*) FILTER (ok) AS kept, count(*) FILTER (NOT ok) AS removed, round(avg(label) FILTER (ok), 6) AS positive_rate, count(DISTINCT repository) FILTER (ok) AS repositories FROM x GROUP BY 1, 2""")
def a18(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = F.explode(F.array(*(F.struct(F.lit(a).alias("min_nodes"), F.lit(b).alias("min_edges")) for a in (3, 5, 8) for b in (2, 4, 6))))
    x = joined(spark, sf_dir).where("graph_status IS NOT NULL").withColumn("g", grid).select("g.*", "repository", "label", "nodes", "edges").withColumn("ok", F.expr("coalesce(nodes >= min_nodes AND edges >= min_edges, false)"))
    out = x.groupBy("min_nodes", "min_edges").agg(F.count_if("ok").alias("kept"), F.count_if(~F.col("ok")).alias("removed"), F.avg(F.when(F.col("ok"), F.col("label"))).alias("positive_rate"), F.countDistinct(F.when(F.col("ok"), F.col("repository"))).alias("repositories"))
    return rounded(out, "positive_rate")


@query("a18_label_rate_by_bucket", f"WITH {JOINED} SELECT CASE WHEN nodes >= 0 AND nodes <= 3 THEN '(0, 3]' WHEN nodes <= 6 THEN '(3, 6]' WHEN nodes <= 100 THEN '(6, 100]' END AS bin, count(*) AS n, round(avg(label), 6) AS rate FROM joined WHERE nodes IS NOT NULL GROUP BY 1")
def a18_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = joined(spark, sf_dir).where("nodes IS NOT NULL")
    return rounded(rows.groupBy(s.bucket(F.col("nodes"), [0, 3, 6, 100]).alias("bin")).agg(F.count("*").alias("n"), F.avg("label").alias("rate")), "rate")


RUN_SUMMARY = "r AS (SELECT nodes AS min_nodes, edges AS min_edges, count(*) AS runs, sum(label)::BIGINT AS positives FROM joined WHERE nodes IS NOT NULL GROUP BY 1, 2)"


@query("j08_threshold_join", f"""WITH {JOINED}, g AS (SELECT n.v AS min_nodes, e.v AS min_edges FROM (SELECT unnest([3, 5, 8, 99]) AS v) n, (SELECT unnest([2, 4, 6]) AS v) e),
d AS (SELECT min_nodes, min_edges, count(*) FILTER (nodes >= min_nodes AND edges >= min_edges) AS kept FROM joined, g GROUP BY 1, 2), {RUN_SUMMARY}
SELECT d.min_nodes, d.min_edges, kept, runs, positives FROM d LEFT JOIN r ON d.min_nodes = r.min_nodes AND d.min_edges = r.min_edges""")
def j08(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A summary of the dataset at each pair of thresholds, left joined with a summary of runs at the same pair."""
    rows, key = joined(spark, sf_dir), ["min_nodes", "min_edges"]
    grid = F.explode(F.array(*(F.struct(F.lit(a).alias("min_nodes"), F.lit(b).alias("min_edges")) for a in (3, 5, 8, 99) for b in (2, 4, 6))))
    kept = rows.withColumn("g", grid).groupBy("g.min_nodes", "g.min_edges").agg(F.count_if(F.expr("nodes >= g.min_nodes AND edges >= g.min_edges")).alias("kept"))
    runs = rows.where("nodes IS NOT NULL").groupBy(F.col("nodes").alias("min_nodes"), F.col("edges").alias("min_edges")).agg(F.count("*").alias("runs"), F.sum("label").cast("long").alias("positives"))
    return kept.join(runs, key, "left")


@query("a20_seed_stability", "WITH r AS (SELECT event_type, event_id % 5 AS seed, avg(value) AS v FROM events GROUP BY 1, 2) SELECT event_type, 'v' AS metric, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(min(v), 6) AS min, round(max(v), 6) AS max, round(max(v) - min(v), 6) AS range FROM r GROUP BY 1")
def a20(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "events").groupBy("event_type", (F.col("event_id") % 5).alias("seed")).agg(F.avg("value").alias("v"))
    return rounded(profile.stability(runs.drop("seed"), ["event_type"], ["v"]), "mean", "std", "min", "max", "range")
