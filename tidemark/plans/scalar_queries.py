"""Queries over tidemark.functions.scalars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scalars as s
from tidemark.operators import decisions
from tidemark.plans.registry import query, table

URL_SQL = """urls AS (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN ' https://github.com/' || lower(c_mktsegment) || '/' || c_name || '.git/ ' WHEN 1 THEN 'git@github.com:' || c_mktsegment || '/' || c_name || '.git'
  WHEN 2 THEN 'x\\y\\' || c_name WHEN 3 THEN 'HTTP://GitHub.com/' || c_mktsegment || '/' || c_name || '/' ELSE '' END AS url FROM customer)""".replace("\\\\", "\\")


def urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey") % 5
    url = (
        F.when(k == 0, F.concat(F.lit(" https://github.com/"), F.lower("c_mktsegment"), F.lit("/"), "c_name", F.lit(".git/ ")))
        .when(k == 1, F.concat(F.lit("git@github.com:"), "c_mktsegment", F.lit("/"), "c_name", F.lit(".git")))
        .when(k == 2, F.concat(F.lit("x\\y\\"), "c_name")).when(k == 3, F.concat(F.lit("HTTP://GitHub.com/"), "c_mktsegment", F.lit("/"), "c_name", F.lit("/"))).otherwise("")
    )
    return c.select("c_custkey", url.alias("url"))


@query("p01_repository_from_url", f"""WITH {URL_SQL}, t AS (SELECT c_custkey, regexp_replace(regexp_replace(replace(trim(url), '\\', '/'), '/+$', ''), '\\.git$', '') AS t FROM urls)
SELECT c_custkey, CASE WHEN contains(t, 'github.com/') THEN string_split(t, 'github.com/')[-1] ELSE array_to_string(list_filter(string_split(t, '/'), lambda x: x <> '')[-2:], '/') END AS repository FROM t""")
def p01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls(spark, sf_dir).select("c_custkey", s.repository_from_url(F.col("url")).alias("repository"))


@query("p02_p03_normalized_repository", f"""WITH {URL_SQL}, t AS (SELECT c_custkey, url, regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(trim(url), '\\', '/'), '^(https?://github\\.com/|git@github\\.com:)', '', 'i'), '/+$', ''), '\\.git$', ''), '^/+|/+$', '', 'g') AS repository FROM urls)
SELECT c_custkey, repository, coalesce(nullif(trim(url), ''), 'https://github.com/' || repository || '.git') AS clone_url FROM t""")
def p02(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = urls(spark, sf_dir).withColumn("repository", s.normalized_repository(F.col("url")))
    return out.select("c_custkey", "repository", s.clone_url(F.col("url"), F.col("repository")).alias("clone_url"))


@query("p04_key_normalisation", "SELECT l_orderkey, l_linenumber, trim(' ' || l_orderkey || ' ') AS commit, trim(CAST(l_linenumber AS VARCHAR)) AS filepath FROM lineitem")
def p04(spark: SparkSession, sf_dir: str) -> DataFrame:
    padded = F.concat(F.lit(" "), F.col("l_orderkey").cast("string"), F.lit(" "))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", s.key_text(padded).alias("commit"), s.key_text(F.col("l_linenumber")).alias("filepath"))


PATH_SQL = """paths AS (SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN '/absolute/' || p_partkey || '.yml' WHEN 1 THEN '../' || p_partkey || '.yml' WHEN 2 THEN 'roles/web/tasks/' || p_partkey || '.yml' WHEN 3 THEN 'roles/db/vars/main.yml'
  WHEN 4 THEN 'roles//x/./handlers/main.yml' WHEN 5 THEN 'roles/x/defaults/a b(' || p_partkey || ').yml' WHEN 6 THEN 'meta/tasks/main.yml' ELSE 'playbooks/site.yml' END AS path FROM part)"""


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr("p_partkey", """CASE p_partkey % 8 WHEN 0 THEN concat('/absolute/', p_partkey, '.yml') WHEN 1 THEN concat('../', p_partkey, '.yml') WHEN 2 THEN concat('roles/web/tasks/', p_partkey, '.yml')
        WHEN 3 THEN 'roles/db/vars/main.yml' WHEN 4 THEN 'roles//x/./handlers/main.yml' WHEN 5 THEN concat('roles/x/defaults/a b(', p_partkey, ').yml') WHEN 6 THEN 'meta/tasks/main.yml' ELSE 'playbooks/site.yml' END AS path""")


@query("p05_p06_p07_paths", f"""WITH {PATH_SQL}, t AS (SELECT p_partkey, path, CASE WHEN path NOT LIKE '/%' AND NOT list_contains(string_split(path, '/'), '..') THEN array_to_string(list_filter(string_split(path, '/'), lambda x: x <> '' AND x <> '.'), '/') END AS safe FROM paths)
SELECT p_partkey, safe, CASE WHEN list_contains(string_split(safe, '/'), 'meta') THEN 'meta file' WHEN list_contains(string_split(safe, '/'), 'handlers') THEN 'handlers file' WHEN list_contains(string_split(safe, '/'), 'vars') THEN 'vars file' WHEN list_contains(string_split(safe, '/'), 'defaults') THEN 'defaults file' ELSE '' END AS unsupported,
  list_contains(string_split(safe, '/'), 'tasks') AS wrapped, coalesce(nullif(regexp_replace(trim(path), '[^A-Za-z0-9_.-]+', '_', 'g'), ''), 'unknown') AS component, left(regexp_replace(path, '[^\\p{{L}}\\p{{N}}]', '_', 'g'), 80) AS slug FROM t""")
def p05(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = paths(spark, sf_dir).withColumn("safe", s.safe_path(F.col("path")))
    return out.select("p_partkey", "safe", s.unsupported_reason(F.col("safe")).alias("unsupported"), s.wraps_tasks(F.col("safe")).alias("wrapped"), s.safe_component(F.col("path")).alias("component"), s.slug(F.col("path")).alias("slug"))


@query("p08_short_error", r"""SELECT doc_id, left(coalesce(list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')[-1], ''), 500) AS short_error FROM documents""")
def p08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", s.short_error(F.col("text")).alias("short_error"))


@query("p09_p10_lenient_numbers", """WITH t AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'abc' WHEN 1 THEN 'NaN' WHEN 2 THEN 'Infinity' WHEN 3 THEN '' WHEN 4 THEN CAST(event_id % 7 AS VARCHAR) || '.75' ELSE CAST(event_id % 2 AS VARCHAR) END AS raw, value FROM events)
SELECT event_id, CASE WHEN isfinite(TRY_CAST(raw AS DOUBLE)) THEN TRY_CAST(raw AS DOUBLE) END AS finite, coalesce(CASE WHEN isfinite(TRY_CAST(raw AS DOUBLE)) THEN CAST(trunc(TRY_CAST(raw AS DOUBLE)) AS BIGINT) END, 0)::BIGINT AS whole,
  CASE TRY_CAST(raw AS DOUBLE) WHEN 0 THEN 0 WHEN 1 THEN 1 END::INTEGER AS label, round(CASE WHEN event_id % 3 = 0 THEN 0 ELSE value / (event_id % 3) END, 6) AS ratio FROM t""")
def p09(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    raw = F.when(k % 6 == 0, "abc").when(k % 6 == 1, "NaN").when(k % 6 == 2, "Infinity").when(k % 6 == 3, "").when(k % 6 == 4, F.concat((k % 7).cast("string"), F.lit(".75"))).otherwise((k % 2).cast("string"))
    out = table(spark, sf_dir, "events").withColumn("raw", raw)
    return out.select("event_id", s.finite(F.col("raw")).alias("finite"), s.int_or_zero(F.col("raw")).alias("whole"), s.label01(F.col("raw")).alias("label"), F.round(s.safe_ratio(F.col("value"), k % 3), 6).alias("ratio"))


REPO_SQL = """repos AS (SELECT p_partkey AS id, 'org' || (p_partkey % 50) || '/' || CASE p_partkey % 7 WHEN 0 THEN 'ansible-role-' WHEN 1 THEN 'Playbook-' WHEN 2 THEN 'awesome-' WHEN 3 THEN 'plain-' ELSE 'molecule-' END || (p_partkey % 400) AS full_name, p_name AS description,
  CASE WHEN p_partkey % 4 = 0 THEN ['Ansible-Collection', lower(p_brand)] ELSE [lower(p_type)] END AS topics, p_size * 150 AS stars, p_size * 30 AS forks, DATE '2024-01-01' - CAST(p_partkey % 4000 AS INTEGER) AS pushed_at, p_partkey % 11 = 0 AS archived, p_partkey % 13 = 0 AS disabled,
  CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE 'main' END AS default_branch, p_partkey % 3 + 1 AS queries FROM part),
  b AS (SELECT *, lower(full_name || ' ' || coalesce(description, '') || ' ' || array_to_string(topics, ' ')) AS blob FROM repos)"""


def repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS id", "concat('org', p_partkey % 50, '/', CASE p_partkey % 7 WHEN 0 THEN 'ansible-role-' WHEN 1 THEN 'Playbook-' WHEN 2 THEN 'awesome-' WHEN 3 THEN 'plain-' ELSE 'molecule-' END, p_partkey % 400) AS full_name", "p_name AS description",
        "CASE WHEN p_partkey % 4 = 0 THEN array('Ansible-Collection', lower(p_brand)) ELSE array(lower(p_type)) END AS topics", "p_size * 150 AS stars", "p_size * 30 AS forks", "date_sub(DATE '2024-01-01', CAST(p_partkey % 4000 AS INT)) AS pushed_at", "p_partkey % 11 = 0 AS archived", "p_partkey % 13 = 0 AS disabled",
        "CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE 'main' END AS default_branch", "p_partkey % 3 + 1 AS queries",
    )
    return out.withColumn("blob", F.lower(F.concat_ws(" ", "full_name", F.coalesce("description", F.lit("")), F.array_join("topics", " "))))


_EX = " OR ".join(f"contains(blob, '{w}')" for w in s.EXCLUDED_WORDS)
_SIG = " OR ".join(f"contains(blob, '{w}')" for w in s.SIGNAL_WORDS)
SCORE_SQL = f"round_even(least(stars, 5000) * 1.0::DOUBLE + least(forks, 1000) * 0.5::DOUBLE + queries * 100.0::DOUBLE + greatest(3650 - greatest(DATE '2024-01-01' - pushed_at, 0), 0) / 3650.0::DOUBLE * 250.0::DOUBLE + CASE WHEN {_SIG} THEN 250 ELSE 0 END + CASE WHEN len(list_filter(topics, lambda t: lower(t) LIKE 'ansible%')) > 0 THEN 200 ELSE 0 END, 3)"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repos(spark, sf_dir).withColumns({"tutorial": s.any_of(F.col("blob"), s.EXCLUDED_WORDS), "signal": s.any_of(F.col("blob"), s.SIGNAL_WORDS), "days": s.days_since(F.col("pushed_at"), F.lit("2024-01-01").cast("date"))})
    return out.withColumn("score", s.priority(F.col("stars"), F.col("forks"), F.col("queries"), F.col("days"), F.col("signal"), F.col("topics")))


@query("p11_p12_p13_priority", f"WITH {REPO_SQL} SELECT id, ({_EX}) AS tutorial, ({_SIG}) AS signal, greatest(DATE '2024-01-01' - pushed_at, 0)::INTEGER AS days, {SCORE_SQL} AS score FROM b")
def p11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("id", "tutorial", "signal", "days", "score")


# every fifth description speaks of a role or a collection, in one of the spellings
SAID_SQL = "said AS (SELECT *, CASE id % 10 WHEN 0 THEN blob || ' ansible role' WHEN 5 THEN blob || ' ansible collection' ELSE blob END AS text FROM b)"


@query("p14_selection_reason", f"""WITH {REPO_SQL}, {SAID_SQL} SELECT id, array_to_string(list_filter(['topic search', CASE WHEN queries > 2 THEN 'name search' END, CASE WHEN len(list_filter(topics, lambda t: lower(t) LIKE 'ansible%')) > 0 THEN 'repository has ansible-related topics' END,
  CASE WHEN contains(text, 'ansible-role') OR contains(text, 'ansible role') THEN 'name/description contains ansible-role' END, CASE WHEN contains(text, 'ansible-collection') OR contains(text, 'ansible collection') THEN 'repository appears to be an Ansible collection' END,
  'passed minimum stars and activity filters', 'default branch detected from GitHub metadata'], lambda x: x IS NOT NULL), '; ') AS reason FROM said""")
def p14(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("id") % 10
    text = F.when(k == 0, F.concat("blob", F.lit(" ansible role"))).when(k == 5, F.concat("blob", F.lit(" ansible collection"))).otherwise(F.col("blob"))
    matched = F.array_compact(F.array(F.lit("topic search"), F.when(F.col("queries") > 1, "topic search"), F.when(F.col("queries") > 2, "name search")))
    return repos(spark, sf_dir).select("id", s.selection_reason(matched, F.col("topics"), text).alias("reason"))


@query("f06_candidate_filter", f"""WITH {REPO_SQL}, r AS (SELECT *, CASE WHEN id % 19 = 0 THEN NULL ELSE lower(full_name) END AS k, CASE WHEN id % 19 = 0 THEN 'missing or invalid metadata' WHEN archived THEN 'archived repository' WHEN disabled THEN 'disabled repository' WHEN stars < 500 THEN 'below minimum stars'
  WHEN id % 23 = 0 OR default_branch IS NULL THEN 'missing or invalid metadata' WHEN {_EX} THEN 'likely tutorial' WHEN NOT ({_SIG}) THEN 'no signal' END AS why FROM b),
f AS (SELECT k, min(id) AS first FROM r WHERE why IS NULL GROUP BY 1)
SELECT id, CASE WHEN f.first < id THEN 'duplicate repository' ELSE coalesce(why, 'accepted') END AS outcome FROM r LEFT JOIN f ON r.k = f.k""")
def f06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some repositories have no name, some no address."""
    rows = scored(spark, sf_dir).withColumns({"full_name": F.when(F.col("id") % 19 != 0, F.col("full_name")), "url": F.when(F.col("id") % 23 == 0, "").otherwise("https://host/x")})
    return decisions.candidate_outcomes(rows, "id", 500).select("id", "outcome")


@query("p15_p16_row_status", f"""WITH {PATH_SQL}, t AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 29 = 0 THEN NULL ELSE 'r' END AS repository, CASE WHEN p_partkey % 29 = 1 THEN '' ELSE 'c' END AS commit, CASE WHEN p_partkey % 29 = 2 THEN NULL ELSE path END AS path, CASE WHEN p_partkey % 13 = 0 THEN 'first line' || chr(10) || ' no graph ' || chr(10) || ' ' END AS broken,
  CASE WHEN p_partkey % 17 = 0 THEN 2 ELSE p_partkey % 9 END AS nodes, CASE WHEN p_partkey % 17 = 0 THEN 1 ELSE p_partkey % 7 END AS edges, p_partkey % 17 = 0 AS placeholder FROM part JOIN paths USING (p_partkey)),
u AS (SELECT *, CASE WHEN path NOT LIKE '/%' AND NOT list_contains(string_split(path, '/'), '..') THEN array_to_string(list_filter(string_split(path, '/'), lambda x: x <> '' AND x <> '.'), '/') END AS safe FROM t),
k AS (SELECT *, CASE WHEN list_contains(string_split(safe, '/'), 'meta') THEN 'meta file' WHEN list_contains(string_split(safe, '/'), 'handlers') THEN 'handlers file' WHEN list_contains(string_split(safe, '/'), 'vars') THEN 'vars file' WHEN list_contains(string_split(safe, '/'), 'defaults') THEN 'defaults file' END AS kind,
  CASE WHEN placeholder THEN 'unresolved include/import placeholder graph' WHEN nodes < 3 THEN 'nodes below minimum threshold: ' || nodes || ' < 3' WHEN edges < 2 THEN 'edges below minimum threshold: ' || edges || ' < 2' END AS low FROM u)
SELECT id, CASE WHEN repository IS NULL OR commit = '' OR path IS NULL THEN 'MISSING_REQUIRED_FIELD' WHEN safe IS NULL THEN 'INVALID_FILEPATH' WHEN kind IS NOT NULL THEN 'UNSUPPORTED_FILE_TYPE' WHEN broken IS NOT NULL THEN 'GRAPH_PARSE_FAILURE' WHEN nodes = 0 OR edges = 0 THEN 'EMPTY_GRAPH' WHEN low IS NOT NULL THEN 'LOW_QUALITY_GRAPH' ELSE 'SUCCESS' END AS status,
  CASE WHEN repository IS NULL OR commit = '' OR path IS NULL THEN 'repository/commit/filepath' WHEN safe IS NULL THEN path WHEN kind IS NOT NULL THEN kind WHEN broken IS NOT NULL THEN 'no graph' WHEN nodes = 0 OR edges = 0 THEN '' WHEN low IS NOT NULL THEN low ELSE '' END AS error FROM k""")
def p16(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = paths(spark, sf_dir).selectExpr(
        "p_partkey AS id", "CASE WHEN p_partkey % 29 = 0 THEN NULL ELSE 'r' END AS repository", "CASE WHEN p_partkey % 29 = 1 THEN '' ELSE 'c' END AS commit", "CASE WHEN p_partkey % 29 = 2 THEN NULL ELSE path END AS filepath",
        "CASE WHEN p_partkey % 13 = 0 THEN 'first line\\n no graph \\n ' END AS parse_error", "CASE WHEN p_partkey % 17 = 0 THEN 2 ELSE p_partkey % 9 END AS nodes", "CASE WHEN p_partkey % 17 = 0 THEN 1 ELSE p_partkey % 7 END AS edges", "p_partkey % 17 = 0 AS placeholder",
    )
    return decisions.row_status(rows).select("id", "status", "error")


@query("w05_top_repositories", f"WITH {REPO_SQL}, x AS (SELECT id, {SCORE_SQL} AS score, stars, pushed_at FROM b) SELECT id, score, stars, CAST(pushed_at AS VARCHAR) AS pushed_at FROM x ORDER BY score DESC, stars DESC, pushed_at DESC, id LIMIT 100")
def w05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("id", "score", "stars", F.col("pushed_at").cast("string").alias("pushed_at")).orderBy(F.desc("score"), F.desc("stars"), F.desc("pushed_at"), "id").limit(100)


@query("p17_calendar", "SELECT event_id, year(ts)::INTEGER AS year, strftime(ts, '%Y-%m') AS month, ts > TIMESTAMP '2024-06-01' AS future, year(ts) < 1990 AS before_1990 FROM events")
def p17(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.year("ts").alias("year"), F.date_format("ts", "yyyy-MM").alias("month"), (F.col("ts") > F.lit("2024-06-01").cast("timestamp")).alias("future"), (F.year("ts") < 1990).alias("before_1990"))


@query("p18_p19_buckets_and_sigmoid", "SELECT event_id, CASE WHEN value >= 0 AND value <= 5 THEN '(0, 5]' WHEN value > 5 AND value <= 20 THEN '(5, 20]' WHEN value > 20 AND value <= 100 THEN '(20, 100]' END AS bin, round(1 / (1 + exp(-(value - 20) / 10)), 6) AS score, CASE WHEN 1 / (1 + exp(-(value - 20) / 10)) >= 0.5 THEN 1 ELSE 0 END AS pred FROM events")
def p18(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = s.sigmoid((F.col("value") - 20) / 10)
    return table(spark, sf_dir, "events").select("event_id", s.bucket(F.col("value"), [0, 5, 20, 100]).alias("bin"), F.round(score, 6).alias("score"), F.when(score >= 0.5, 1).otherwise(0).alias("pred"))


@query("p20_text_features", r"""WITH t AS (SELECT doc_id, text, regexp_extract_all(text, '[\p{L}\p{M}\p{N}\p{Pc}]+|\{\{.*?\}\}') AS tokens FROM documents)
SELECT doc_id, length(text)::DOUBLE AS label_length, len(tokens)::DOUBLE AS token_count, round(CASE WHEN len(tokens) > 0 THEN len(list_filter(tokens, lambda x: regexp_matches(x, '[0-9]')))::DOUBLE / len(tokens) ELSE 0 END, 6) AS numeric_fraction,
  CASE WHEN contains(text, '{{') AND contains(text, '}}') THEN 1.0 ELSE 0.0 END::DOUBLE AS has_template, CASE WHEN contains(text, '=') THEN 1.0 ELSE 0.0 END::DOUBLE AS has_equals FROM t""")
def p20(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = s.text_features(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", *(F.round(c, 6).alias(n) if n == "numeric_fraction" else c.alias(n) for n, c in f.items()))


@query("p26_provenance", "SELECT l_orderkey, l_linenumber, 'orders' AS dataset_id, 'v1' AS dataset_version, 3 AS quality_min_nodes, 2 AS quality_min_edges FROM lineitem")
def p26(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.lit("orders").alias("dataset_id"), F.lit("v1").alias("dataset_version"), F.lit(3).alias("quality_min_nodes"), F.lit(2).alias("quality_min_edges"))
