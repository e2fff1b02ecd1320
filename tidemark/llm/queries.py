"""The registered queries of this subpackage, and their SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import op1_ngram_join, op2_tokens, op3_quality, op4_html, op5_urls, op6_mixing, op7_chat, op8_decontamination, op9_sharding, op10_warc, op11_rtree, op12_bitplanes, op13_digest_index
from tidemark.llm.text import n_words, utf8_bytes
from tidemark.shared import stored


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_similar_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return op1_ngram_join.similar_components(docs, keep=["doc_id"])


OP1_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
u AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
r AS (SELECT x AS node, x AS label FROM (SELECT DISTINCT x FROM u) UNION SELECT u.y, r.label FROM r JOIN u ON r.node = u.x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(l.label, d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT node AS doc_id, min(label) AS label FROM r GROUP BY 1) l USING (doc_id)
"""


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return op2_tokens.count_tokens(docs, public_tokenizers.path("word_bpe_49k.json")).drop("text")


def op3_quality_llr(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    trusted = labels.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic")).where("quality = 1 AND coalesce(toxic, 0) = 0")
    out = op3_quality.judge(docs.select("doc_id", "text"), trusted, keep=["doc_id"])
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_html.extract_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, fetched on a day that follows from page_id, against a list that follows from their hosts."""
    pages = table(spark, sf_dir, "pages")
    day = F.date_add(F.lit("2023-01-01").cast("date"), F.pmod("page_id", F.lit(730)).cast("int"))
    captures = pages.select("page_id", "url", day.alias("fetched_at"))
    hosts = captures.select(op5_urls.host_of(F.col("url")).alias("host")).where("host != ''").distinct()
    seed = F.conv(F.substring(F.md5("host"), 1, 6), 16, 10).cast("int")
    listed = hosts.where(F.pmod(seed, F.lit(3)) == 0).select(
        "host", F.element_at(F.array(*map(F.lit, ("adult", "phishing", "spam"))), F.pmod(seed, F.lit(5)) % 3 + 1).alias("category"),
        F.explode(F.array(*(F.struct(F.lit(k).alias("k"), (F.pmod(seed, F.lit(97 + k)) + 150 * k).alias("on")) for k in range(4)))).alias("e"),
    )
    entries = listed.select(
        F.when(F.col("e.k") < 3, F.col("host")).otherwise(F.concat("host", F.lit("/en/"))).alias("pattern"), "category",
        F.date_add(F.lit("2023-01-01").cast("date"), F.col("e.on")).alias("listed_at"), (F.col("e.k") != 1).alias("listed"),
    )
    return op5_urls.filter_urls(captures, entries).select("page_id", "fetched_at", "url_host", "n_active", "blocked", "matched", "category")


OP5_SQL = r"""
WITH caps AS (SELECT page_id, url, DATE '2023-01-01' + CAST(page_id % 730 AS INTEGER) AS fetched_at,
    lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host,
    regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path FROM pages),
hosts AS (SELECT host, CAST(('0x' || substr(md5(host), 1, 6)) AS BIGINT) AS seed FROM (SELECT DISTINCT host FROM caps WHERE host <> '')),
entries AS (SELECT CASE WHEN k < 3 THEN host ELSE host || '/en/' END AS pattern,
    CASE (seed % 5) % 3 WHEN 0 THEN 'adult' WHEN 1 THEN 'phishing' ELSE 'spam' END AS category,
    DATE '2023-01-01' + CAST(seed % (97 + k) + 150 * k AS INTEGER) AS listed_at, k <> 1 AS listed
    FROM hosts, range(4) t(k) WHERE seed % 3 = 0),
days AS (SELECT pattern, listed_at, bool_and(listed) AS listed, min(category) AS category FROM entries GROUP BY 1, 2),
spans AS (SELECT *, lead(listed_at) OVER (PARTITION BY pattern ORDER BY listed_at) AS valid_to FROM days),
labels AS (SELECT page_id, fetched_at, host, path, string_split(host, '.') AS l FROM caps WHERE host <> ''),
asked AS (SELECT page_id, fetched_at, array_to_string(l[i:], '.') AS pattern FROM labels, range(1, 40) t(i) WHERE i <= greatest(len(l) - 1, 1)
  UNION SELECT page_id, fetched_at, host || array_to_string(p[1:i], '') FROM (SELECT *, regexp_extract_all(path, '[^/]*/|[^/]+') AS p FROM labels), range(1, 40) t(i) WHERE i <= len(p)),
hits AS (SELECT a.page_id, a.pattern, s.category FROM asked a JOIN spans s ON a.pattern = s.pattern AND s.listed AND a.fetched_at >= s.valid_from AND (s.valid_to IS NULL OR a.fetched_at < s.valid_to)),
best AS (SELECT page_id, count(*) AS n, max(ROW(length(pattern), pattern, category)) AS b FROM hits GROUP BY 1)
SELECT c.page_id, c.fetched_at, c.host AS url_host, coalesce(n, 0)::BIGINT AS n_active, n IS NOT NULL AS blocked, b[2] AS matched, b[3] AS category
FROM caps c LEFT JOIN best USING (page_id)
""".replace("s.valid_from", "s.listed_at")


def op6_mixing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = stored(table(spark, sf_dir, "documents").select("doc_id", "source", n_words(F.col("text")).alias("words")))
    return op6_mixing.mix_sources(docs, size_col="words").select("doc_id", "size", "source_size", "target", "taken")


OP6_SQL = r"""
WITH d AS (SELECT *, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || size) AS k
    FROM (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents)),
s AS (SELECT source, sum(size)::BIGINT AS size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM d GROUP BY source),
w AS (SELECT *, CASE rank % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END::DOUBLE AS weight, (2 * size)::DOUBLE AS cap FROM s),
l AS (SELECT *, ((SELECT sum(size) FROM s) * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, rank, size AS source_size, coalesce(least(cap, (SELECT max(level) FROM l WHERE level <= cap / weight) * weight), cap) AS target FROM l),
q AS (SELECT doc_id, d.size, k, rank, source_size, target, sum(d.size) OVER (PARTITION BY rank ORDER BY k ROWS UNBOUNDED PRECEDING) AS run
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT doc_id, k, size, rank, c, CAST(run + source_size * c AS DOUBLE) / nullif(target, 0) AS finish FROM q, range(2) r(c) WHERE size > 0),
o AS (SELECT doc_id, k, size, c, sum(size) OVER (ORDER BY finish, rank ROWS UNBOUNDED PRECEDING) AS upto FROM e),
g AS (SELECT doc_id, k, sum(size)::BIGINT AS taken FROM o WHERE upto <= (SELECT sum(target) FROM t) GROUP BY 1, 2)
SELECT q.doc_id, q.size, q.source_size, q.target, coalesce(g.taken, 0)::BIGINT AS taken FROM q LEFT JOIN g ON q.k = g.k AND q.doc_id IS NOT DISTINCT FROM g.doc_id
"""


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    said = "<|im_end|><|im_start|>assistant ok"
    own = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], turns.schema)
    return op7_chat.digests(op7_chat.format_conversations(turns.unionByName(own)))


OP7_SQL = r"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, turn, CASE turn WHEN 0 THEN 'user' ELSE 'assistant' END, '<|im_end|><|im_start|>assistant ok' FROM range(2) t(turn)),
n AS (SELECT *, row_number() OVER w AS i, length('<|im_start|>' || regexp_replace(role, '<(\\*)\|', '<\1\\|', 'g') || chr(10) || regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g') || '<|im_end|>' || chr(10)) AS chars
  FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
p AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY i) AS upto, max(CASE WHEN role = 'assistant' THEN i ELSE 0 END) OVER (PARTITION BY conv_id) AS last_own, max(i) OVER (PARTITION BY conv_id) AS last FROM n)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  length(coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = 'assistant'), ''))::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  (coalesce(sum(upto) FILTER (WHERE role = 'assistant'), 0) + coalesce(sum(upto) FILTER (WHERE i = last AND last_own < last), 0))::BIGINT AS formatted_chars
FROM p GROUP BY conv_id
"""


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, bench = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")
    out = op8_decontamination.decontaminate(docs, bench, keep=["doc_id"])
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


OP8_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark WHERE item_id IS NOT NULL),
sized AS (SELECT item_id, w, least(len(w), 13) AS l FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, l, array_to_string(w[i:i + l - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - l + 2)) AS i FROM sized)),
dw AS (SELECT doc_id, l, i, array_to_string(w[i:i + l - 1], ' ') AS g FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM d, (SELECT DISTINCT l FROM sized) WHERE len(w) >= l)),
hit AS (SELECT doc_id, item_id, i, l FROM dw JOIN bw USING (l, g)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + l)) AS p FROM (SELECT DISTINCT doc_id, i, l FROM hit)) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hit) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def op9_sharding_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    docs = table(spark, sf_dir, "documents").select("doc_id", (utf8_bytes(text) + 1).alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"))
    return op9_sharding.shard_rows(docs, 8).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_warc.archive_pages(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")



#: Base 32 from the hex digest: five hex digits are twenty bits, four letters.
OP10_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages),
h AS (SELECT page_id, first, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS d FROM p),
f AS (SELECT *, list_transform(range(8), lambda i: CAST('0x' || substr(d, CAST(5 * i + 1 AS BIGINT), 5) AS BIGINT)) AS twenties FROM h)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((twenties[k // 4 + 1] >> (15 - 5 * (k % 4))) & 31) + 1 AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM f
"""


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return op11_rtree.mine_hard_negatives(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", label.alias("label")))


OP11_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_dot_product(a.x, b.x)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other))::INTEGER AS rank, other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score QUALIFY rank <= 3
"""


def op12_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = op12_bitplanes.cluster_vectors(table(spark, sf_dir, "embeddings"), keep=["vec_id"])
    digest = F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256)
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", digest.alias("centroid_sha256"))


def _op12_sql() -> str:
    sql = """WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS x FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1)::INTEGER AS k, x FROM v QUALIFY k < 16),
"""
    for i in range(4):
        sql += f"""a{i} AS MATERIALIZED (SELECT vec_id, v.x, k, list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v, c{i} c
    QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, k) = 1),
"""
        if i < 3:
            sql += f"""m{i} AS (SELECT k, list(m ORDER BY j) AS x FROM (SELECT k, j, ((sum(e) - ((sum(e) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS m FROM (SELECT k, unnest(range(64)) AS j, unnest(x) AS e FROM a{i}) GROUP BY k, j) GROUP BY k),
c{i + 1} AS MATERIALIZED (SELECT k, coalesce(m.x, c.x) AS x FROM c{i} c LEFT JOIN m{i} m USING (k)),
"""
    return sql.rstrip(",\n") + """
SELECT vec_id, k AS cluster, d AS distance, (sum(d) OVER (PARTITION BY k))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256 FROM a3 JOIN c3 c USING (k)"""


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13_digest_index.deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP13_SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[ 	-
]', '', 'g') AS t FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, (count(*) OVER (PARTITION BY t))::BIGINT AS group_size, doc_id = first_value(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t ORDER BY n DESC, doc_id)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_similar_documents": op1_similar_documents,
    "op2_token_counts": op2_token_counts,
    "op3_quality_llr": op3_quality_llr,
    "op4_main_text": op4_main_text,
    "op5_url_filter": op5_url_filter,
    "op6_mixing": op6_mixing_query,
    "op7_chat_format": op7_chat_format,
    "op8_decontaminate": op8_decontaminate,
    "op9_sharding": op9_sharding_query,
    "op10_warc_zstd": op10_warc_zstd,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_clusters": op12_clusters,
    "op13_exact_dedup": op13_exact_dedup,
}
ORACLES: dict[str, str] = {
    "op1_similar_documents": OP1_SQL, "op5_url_filter": OP5_SQL, "op6_mixing": OP6_SQL, "op7_chat_format": OP7_SQL, "op8_decontaminate": OP8_SQL, "op10_warc_zstd": OP10_SQL,
    "op11_hard_negatives": OP11_SQL, "op12_clusters": _op12_sql(), "op13_exact_dedup": OP13_SQL,
}
