"""Queries op1 to op10 of the driver contract, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from plinth.llm import jaccard, licenses, lmscore, mixing, naming, pieces, topk, toxicity, urls, warc

PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trigram stupid-backoff scores: doc_id, n_words, log10_prob, score."""
    scored = lmscore.score_documents(read(spark, sf_dir, "documents"), order=3)
    return scored.withColumns({"log10_prob": F.round("log10_prob", 3), "score": F.round("score", 5)})


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", F.size("expressions").cast("bigint").alias("n_expressions"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(read(spark, sf_dir, "pages"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return naming.exact_duplicates(read(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(read(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join_groups(read(spark, sf_dir, "documents"), shingle=3, num=90, den=100)


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read(spark, sf_dir, "embeddings"), k=20)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, n_bytes, ids_crc, round_trip, ids."""
    return pieces.encode(read(spark, sf_dir, "documents"), PIECE_MODEL)


def license_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op2_license_scan that SQL can express: words and places of the base phrases."""
    return op2_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_lm_scoring, op2_license_scan, op3_url_filters, op4_exact_dedup, op5_warc, op6_ngram_jaccard_join, op7_exact_topk, op8_mixing, op9_toxicity, op10_sentencepiece, license_places)
}

WORDS_SQL = f"list_filter(regexp_split_to_array(translate(COALESCE(text, ''), '{urls.UPPER}', '{urls.LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"


def _places_sql(phrase: str) -> str:
    """List of the places (from 0) where a phrase's words stand in the list ws."""
    each = " AND ".join(f"ws[i + {k + 1}] = '{w}'" for k, w in enumerate(phrase.split()))
    return f"list_filter(range(0, len(ws)), lambda i: {each})"


LICENSES_SQL = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(COALESCE(text, ''), '{urls.UPPER}', '{urls.LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
p AS (SELECT doc_id, ws, {", ".join(f"{_places_sql(phrase)} AS p{i}" for i, phrase in enumerate(licenses.BASE))} FROM w),
a AS (SELECT *, {" || ".join(f"p{i}" for i in range(len(licenses.BASE)))} AS spots, list_filter([{", ".join(f"CASE WHEN len(p{i}) > 0 THEN '{label}' END" for i, label in enumerate(licenses.BASE.values()))}], lambda x: x IS NOT NULL) AS found FROM p)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(spots) AS BIGINT) AS n_base, CAST(list_min(spots) AS BIGINT) AS first_word, CAST(list_max(spots) AS BIGINT) AS last_word, COALESCE(array_to_string(list_sort(list_distinct(found)), ','), '') AS base_labels FROM a"""

JACCARD_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS_SQL} AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')] ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS sh FROM w),
x AS (SELECT doc_id, len(sh) AS n, UNNEST(sh) AS t FROM s),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.t = b.t AND a.doc_id <> b.doc_id AND 100 * a.n >= 90 * b.n AND 100 * b.n >= 90 * a.n GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * COUNT(*) >= 90 * (a.n + b.n - COUNT(*))),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM s UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.doc_id)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, c AS component_id FROM s JOIN (SELECT doc_id, MIN(c) AS c FROM r GROUP BY doc_id) m ON m.doc_id = s.doc_id"""

ORACLES: dict[str, str] = {
    "op1_lm_scoring": f"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(COALESCE(text, ''), '{urls.UPPER}', '{urls.LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
t AS (SELECT doc_id, i, ws[i] AS c, CASE WHEN i > 1 THEN ws[i - 1] END AS b, CASE WHEN i > 2 THEN ws[i - 2] END AS a FROM (SELECT doc_id, ws, UNNEST(range(1, len(ws) + 1)) AS i FROM w)),
n AS (SELECT COUNT(*) AS n FROM t),
c1 AS (SELECT c AS w1, COUNT(*) AS n1 FROM t GROUP BY ALL),
c2 AS (SELECT b AS v1, c AS v2, COUNT(*) AS n2 FROM t WHERE b IS NOT NULL GROUP BY ALL),
c3 AS (SELECT a AS u1, b AS u2, c AS u3, COUNT(*) AS n3 FROM t WHERE a IS NOT NULL GROUP BY ALL),
s AS (SELECT t.doc_id, CASE
  WHEN i > 2 AND n3 >= 2 THEN log10(n3 / h2.n2)
  WHEN i > 1 AND d2.n2 >= 2 THEN log10(d2.n2 / h1.n1) + CASE WHEN i > 2 THEN log10(0.4) ELSE 0 END
  ELSE log10(d1.n1 / n) + CASE WHEN i > 2 THEN 2 * log10(0.4) WHEN i > 1 THEN log10(0.4) ELSE 0 END END AS p
  FROM t, n JOIN c1 d1 ON d1.w1 = t.c LEFT JOIN c2 d2 ON d2.v1 = t.b AND d2.v2 = t.c LEFT JOIN c1 h1 ON h1.w1 = t.b
  LEFT JOIN c3 ON u1 = t.a AND u2 = t.b AND u3 = t.c LEFT JOIN c2 h2 ON h2.v1 = t.a AND h2.v2 = t.b)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, ROUND(COALESCE(p, 0), 3) AS log10_prob, CASE WHEN len(ws) > 0 THEN ROUND(p / len(ws), 5) END AS score
FROM w LEFT JOIN (SELECT doc_id, SUM(p) AS p FROM s GROUP BY doc_id) q ON q.doc_id = w.doc_id""",
    "license_places": LICENSES_SQL,
    "op3_url_filters": urls.oracle(),
    "op6_ngram_jaccard_join": JACCARD_SQL,
    "op4_exact_dedup": """
SELECT doc_id, MAX(doc_id) OVER g AS keep_id, COUNT(*) OVER g AS group_size, doc_id = MAX(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, COALESCE(text, '') AS t FROM documents) WINDOW g AS (PARTITION BY t)""",
    "op5_warc": """
SELECT page_id, size AS payload_bytes, sha1(h) AS payload_digest, CASE WHEN size >= 1000 AND page_id <> keeper THEN 'revisit' ELSE 'response' END AS record_type,
CASE WHEN size >= 1000 AND page_id <> keeper THEN keeper END AS refers_to
FROM (SELECT page_id, h, CAST(octet_length(encode(h)) AS BIGINT) AS size, MAX(page_id) OVER (PARTITION BY h) AS keeper FROM (SELECT page_id, COALESCE(html, '') AS h FROM pages))""",
    "op7_exact_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s QUALIFY rank <= 20""",
}
