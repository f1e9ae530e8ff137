"""The registered queries of this subpackage and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from orefold.llm import bpe, decontaminate, embed_dedup, html_text, lexical, licenses, minhash, mixture, quality, spotsigs, token_shards, vector_codes, warc


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_shards.tokenised_shards(spark, _read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.fingerprint_edits(_read(spark, sf_dir, "documents"), cover=True)


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(spark, _read(spark, sf_dir, "documents"))


def op4_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mix_report(spark, _read(spark, sf_dir, "documents"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_read(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return quality.score(spark, docs, quality.fit(spark, docs, _read(spark, sf_dir, "labels")))


def op7_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_vectors(spark, _read(spark, sf_dir, "embeddings"))


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(spark, _read(spark, sf_dir, "pages"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, _read(spark, sf_dir, "pages"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(spark, _read(spark, sf_dir, "embeddings"))


def op12_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(spark, _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank(spark, _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_token_shards, op2_spotsigs, op3_minhash, op4_mixture, op5_licenses, op6_quality, op7_near_vectors, op8_main_text, op9_bpe, op10_warc, op11_vector_codes, op12_decontaminate, op13_lexical)}

ORACLES: dict[str, str] = {
    "op11_vector_codes": vector_codes.oracle(),
    "op12_decontaminate": decontaminate.ORACLE,
    "op13_lexical": lexical.ORACLE,
    "op3_minhash": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM words),
flat AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM flat a JOIN flat b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
lows AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, l.c AS component_id, s.doc_id = l.c AS kept FROM sets s JOIN lows l ON s.doc_id = l.a""",
    "op4_mixture": r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS key FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM d GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][i % 3 + 1]::DOUBLE AS w, source_size * 2.0::DOUBLE AS cap FROM s),
l AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) /
    sum(w) OVER (ORDER BY cap / w, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS own FROM w),
v AS (SELECT arg_min(own, cap / w) AS level FROM l WHERE cap / w > own),
g AS (SELECT source, source_size, i, coalesce(least(cap, w * level), cap) AS target FROM l LEFT JOIN v ON true),
p AS (
  SELECT d.*, g.source_size, g.target, g.i, CAST(round(g.target) AS BIGINT) AS words,
    CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
t AS (
  SELECT *, CASE WHEN source_size > 0 THEN words // source_size ELSE 0 END AS passes FROM p),
u AS (SELECT *, passes * size + greatest(0, least(size, words - passes * source_size - start)) AS taken, least(1.0, start / target) AS x FROM t)
SELECT doc_id, source, size, source_size, target, CAST(taken AS BIGINT) AS taken,
  CASE WHEN taken > 0 THEN CASE i % 3 WHEN 0 THEN abs((sqrt(0.25::DOUBLE + 2.0::DOUBLE * x) - 0.5::DOUBLE) / 1.0::DOUBLE)
    WHEN 1 THEN abs((sqrt(2.25::DOUBLE + (-2.0)::DOUBLE * x) - 1.5::DOUBLE) / (-1.0)::DOUBLE) ELSE x END END AS first_position
FROM u""",
    "op7_near_vectors": r"""
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.98),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
lows AS (SELECT a, min(b) AS c FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, lows.c AS component_id, e.vec_id = lows.c AS kept
FROM embeddings e JOIN lows ON lows.a = e.vec_id LEFT JOIN n ON n.a = e.vec_id""",
    "op10_warc": r"""
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first IS NOT NULL AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to FROM f""",
}
