"""Queries of archives; part of the registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from orefold.operators.graph import Rounds
from orefold.registry import query
from orefold.sources import archive
from orefold.sources import testdata as T

PACK = 5000  # documents of an archive


def _packed(s, d):
    """Documents in archives of 5000 ids each, and the folder."""
    docs = T.table(s, d, "documents").select(F.concat(F.lit("pack-"), F.floor(F.col("doc_id") / PACK).cast("string")).alias("archive"), F.concat(F.col("lang"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), "text", "doc_id")
    at = f"{Rounds(s).root}/archives"
    archive.write(docs, at, int(s.conf.get("spark.sql.shuffle.partitions")))
    return docs, at


@query("archive_texts_a5", """SELECT 'pack-' || (doc_id // 5000) AS archive, lang || '/' || doc_id || '.md' AS path, octet_length(encode(coalesce(text, '')))::BIGINT AS size,
  sha256(CASE WHEN octet_length(encode(coalesce(text, ''))) <= 524288 THEN coalesce(text, '') END) AS sha256 FROM documents WHERE lang <> 'en'""")
def _(s, d):
    docs, at = _packed(s, d)
    listing = docs.where("path not like 'en/%'").select("archive", "path", F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint").alias("size"))
    return archive.wanted(archive.read(s, at), listing).select("archive", "path", "size", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))


@query("archive_sizes_a9", "SELECT 'pack-' || (doc_id // 5000) AS archive, count(*) AS files, sum(octet_length(encode(coalesce(text, ''))))::BIGINT AS bytes FROM documents GROUP BY ALL")
def _(s, d):
    return archive.read(s, _packed(s, d)[1], texts="false").groupBy("archive").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))
