"""Problem 6: markdown and payloads cut into pieces within their limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekiln.llm.splitting import split_oversized
from lorekiln.plans.session import table

MARKDOWN_LIMIT, PAYLOAD_LIMIT = 2000, 4096


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    concepts, chunks = table(spark, sf_dir, "concepts"), table(spark, sf_dir, "chunks")
    texts = split_oversized(concepts, "markdown", F.col("id"), F.col("markdown"), MARKDOWN_LIMIT)
    key = F.concat_ws(":", F.coalesce("bundle_id", F.lit("")), F.col("chunk_index").cast("string"))
    opaque = F.coalesce("compressed", F.lit(False)) | F.coalesce("encrypted", F.lit(False))
    return texts.unionByName(split_oversized(chunks, "payload", key, F.col("payload"), PAYLOAD_LIMIT, opaque))


def p6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pieces(spark, sf_dir)
    return p.select(F.col("kind").alias("item_kind"), F.col("key").alias("item_key"), "piece", "start", "core", "stop", "hard", "text", F.base64(F.when(F.col("text").isNull(), F.col("bytes"))).alias("data"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _pieces(spark, sf_dir).groupBy("kind", "key").agg(F.max("hard").alias("hard"))
    return items.select(F.col("kind").alias("item_kind"), F.col("key").alias("item_key"), F.when(F.col("hard"), "hard").otherwise("soft").alias("cut"))


def p6_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown put together again from the cores of its pieces, with the longest piece and the longest overlap."""
    p = _pieces(spark, sf_dir).filter("kind = 'markdown'").withColumn("own", F.substring("text", F.col("core") - F.col("start") + 1, F.length("text")))
    g = p.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("piece", "own"))).alias("t"), (F.max(F.length("text")) <= MARKDOWN_LIMIT).alias("within"), (F.max(F.col("core") - F.col("start")) <= MARKDOWN_LIMIT // 10).alias("overlap_within"))
    return g.select(F.col("key").alias("id"), F.sha2(F.array_join("t.own", ""), 256).alias("text_hash"), "within", "overlap_within")


QUERIES = {"p6_found": p6_found, "p6_pieces": p6_pieces, "p6_roundtrip": p6_roundtrip}
ORACLES = {
    "p6_roundtrip": "SELECT id, sha256(min(markdown)) AS text_hash, true AS within, true AS overlap_within FROM concepts WHERE length(markdown) > 2000 GROUP BY id",
    
    "p6_found": r'''
SELECT 'markdown' AS item_kind, id AS item_key, CASE WHEN bool_or(regexp_matches(markdown, '\S{1000}\S{1000}\S')) THEN 'hard' ELSE 'soft' END AS cut FROM concepts WHERE length(markdown) > 2000 GROUP BY id
UNION ALL
SELECT 'payload', bundle_id || ':' || chunk_index,
  CASE WHEN bool_or(coalesce(compressed, false) OR coalesce(encrypted, false) OR regexp_matches(digits, '[0-9A-F]{1000}' || repeat('[0-9A-F]{1000}', 7) || '[0-9A-F]{193}')) THEN 'hard' ELSE 'soft' END
FROM (SELECT *, replace(regexp_replace(regexp_replace(hex(payload), '(..)', '\1,', 'g'), '(20|09|0A|0B|0C|0D|1C|1D|1E|1F),', ' ', 'g'), ',', '') AS digits FROM chunks WHERE octet_length(payload) > 4096)
GROUP BY bundle_id, chunk_index'''
}
