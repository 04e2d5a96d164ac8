"""op7: the shard of every document."""

from pyspark.sql import DataFrame, SparkSession

from inkwell.llm import sharding


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op7_sharding": op7_sharding}
ORACLE_SQL = {
    "op7_sharding": f"""
WITH k AS (
  SELECT row_number() OVER () AS r, doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS bytes,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))), 1, {sharding.HASH_BITS // 4}) AS BIGINT) AS h
  FROM documents),
p AS (SELECT k.*, d.depth, h >> ({sharding.HASH_BITS} - d.depth) AS prefix FROM k, (SELECT CAST(unnest(range({sharding.HASH_BITS + 1})) AS INTEGER) AS depth) d),
s AS (SELECT depth, prefix, sum(bytes) AS shard_bytes FROM p GROUP BY depth, prefix),
l AS (SELECT r, min(p.depth) AS depth FROM p JOIN s ON p.depth = s.depth AND p.prefix = s.prefix
      WHERE s.shard_bytes <= {sharding.LIMIT_BYTES} OR p.depth = {sharding.HASH_BITS} GROUP BY r)
SELECT p.doc_id, p.bytes,
       CASE WHEN p.depth = 0 THEN '' ELSE substr(lpad(bin(p.h), {sharding.HASH_BITS}, '0'), 1, p.depth) END AS shard,
       p.depth, CAST(s.shard_bytes AS BIGINT) AS shard_bytes, s.shard_bytes <= {sharding.LIMIT_BYTES} AS fits
FROM l JOIN p ON l.r = p.r AND l.depth = p.depth JOIN s ON s.depth = p.depth AND s.prefix = p.prefix
"""
}
