"""op10: near-duplicate embeddings."""

from pyspark.sql import DataFrame, SparkSession

from inkwell.llm import neardup


def op10_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.components(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {"op10_embedding_neardup": op10_embedding_neardup}
ORACLE_SQL = {
    "op10_embedding_neardup": """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[64]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a, v b WHERE a.vec_id <> b.vec_id AND array_cosine_similarity(a.e, b.e) >= 0.9),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n.n_links, 0) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN c ON c.vec_id = e.vec_id LEFT JOIN n ON n.vec_id = e.vec_id
"""
}
