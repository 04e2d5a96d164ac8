"""op12: how five filters interact over whole documents, in every order."""

from pyspark.sql import DataFrame, SparkSession

from inkwell.llm import audit


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {"op12_filter_audit": op12_filter_audit}
ORACLE_SQL = {
    "op12_filter_audit": r"""
WITH texts AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
words AS (SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w, min(doc_id) OVER (PARTITION BY text) AS first_id FROM texts),
failed AS (
  SELECT doc_id, part,
         [len(w) < 200,
          100 * len(list_distinct(w)) < 50 * len(w),
          100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 2 * length(text),
          regexp_matches(text, '[#$%&*|]'),
          coalesce(first_id < doc_id, false)] AS f
  FROM words),
known AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
groups AS (SELECT part, f, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, count(*) AS n
           FROM failed LEFT JOIN known USING (doc_id) GROUP BY ALL),
letters AS (SELECT unnest([1, 2, 3, 4, 5]) AS i),
perms AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS p FROM letters a, letters b, letters c, letters d, letters e
          WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
steps AS (SELECT list_aggregate(list_transform(p, lambda x: substr('ABCDE', x, 1)), 'string_agg', '') AS filter_order, p, k AS step, p[k] AS own
          FROM perms, (SELECT unnest([1, 2, 3, 4, 5]) AS k)),
judged AS (
  SELECT g.part, s.filter_order, s.step, s.own, g.n, g.good, g.toxic, g.f[s.own] AS fails,
         len(list_filter(s.p[1:s.step - 1], lambda x: g.f[x])) > 0 AS gone, len(list_filter(g.f, lambda x: x)) AS fs
  FROM groups g, steps s),
totals AS (
  SELECT part, filter_order, step, own,
         sum(CASE WHEN NOT gone AND NOT fails THEN n ELSE 0 END) AS kept, sum(CASE WHEN NOT gone AND fails THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN gone AND fails THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails AND fs = 1 THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN NOT gone AND fails AND good THEN n ELSE 0 END) AS good_lost, sum(CASE WHEN NOT gone AND fails AND toxic THEN n ELSE 0 END) AS toxic_lost
  FROM judged GROUP BY ALL),
shap AS (SELECT part, own, sum(removed) AS shapley FROM totals GROUP BY part, own)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(shapley AS BIGINT) AS shapley
FROM totals JOIN shap USING (part, own)
"""
}
