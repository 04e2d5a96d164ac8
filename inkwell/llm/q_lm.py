"""op8: the log10 probability of every whole text of documents."""

from pyspark.sql import DataFrame, SparkSession

from inkwell.llm import lm


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm.fit_and_score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return scored.select("doc_id", (~lm.learnt()).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {"op8_lm_scoring": op8_lm_scoring}
ORACLE_SQL: dict[str, str] = {}
