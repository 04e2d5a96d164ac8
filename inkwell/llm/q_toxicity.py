"""op6: a toxicity score for every whole text of documents."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm import toxicity

THRESHOLD = 0.5


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = toxicity.train(documents, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(documents, model).select("doc_id", toxicity.held_out().alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


QUERIES = {"op6_toxicity": op6_toxicity}
ORACLE_SQL: dict[str, str] = {}
