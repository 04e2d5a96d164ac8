"""op4: a quality score for every whole text of documents."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm import quality
from inkwell.llm.toxicity import held_out

THRESHOLD = 0.3


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = quality.train(documents, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(documents, model).select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


QUERIES = {"op4_quality": op4_quality}
ORACLE_SQL: dict[str, str] = {}
