"""op3: documents that contain benchmark items."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm import decontam


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.matches(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    rows = found.select("doc_id", F.explode("__matches").alias("m"))
    return rows.select("doc_id", "m.item_id", "m.item_words", "m.covered_words", F.size("m.tiles").alias("n_tiles"), (F.col("m.covered_words") / F.col("m.item_words")).alias("coverage"))


QUERIES = {"op3_decontamination": op3_decontamination}
ORACLE_SQL: dict[str, str] = {}
