"""op9: licence statements in every whole text of documents."""

from pyspark.sql import DataFrame, SparkSession

from inkwell.llm import license


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("spans")


QUERIES = {"op9_license_scan": op9_license_scan}
ORACLE_SQL: dict[str, str] = {}
