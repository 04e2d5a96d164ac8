"""op2: the main text of every page."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm import html


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


QUERIES = {"op2_html_extraction": op2_html_extraction}
ORACLE_SQL: dict[str, str] = {}
