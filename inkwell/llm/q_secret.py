"""op11: secrets in every whole text of documents."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm import secret


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = secret.scan(documents, secret.fit(documents))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_format", "score")


QUERIES = {"op11_secret_scan": op11_secret_scan}
#: Inferred automata have no SQL form; tests hold base spans against the patterns and the automata against their definition.
ORACLE_SQL: dict[str, str] = {}
