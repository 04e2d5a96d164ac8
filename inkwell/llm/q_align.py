"""op13: how two public tokenizers cut the same documents."""

from pyspark.sql import DataFrame, SparkSession

from inkwell.llm import align


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    a, b = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return align.align(spark.read.parquet(f"{sf_dir}/documents.parquet"), a, b, digest=True)


QUERIES = {"op13_tokenizer_alignment": op13_tokenizer_alignment}
#: Two trained tokenizers have no SQL form; tests hold the query against a plain loop over tokens.
ORACLE_SQL: dict[str, str] = {}
