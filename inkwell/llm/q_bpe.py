"""op1: every whole text of documents as byte-level BPE ids, and back."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm import bpe


def digests(documents: DataFrame, keep: tuple[str, ...] = ("doc_id",), tokens: str = "byte_bpe_multi_50k.tiktoken", with_ids: bool = False) -> DataFrame:
    """Columns keep, n_tokens, digests of the ids and of what they decode to, and if asked for the ids themselves."""
    import public_tokenizers

    path = public_tokenizers.path(tokens)
    coded = bpe.encode(documents, path, public_tokenizers.PATTERN, keep=keep, with_decoded=True)
    return coded.select(*keep, "n_tokens", *(["ids"] if with_ids else []), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op1_byte_bpe": op1_byte_bpe}
ORACLE_SQL: dict[str, str] = {}
