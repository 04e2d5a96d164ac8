"""The corpus pipeline: five stages, each one operator of inkwell.llm, from documents to token ids.

Every stage works on all that the stage before kept and returns the columns of documents; the last returns ids.
A table without rows passes through; nulls, empty and repeated rows are treated as the operators say.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm import decontam, jaccard, q_quality, q_toxicity, quality, toxicity
from inkwell.llm.common import materialize, unused
from inkwell.llm.q_bpe import digests


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold; the classifier learns from the rows at hand."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = unused("__score", docs.columns)
    return toxicity.score(docs, model, tuple(docs.columns), score).where(F.col(score) < q_toxicity.THRESHOLD).drop(score)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold; the rules are learnt from the rows at hand."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = unused("__score", docs.columns)
    return quality.score(docs, model, tuple(docs.columns), score).where(F.col(score) >= q_quality.THRESHOLD).drop(score)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id."""
    return jaccard.distinct_documents(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids (little-endian unsigned 32-bit integers) and digests of the ids and of what they decode to."""
    return digests(docs, ("doc_id", "lang", "source"), with_ids=True)


STAGES = [("toxicity", drop_toxic), ("quality", drop_poor), ("ngram_jaccard", one_of_each), ("decontamination", drop_leaks), ("byte_bpe", encode)]
#: Merges, trees and string tiling have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
