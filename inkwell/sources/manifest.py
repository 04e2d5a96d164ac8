"""Stages that are resumed by content: what a stage was made from is remembered for each chapter."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.sources import scratch, sinks

SCHEMA = "stage string, key string, fingerprint string, version long"


def fingerprints(rows: DataFrame, key: str) -> DataFrame:
    """(key, fingerprint): the number of a chapter's rows and the sum of their hashes over all columns, whatever their order. Added up before it is shuffled."""
    names = sorted(rows.columns)
    whole = F.struct(*(F.col(c) for c in names))
    halves = [F.sum(F.xxhash64(F.lit(salt), whole).cast("decimal(38,0)")).cast("string") for salt in (1, 2)]
    kinds = F.lit(str(sorted(rows.dtypes)))
    return rows.groupBy(F.col(key).cast("string").alias("key")).agg(F.sha2(F.concat_ws("|", kinds, F.count("*").cast("string"), *halves), 256).alias("fingerprint"))


def known(spark: SparkSession, path: str, stage: str) -> DataFrame:
    """(key, fingerprint) that a stage has last recorded."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], "key string, fingerprint string")
    rows = spark.read.schema(SCHEMA).parquet(path).where(F.col("stage") == stage)
    return rows.groupBy("key").agg(F.max_by("fingerprint", "version").alias("fingerprint"))


def changed(inputs: DataFrame, path: str, stage: str, key: str = "chapter_id") -> DataFrame:
    """(key, fingerprint) of chapters that the stage hasn't done, or has done from other rows."""
    now, before = fingerprints(inputs, key), known(inputs.sparkSession, path, stage)
    return now.join(before, ["key", "fingerprint"], "left_anti")


def run(inputs: DataFrame, transform: Callable[[DataFrame], DataFrame], out: str, path: str, stage: str, key: str = "chapter_id") -> int:
    """Does a stage again for the chapters whose rows have changed; how many those were.

    transform gets their rows alone, and only their partitions of the table at `out` are replaced; a chapter that gives
    no rows any more, or isn't among the inputs any more, loses its own. A stage that reads another's table sees what
    that one changed, so what follows from it is done again too. The manifest at `path` is appended to at the end: a
    run that stops before repeats its chapters.
    """
    spark = inputs.sparkSession
    todo = scratch.materialize(changed(inputs, path, stage, key))
    gone = known(spark, path, stage).where("fingerprint <> ''").join(fingerprints(inputs, key).select("key"), "key", "left_anti")
    gone = scratch.materialize(gone.select("key", F.lit("").alias("fingerprint")))
    n = todo.count()
    if n:
        own = todo.select(F.col("key").alias("__key"))
        rows = scratch.materialize(transform(inputs.join(own, F.col(key).cast("string") == F.col("__key"), "left_semi")))
        sinks.save_stage(rows, out, key)
        empty = todo.select("key").join(rows.select(F.col(key).cast("string").alias("key")).distinct(), "key", "left_anti")
    else:
        empty = todo.select("key")
    for row in empty.union(gone.select("key")).toLocalIterator():  # chapters that have nothing any more: few, one at a time
        place, store = sinks._hadoop(spark, f"{out.rstrip('/')}/{key}={row['key']}")
        store.delete(place, True)
    version = spark.range(1).select(F.unix_micros(F.current_timestamp()).alias("v")).first()["v"]
    todo.unionByName(gone).select(F.lit(stage).alias("stage"), "key", "fingerprint", F.lit(version).alias("version")).write.mode("append").parquet(path)
    return n
