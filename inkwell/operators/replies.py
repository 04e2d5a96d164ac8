"""Asking a model once: replies are kept in a table by the hash of what was asked."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.sources import scratch

SCHEMA = "key string, reply string"


def key_of(kind: str, system: Column, user: Column) -> Column:
    """The address of a reply: who is asked, and both texts with their lengths, so that no two questions share one."""
    parts = [F.concat(F.octet_length(t).cast("string"), F.lit(":"), t) for t in (F.lit(kind), F.coalesce(system, F.lit("")), user)]
    return F.sha2(F.concat(*parts), 256)


def stored(spark, path: str) -> DataFrame:
    """The table of replies; of repeated keys, which two runs at once may leave, the least reply counts."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).parquet(path).groupBy("key").agg(F.min("reply").alias("reply"))


def answered(rows: DataFrame, ask: Callable[[Column, Column, Column], Column], path: str, kind: str, system: str, user: str, name: str, out: str = "answer") -> DataFrame:
    """rows with out, struct<reply, fault>: what `ask` says to (system, user), null where user is null.

    Equal questions are reduced to one before anyone is asked, those with a reply in the table at path are taken out by
    an anti join, and the rest is asked and written once; what failed isn't kept, so it is asked again another time.
    A plan that reads the result asks nobody. A question that very many rows share is one row until it is joined back.
    """
    spark = rows.sparkSession
    keyed = rows.withColumn("__key", F.when(F.col(user).isNotNull(), key_of(kind, F.col(system), F.col(user))))
    wanted = keyed.where("__key IS NOT NULL").groupBy(F.col("__key").alias("key")).agg(F.min(system).alias("s"), F.min(user).alias("u"), F.min(name).alias("n"))
    wanted = scratch.materialize(wanted)
    said = wanted.join(stored(spark, path).select("key"), "key", "left_anti").withColumn("a", ask(F.col("s"), F.col("u"), F.col("n"))).select("key", "a.reply", "a.fault")
    fresh = scratch.materialize(said)
    fresh.where("reply IS NOT NULL").select("key", "reply").write.mode("append").parquet(path)
    # The answers to this call's questions become a table of their own: a plan that reads the growing one at two times would take both for the same.
    replied = wanted.select("key").join(stored(spark, path), "key", "left").join(fresh.select("key", "fault"), "key", "left")
    known = scratch.materialize(replied.select(F.col("key").alias("__key"), F.struct("reply", F.when(F.col("reply").isNull(), F.col("fault")).alias("fault")).alias(out)))
    return keyed.join(known, "__key", "left").drop("__key")
