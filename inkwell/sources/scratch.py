"""Tables that an operator writes in between: they cut the lineage and survive lost executors."""

import uuid

from pyspark.sql import DataFrame, SparkSession


def root(spark: SparkSession) -> str:
    """The shared folder that spark.checkpoint.dir names, or else a folder of the warehouse, which is shared too."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return (named or f"{spark.conf.get('spark.sql.warehouse.dir')}/inkwell-scratch").rstrip("/")


def write(df: DataFrame) -> str:
    """Writes df to a table of its own; its path."""
    path = f"{root(df.sparkSession)}/inkwell-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return path


def materialize(df: DataFrame) -> DataFrame:
    return df.sparkSession.read.parquet(write(df))


def discard(spark: SparkSession, *paths: str) -> None:
    """Deletes tables that no later plan reads."""
    for path in paths:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
