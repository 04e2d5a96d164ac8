"""Differences of JSON objects by VARIANT values, without Python."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.sources import scratch

MISSING = "<missing>"


def _is_object(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))


def _fields(rows: DataFrame, side: str) -> DataFrame:
    """(__row, path, key, side): a row for each field of the objects in column `side`."""
    rows.createOrReplaceTempView("inkwell_json_diff")
    spark = rows.sparkSession
    try:
        return spark.sql(f"SELECT t.__row, t.path, e.key AS key, e.value AS {side} FROM inkwell_json_diff t, LATERAL variant_explode(t.{side}) e")
    finally:
        spark.catalog.dropTempView("inkwell_json_diff")


def _shown(value: Column) -> Column:
    """A text as it is, anything else as JSON."""
    return F.coalesce(F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string")), F.to_json(value))


def differences(rows: DataFrame, *keep: str, left: str, right: str) -> DataFrame:
    """(keep, path, a, b) where two JSON objects differ, at any depth; <missing> marks an absent key, arrays compare whole.

    Both texts are parsed once. Level by level the fields of both sides meet by an outer join of row, path and key;
    pairs of objects go on to the next level, which is written so that plans stay small, and all other pairs that
    differ are rows. A null or malformed text, and one that is no object, is an empty object. Values are shown as
    compact JSON with sorted keys, texts without quotes. Numbers are equal by value, 1 and 1.0 too.

    Spark takes 2 KB for a VARIANT whatever it holds, so a plan's size without its VARIANTs is guessed far too small: the
    columns to keep are joined back by sorting, or else the driver would gather and broadcast them for all rows.
    """
    spark = rows.sparkSession
    empty = F.parse_json(F.lit("{}"))
    whole = lambda c: F.when(_is_object(F.try_parse_json(F.col(c))), F.try_parse_json(F.col(c))).otherwise(empty)
    first = rows.select(F.struct(*keep).alias("__keep"), whole(left).alias("a"), whole(right).alias("b"), F.monotonically_increasing_id().alias("__row"))
    base = scratch.write(first)
    level, made, found = spark.read.parquet(base).select("__row", F.lit("").alias("path"), "a", "b"), [], []
    while True:
        a, b = _fields(level, "a"), _fields(level, "b")
        both = a.join(b, ["__row", "path", "key"], "full_outer")
        path = F.when(F.col("path") == "", F.col("key")).otherwise(F.concat("path", F.lit("."), "key"))
        both = both.select("__row", path.alias("path"), "a", "b", (F.col("a").isNotNull() & F.col("b").isNotNull() & _is_object(F.col("a")) & _is_object(F.col("b"))).alias("deeper"))
        made.append(scratch.write(both))
        both = spark.read.parquet(made[-1])
        number = lambda c: F.try_variant_get(F.col(c), "$", "double")
        numeric = lambda c: F.schema_of_variant(F.col(c)).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
        same = F.when(numeric("a") & numeric("b") & (F.to_json("a") != F.to_json("b")), number("a") == number("b")).otherwise(F.to_json("a") == F.to_json("b"))
        kept = both.where(~F.col("deeper") & ~F.coalesce(same, F.lit(False)))
        found.append(kept.select("__row", "path", F.when(F.col("a").isNull(), MISSING).otherwise(_shown(F.col("a"))).alias("a"), F.when(F.col("b").isNull(), MISSING).otherwise(_shown(F.col("b"))).alias("b")))
        level = both.where("deeper").select("__row", "path", "a", "b")
        if level.isEmpty():
            break
    every = found[0]
    for one in found[1:]:
        every = every.unionByName(one)
    return every.join(spark.read.parquet(base).select("__row", "__keep").hint("merge"), "__row").select("__keep.*", "path", "a", "b")
