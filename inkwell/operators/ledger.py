"""Library books, settings, contracts between tables, and differences of JSON objects."""



from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.operators.json_diff import differences as json_differences  # noqa: F401


def with_inventory(books: DataFrame, raw: str = "raw", valid: str = "valid") -> DataFrame:
    """Counts not below 0; the last count is the valid one."""
    return books.withColumn("raw_chapter_count", F.greatest(F.lit(0), F.col(raw))).withColumn("valid_chapter_count", F.greatest(F.lit(0), F.col(valid))).withColumn("last_chapter_count", F.col("valid_chapter_count"))


#: Rows of a contract that one task counts.
CONTRACT_ROWS = 1_000_000


def id_contract(expected: DataFrame, got: DataFrame, key: str, item: str) -> DataFrame:
    """For each key, how many expected items are missing, how many are extra, and how many are given twice.

    Both sides are dealt once, by key and item, to as many tasks as their rows ask for, and meet in one count, so
    what a task holds does not grow with the tables; a null matches nothing, as in a join.
    """
    side = lambda df, mark: df.select(F.col(key), F.col(item), F.lit(mark).cast("tinyint").alias("__e"))
    both = side(expected, 1).unionByName(side(got, 0))
    tasks = max(int(expected.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(expected.count() + got.count()) // CONTRACT_ROWS))
    lone = F.when(F.col(key).isNull() | F.col(item).isNull(), F.col("__e"))
    rows = both.withColumn("__l", lone).repartition(tasks, key, item).groupBy(key, item, "__l").agg(F.max("__e").alias("__e"), F.sum(1 - F.col("__e")).alias("__n"))
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).alias
    return rows.groupBy(key).agg(count(F.col("__n") == 0)("missing"), count(F.col("__e") == 0)("extra"), count(F.col("__n") > 1)("duplicate"))


def merged_settings(defaults: Column, stored: Column, obsolete: tuple[str, ...] = ()) -> Column:
    """Stored settings over the defaults, without obsolete keys."""
    kept = F.map_filter(stored, lambda k, v: ~k.isin(*obsolete)) if obsolete else stored
    rest = F.map_filter(defaults, lambda k, v: ~F.map_contains_key(kept, k))
    return F.map_concat(rest, kept)


def as_int(value: Column, default: int) -> Column:
    return F.coalesce(value.try_cast("int"), F.lit(default))


def as_bool(value: Column, default: bool) -> Column:
    low = F.lower(F.trim(value))
    return F.when(value.isNull(), default).otherwise(low.isin("1", "true", "yes", "on"))


def clamp(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def iso_utc(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def not_retryable(message: Column) -> Column:
    """Whether an error text says that a retry is in vain."""
    # Marks of errors that stay.
    low, out = F.lower(F.coalesce(message, F.lit(""))), F.lit(False)
    for mark in ("not installed", "not found", "no such file", "missing", "set kokoro_model_path", "set kokoro_voices_path"):
        out = out | F.contains(low, F.lit(mark))
    return out


def installed(wanted: DataFrame, models: DataFrame, name: str = "name") -> DataFrame:
    """Wanted models that are among the installed ones, by name without tag."""
    bare = lambda c: F.lower(F.split_part(F.col(c), F.lit(":"), F.lit(1)))
    have = models.select(bare(name).alias("__m")).distinct()
    return wanted.join(have, bare(name) == F.col("__m"), "left_semi")


def with_new_ids(rows: DataFrame, name: str = "book_id") -> DataFrame:
    """Rows with a random id each. Write the result once: another run gives other ids."""
    return rows.withColumn(name, F.uuid())
