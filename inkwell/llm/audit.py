"""Interaction audit of filters by Walsh-Hadamard sums, DataFrame functions only.

Every document has a mask: one bit for each filter that it fails. Per part and label class, the 2^n signed parity
sums S(s) = sum over documents of (-1)^|mask & s| are aggregated in one pass; no sum needs a document twice, and
partial sums are added up before they are shuffled. As the transform is its own inverse up to 2^n, the sums give the
exact number of documents in each mask cell. All orders of the filters are then read off the cells, and the Shapley
value of a filter, its removals summed over all n! orders, is in closed form the sum over the cells that hold it of
n! / (number of failures): of a document's failures each comes first in equally many orders.
"""

from __future__ import annotations

import math
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import discard, scratch_write, unused

FILTERS = "ABCDE"
WORD_MIN, DISTINCT_PERCENT, CAPITAL_PERCENT = 200, 50, 2
#: Classes of a document: what its rows of labels say.
CLASSES = ("all", "good", "toxic")


def text_failures(text: Column) -> dict[str, Column]:
    """Failure conditions of A to D, each on one text; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    capitals = F.char_length(text) - F.char_length(F.regexp_replace(text, "[A-Z]+", ""))
    return {
        "A": F.size(words) < WORD_MIN,
        "B": 100 * F.size(F.array_distinct(words)) < DISTINCT_PERCENT * F.size(words),
        "C": 100 * capitals.cast("long") > CAPITAL_PERCENT * F.char_length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def parity_sums(rows: DataFrame, mask: str, weight: str, by: list[str], bits: int = len(FILTERS)) -> DataFrame:
    """Columns by, and sums: array of the 2^bits signed parity sums of weight over the rows of each group."""
    sign = lambda s: F.when(F.bit_count(F.col(mask).bitwiseAND(F.lit(s))) % 2 == 0, F.col(weight)).otherwise(-F.col(weight))
    return rows.groupBy(*by).agg(*(F.sum(sign(s)).alias(f"__s{s}") for s in range(1 << bits))).select(*by, F.array(*(F.col(f"__s{s}") for s in range(1 << bits))).alias("sums"))


def mask_cells(sums: Column, bits: int = len(FILTERS)) -> Column:
    """The exact count of each mask: the Walsh-Hadamard transform of its signed sums, divided by 2^bits."""
    n = 1 << bits
    plus = lambda m: [s for s in range(n) if (m & s).bit_count() % 2 == 0]
    total = F.aggregate(sums, F.lit(0).cast("long"), lambda a, x: a + x)
    # sum of +S over even parities minus the odd ones = 2 * even - total
    return F.array(*((2 * sum((sums[s] for s in plus(m)), F.lit(0).cast("long")) - total).cast("long") / n for m in range(n))).cast("array<long>")


def failures(documents: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """One slim row (key, part, digest, mask) per row of documents; mask has the bits of A to D."""
    mask = sum((F.when(fails, 1 << i).otherwise(0) for i, fails in enumerate(text_failures(F.col(text)).values())), F.lit(0))
    whole = F.coalesce(F.col(text), F.lit(""))
    return documents.select(F.col(key).alias("key"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(whole.cast("binary"), 256)).alias("digest"), mask.cast("int").alias("mask"))


def cells(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(part, all, good, toxic): per part the counts of the 32 masks, of all documents and of those labelled quality=1 and toxic=1.

    Texts are read once; what follows works on rows of some 60 bytes. E, the copy of a smaller key's text, is decided
    by the least key of each text, aggregated before the shuffle, and joined by that key, so that neither a hot text
    nor a hot part meets in one task. Rows without a key are salted: they are no copies, and no row is a copy of them.
    A document counts as labelled when any of its rows of labels says so; rows of labels never multiply documents.
    """
    spark = documents.sparkSession
    slim = scratch_write(failures(documents, key, text, part))
    rows = spark.read.parquet(slim)
    first = rows.groupBy("digest").agg(F.min("key").alias("key")).where("key IS NOT NULL").select("key", "digest", F.lit(True).alias("first"))
    known = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    salt = F.when(F.col("key").isNull(), F.pmod(F.xxhash64("digest"), F.lit(4096)).cast("int") + 1).otherwise(0)
    rows = rows.groupBy("key", "digest", "part", "mask").agg(F.count("*").alias("n")).withColumn("salt", salt)
    rows = rows.join(known.withColumn("salt", F.lit(0)), ["key", "salt"], "left").join(first.withColumn("salt", F.lit(0)), ["key", "salt", "digest"], "left")
    copied = F.col("key").isNotNull() & F.col("first").isNull()
    whole = rows.select("part", "n", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"), (F.col("mask") + F.when(copied, 16).otherwise(0)).alias("mask"))
    sums = parity_sums(whole, "mask", "n", ["part", "good", "toxic"])
    each = sums.select("part", "good", "toxic", mask_cells(F.col("sums")).alias("cells"))
    of = lambda name: F.array(*(F.sum(F.when(F.lit(True) if name == "all" else F.col(name), F.col("cells")[m]).otherwise(0)) for m in range(32))).alias(name)
    done = scratch_write(each.groupBy("part").agg(*(of(name) for name in CLASSES)))
    discard(spark, slim)
    return spark.read.parquet(done)


def orders(counted: DataFrame) -> DataFrame:
    """All 120 orders, step by step, of each row of cells(): see audit."""
    bit = lambda f: F.call_function("shiftleft", F.lit(1), F.call_function("instr", F.lit(FILTERS), F.col(f) if isinstance(f, str) else f) - 1)

    def total(cells: str, keep, weight=None):
        weighed = F.transform(F.col(cells), lambda n, m: F.when(keep(m), n * weight(m) if weight else n).otherwise(0))
        return F.aggregate(weighed, F.lit(0).cast("long"), lambda a, x: a + x)

    every = F.array(*(F.lit("".join(p)) for p in permutations(FILTERS)))
    letters = F.transform(F.sequence(F.lit(1), F.lit(len(FILTERS))), lambda i: F.substring("filter_order", i, F.lit(1)))
    steps = counted.select("*", F.explode(every).alias("filter_order")).select("*", letters.alias("letters")).select("*", F.posexplode("letters").alias("at", "filter"))
    before = F.aggregate(F.slice("letters", 1, F.col("at")), F.lit(0), lambda m, f: m + bit(f))
    steps = steps.select("*", bit("filter").alias("own"), before.alias("before"))
    has, had = (lambda m: m.bitwiseAND(F.col("own")) != 0), (lambda m: m.bitwiseAND(F.col("before")) != 0)
    here = lambda m: has(m) & ~had(m)
    ways = math.factorial(len(FILTERS))
    return steps.select(
        "part", "filter_order", (F.col("at") + 1).cast("int").alias("step"),
        total("all", lambda m: ~has(m) & ~had(m)).alias("kept"), total("all", here).alias("removed"), total("all", lambda m: has(m) & had(m)).alias("redundant"),
        total("all", lambda m: m == F.col("own")).alias("unique_fails"), total("good", here).alias("good_lost"), total("toxic", here).alias("toxic_lost"),
        total("all", has, lambda m: (F.lit(ways) / F.bit_count(m)).cast("long")).alias("shapley"),
    )


def audit(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley), zeros included.

    Per part (each value of the column part; null: empty string) 120 orders of A to E with 5 steps each. Null texts are
    empty; equal texts of rows with the same key are no copies of each other, of all others those with larger keys are;
    repeated rows each count; an empty table gives no rows; other columns of any name are not looked at.
    """
    return orders(cells(documents, labels, key, text, part))
