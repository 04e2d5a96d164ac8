"""Numbers and running sums over orders that are too long for one task."""

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkwell.sources import scratch

#: Places of an order that are summed up in one task.
BLOCK = 100_000


def numbered(rows: DataFrame, *order: str, keys: tuple[str, ...] = (), name: str = "number", start: int = 1) -> DataFrame:
    """Adds the place of each row in an order, from start, within equal values of keys.

    Rows are dealt by ranges of (keys, order) and sorted; the table that this writes keeps each row's task and place
    in it. What stands before a task is a sum over the tasks' sizes, a row for each task. So no task holds more than
    its range; only rows alike in keys and order stay together. Ties have any order. Null keys are a key.
    """
    dealt = rows.repartitionByRange(*(F.col(c) for c in (*keys, *order))).sortWithinPartitions(*keys, *order)
    placed = scratch.materialize(dealt.withColumn("__at", F.monotonically_increasing_id()))
    task = F.shiftright("__at", 33)
    sizes = placed.groupBy(task.alias("__task")).agg(F.count("*").alias("n"))
    before = sizes.select("__task", F.coalesce(F.sum("n").over(Window.orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    place = F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + start
    out = placed.withColumn("__task", task).join(F.broadcast(before), "__task").withColumn(name, place).drop("__task", "__before", "__at")
    if not keys:
        return out
    own = [f"__k{i}" for i in range(len(keys))]
    first = out.groupBy(*(F.col(k).alias(o) for k, o in zip(keys, own))).agg(F.min(name).alias("__first"))
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(o)) for k, o in zip(keys, own)))
    return out.join(first, same).withColumn(name, F.col(name) - F.col("__first") + start).drop("__first", *own)


def running(rows: DataFrame, *keys: str, value: str, order: str, name: str, block: int = BLOCK) -> DataFrame:
    """Adds the sum of value over the rows of a key that stand before each row; nulls count as nothing.

    Two levels: sums within blocks of places (order is a number), and sums of the blocks before. A key is one block's
    window at a time, and as many rows as it has blocks in the second. Rows alike in order are taken in any order.
    """
    own = [f"__k{i}" for i in range(len(keys))]
    placed = rows.withColumn("__b", F.floor(F.col(order) / block))
    amount = F.coalesce(F.col(value), F.lit(0))
    sums = placed.groupBy(*(F.col(k).alias(o) for k, o in zip(keys, own)), F.col("__b").alias("__c")).agg(F.sum(amount).alias("s"))
    before = F.sum("s").over(Window.partitionBy(*own).orderBy("__c").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sums.select(*own, "__c", before.alias("__o"))
    local = F.sum(amount).over(Window.partitionBy(*keys, "__b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(o)) for k, o in zip(("__b", *keys), ("__c", *own))))
    zero = F.lit(0).cast(sums.schema["s"].dataType)
    out = placed.withColumn("__l", local).join(offsets, same)
    return out.withColumn(name, F.coalesce("__o", zero) + F.coalesce("__l", zero)).drop("__b", "__c", "__l", "__o", *own)
