import random

import pytest
from pyspark.sql import functions as F

from inkwell.operators import ranks
from inkwell.operators import segments as S


def test_numbers_equal_a_sorted_list(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", "c", None]), i, f"n{rng.random()}") for i in range(5000)]
    df = spark.createDataFrame(rows, "k string, i int, name string").repartition(7)
    got = {r.i: r.number for r in ranks.numbered(df, "name").collect()}
    assert got == {r[1]: n for n, r in enumerate(sorted(rows, key=lambda r: r[2]), 1)}
    got = {r.i: r.at for r in ranks.numbered(df, "name", keys=("k",), name="at", start=0).collect()}
    want = {}
    for key in ("a", "b", "c", None):
        want |= {r[1]: n for n, r in enumerate(sorted((r for r in rows if r[0] == key), key=lambda r: r[2]))}
    assert got == want
    assert ranks.numbered(df.where("false"), "name").collect() == []


def test_no_task_holds_the_whole_order(spark):
    """200,000 rows of one key: the written table's tasks are ranges, and sums go by blocks."""
    df = spark.range(200_000).select(F.lit(1).alias("k"), "id", (F.col("id") % 7).alias("v"))
    out = ranks.numbered(df, "id", keys=("k",))
    assert out.where("number <> id + 1").count() == 0
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r.n for r in df.repartitionByRange("id").groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(sizes) < 100_000
    sums = ranks.running(df, "k", value="v", order="id", name="s", block=10_000)
    full = lambda n: n // 7 * 21 + sum(range(n % 7))
    assert {r.id: r.s for r in sums.where("id % 9973 = 0").collect()} == {i: full(i) for i in range(0, 200_000, 9973)}
    plan = sums._jdf.queryExecution().executedPlan().toString()
    assert "__b" in plan and "Python" not in plan


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_times_equal_a_running_loop(spark, block):
    rng = random.Random(block)
    rows = [(k, p, rng.choice([None, 0.25, 1.5, 2.0])) for k in ("x", None) for p in range(40)]
    got = {(r.k, r.p): (r.clip_begin, r.clip_end) for r in S.timed(spark.createDataFrame(rows, "k string, p int, d double"), "k", seconds="d", order="p", block=block).collect()}
    at = {}
    for k, p, d in rows:
        begin = at.get(k, 0.0)
        at[k] = begin + (d or 0.0)
        assert got[k, p] == (begin, at[k])


def test_renumbering_only_where_numbers_repeat(spark):
    rows = [("a", 0, 5), ("a", 1, 5), ("a", 2, 9), ("b", 0, 7), ("b", 1, 3), ("c", 0, None), ("c", 1, 4)]
    got = sorted((r.book, r.pos, r.number) for r in S.renumbered(spark.createDataFrame(rows, "book string, pos int, number int"), "book").collect())
    assert got == [("a", 0, 1), ("a", 1, 2), ("a", 2, 3), ("b", 0, 7), ("b", 1, 3), ("c", 0, 1), ("c", 1, 2)]
