from pyspark.sql import functions as F

from inkwell.operators import ledger


def test_id_contract_counts_nulls_as_a_join_does_and_deals_by_rows(spark, monkeypatch):
    monkeypatch.setattr(ledger, "CONTRACT_ROWS", 2)
    expected = spark.createDataFrame([(1, 1), (1, 2), (1, 2), (2, 1), (3, None), (None, 1)], "k int, i int")
    got = spark.createDataFrame([(1, 1), (1, 1), (1, 9), (4, 1), (3, None), (3, None), (None, 1)], "k int, i int")
    out = ledger.id_contract(expected, got, "k", "i")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and ", 7), REPARTITION_BY_NUM" in plan
    assert sorted(map(tuple, out.select(F.coalesce("k", F.lit(0)), "missing", "extra", "duplicate").collect())) == [(0, 1, 1, 0), (1, 1, 1, 1), (2, 1, 0, 0), (3, 1, 1, 1), (4, 0, 1, 0)]
