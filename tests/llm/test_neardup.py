import numpy as np
import pytest

from inkwell.llm import common, neardup


def _brute(rows, cosine=0.9):
    forest, links = common.Forest(), [0] * len(rows)
    unit = []
    for _, v in rows:
        ok = v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
        unit.append(np.array(v, float) / np.linalg.norm(v) if ok else None)
    for i in range(len(rows)):
        for j in range(i):
            if None not in (rows[i][0], rows[j][0]) and unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cosine:
                links[i] += 1
                links[j] += 1
                forest.join(rows[i][0], rows[j][0])
    return sorted(((k, n, forest.find(k) if k is not None else None, k is not None and forest.find(k) == k) for (k, _), n in zip(rows, links)), key=str)


def _rows(n, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(9, 12))
    rows = [(i, (centres[rng.integers(9)] + rng.normal(size=12) * rng.choice([0.05, 0.3, 0.6])).astype(np.float32).tolist()) for i in range(n)]
    rows += [(5000 + i, rows[3][1]) for i in range(20)]
    return rows


@pytest.mark.parametrize("block,kind", [(1024, "float"), (37, "float"), (50, "double")])
def test_equals_brute_force(spark, monkeypatch, block, kind):
    monkeypatch.setattr(neardup, "BLOCK_ROWS", block)
    rows = _rows(500, block)
    rows += [(7000, None), (7001, []), (7002, [0.0] * 12), (7003, [float("nan")] + [1.0] * 11), (7004, [None] + [1.0] * 11), (7005, [float("inf")] * 12), (None, rows[3][1]), (7006, [1.0, 2.0]), (7007, [2.0, 4.0]), (7008, [-0.0] * 12), (7009, [1e-30] * 12), (7010, [1e30] * 12)]
    df = spark.createDataFrame([(k, v, 1, 2) for k, v in rows], f"vec_id long, embedding array<{kind}>, n int, component int")
    assert sorted((tuple(r) for r in neardup.components(df.repartition(6)).collect()), key=str) == _brute(rows)


def test_empty_table_and_no_valid_vector(spark):
    schema = "vec_id long, embedding array<float>"
    assert neardup.components(spark.createDataFrame([], schema)).collect() == []
    assert [tuple(r) for r in neardup.components(spark.createDataFrame([(4, None)], schema)).collect()] == [(4, 0, 4, True)]


def test_intervals_skip_only_what_is_apart():
    rng = np.random.default_rng(2)
    lo = np.sort(rng.random((40, 2)) * 9, axis=0)
    hi = lo + rng.random((40, 2))
    want = {(i, j) for i in range(40) for j in range(i, 40) if not neardup.apart(lo[i], hi[i], lo[j], hi[j], 0.4)}
    got = [p for begin in range(0, 40, 7) for p in neardup.interval_pairs(lo, hi, 0.4, begin, min(begin + 7, 40))]
    assert set(got) == want and len(got) == len(want) < 820


def test_labels_equal_connected_components():
    rng = np.random.default_rng(6)
    for n, m, p in ((1, 1, 0.5), (30, 40, 0.02), (60, 50, 0.03), (5, 9, 0.0), (40, 3, 0.4)):
        near = rng.random((n, m)) < p
        forest = common.Forest()
        for i, j in zip(*np.nonzero(near)):
            forest.join(int(i), 1000 + int(j))
        rows, columns = neardup.labels(near, False)
        assert rows.tolist() == [forest.find(i) for i in range(n)]
        assert columns.tolist() == [forest.find(1000 + j) if near[:, j].any() else n for j in range(m)]
    chain = np.zeros((50, 50), bool)
    chain[np.arange(49), np.arange(1, 50)] = chain[np.arange(1, 50), np.arange(49)] = True
    assert neardup.labels(chain, True)[0].tolist() == [0] * 50


def test_no_pair_of_blocks_is_stored(spark, monkeypatch):
    """Blocks meet where they lie: a shuffle of pairs would write their values once for each pair."""
    plans, join = [], neardup._join_blocks
    monkeypatch.setattr(neardup, "BLOCK_ROWS", 50)
    monkeypatch.setattr(neardup, "_join_blocks", lambda pairs, *more: plans.append(pairs._jdf.queryExecution().executedPlan().toString()) or join(pairs, *more))
    rows = _rows(300, 1)
    assert sorted((tuple(r) for r in neardup.components(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()), key=str) == _brute(rows)
    assert "CartesianProduct" in plans[0] and not any("Exchange hashpartitioning" in line and "block" in line for line in plans[0].splitlines())
