import json
import random

from inkwell.operators import json_diff

MISSING = "<missing>"


def _walk(a, b, path, out):
    shown = lambda v: v if isinstance(v, str) else json.dumps(v, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    for key in sorted(set(a) | set(b)):
        at = f"{path}.{key}" if path else key
        if isinstance(a.get(key), dict) and isinstance(b.get(key), dict):
            _walk(a[key], b[key], at, out)
        elif key not in a or key not in b or json.dumps(a[key], sort_keys=True) != json.dumps(b[key], sort_keys=True):
            out.append((at, shown(a[key]) if key in a else MISSING, shown(b[key]) if key in b else MISSING))
    return out


def _value(rng, depth=0):
    kind = rng.randrange(8 if depth < 4 else 6)
    if kind < 6:
        return [None, True, rng.randrange(3), rng.randrange(9) / 4 + 0.125, rng.choice(["x", "é\"q", "1", ""]), [1, {"z": rng.randrange(2)}, "a"]][kind]
    return {rng.choice(["a", "b", "c.d", "e f", "ü"]): _value(rng, depth + 1) for _ in range(rng.randint(0, 3))}


def test_differences_equal_a_walk(spark):
    rng = random.Random(6)
    pairs = [({"k": _value(rng), "a": _value(rng)}, {"k": _value(rng), "b": _value(rng), "a": _value(rng)}) for _ in range(300)]
    rows = [(i, json.dumps(a), json.dumps(b), "p") for i, (a, b) in enumerate(pairs)] + [(900, None, "{}", "p"), (901, "not json", '{"a":1}', "p"), (902, "[1]", "3", "p"), (0, json.dumps(pairs[0][0]), json.dumps(pairs[0][1]), "p")]
    df = spark.createDataFrame(rows, "i int, l string, r string, path2 string")
    got = sorted((r.i, r.path, r.a, r.b) for r in json_diff.differences(df, "i", left="l", right="r").collect())
    want = [(i, *d) for i, (a, b) in enumerate(pairs) for d in _walk(a, b, "", [])] + [(901, "a", MISSING, "1")] + [(0, *d) for d in _walk(*pairs[0], "", [])]
    assert got == sorted(want)


def test_numbers_are_equal_by_value_and_no_python_runs(spark):
    df = spark.createDataFrame([(1, '{"a": 1, "b": {"c": {"d": [1, 2]}}}', '{"b": {"c": {"d": [2, 1]}}, "a": 1.0}')], "i int, l string, r string")
    out = json_diff.differences(df, "i", left="l", right="r")
    assert [tuple(r) for r in out.collect()] == [(1, "b.c.d", "[1,2]", "[2,1]")]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_kept_columns_are_not_broadcast(spark):
    """Their size is guessed from that of a VARIANT, so millions of rows would go through the driver."""
    df = spark.range(1000).selectExpr("id AS i", "concat('{\"a\": ', id, '}') AS l", "'{}' AS r")
    out = json_diff.differences(df, "i", left="l", right="r")
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in out.collect()) == sorted((i, "a", str(i), MISSING) for i in range(1000))
