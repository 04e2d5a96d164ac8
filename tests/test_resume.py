import json

from pyspark.sql import functions as F

from inkwell.operators import dialogue
from inkwell.operators import replies
from inkwell.operators import segments as S
from inkwell.sources import manifest


def _calls(path):
    return [json.loads(line) for line in path.read_text().splitlines()] if path.exists() else []


def test_a_question_is_asked_once_over_two_runs(spark, tmp_path):
    log, store = tmp_path / "log", f"file://{tmp_path}/replies"

    def model(system, user, name):
        with open(log, "a") as file:  # tasks of one machine: each call is a line
            file.write(json.dumps([system, user]) + "\n")
        if "bad" in user:
            raise ValueError("no")
        return f"reply to {user}"

    rows = spark.createDataFrame([(i, "sys", None if i == 7 else f"q{i % 3}" if i else "bad", f"n{i}") for i in range(12)], "i int, s string, u string, n string").repartition(4)
    ask = lambda s, u, n: dialogue.asked(model, s, u, n)
    for run in (1, 2):
        out = replies.answered(rows, ask, store, "m", "s", "u", "n")
        for _ in range(2):  # a plan that is read twice
            got = {r.i: r.answer for r in out.collect()}
        assert got[7] is None and got[0].reply is None and got[0].fault.endswith("no")
        assert all(got[i].reply == f"reply to q{i % 3}" for i in range(1, 12) if i != 7)
        calls = sorted(u for _, u in _calls(log))
        assert calls == sorted(["q0", "q1", "q2"] + ["bad"] * run)
    more = rows.withColumn("s", F.lit("other"))
    replies.answered(more, ask, store, "m", "s", "u", "n").collect()
    assert len(_calls(log)) == 5 + 4


def test_the_ladder_asks_equal_batches_once(spark, tmp_path):
    log, store = tmp_path / "log", f"file://{tmp_path}/replies"

    def model(system, user, name):
        with open(log, "a") as file:
            file.write(json.dumps(user[:40]) + "\n")
        return "[]"

    chapters = spark.createDataFrame([(f"c{i}", "One.\nTwo.") for i in range(2)], "chapter_id string, text string")
    work = dialogue.batches(S.extract(chapters), 20)
    plain = dialogue.ladder(work, model, retries=1).collect()
    first = len(_calls(log))
    kept = dialogue.ladder(work, model, retries=1, store=store).collect()
    assert [(r.chapter_id, r.rung, r.error, r.asks) for r in sorted(kept, key=str)] == [(r.chapter_id, r.rung, r.error, r.asks) for r in sorted(plain, key=str)]
    second = len(_calls(log))
    assert second - first == first == 4
    dialogue.ladder(work, model, retries=1, store=store).collect()
    assert len(_calls(log)) == second


def test_only_changed_chapters_are_done_again(spark, tmp_path):
    out, later, path = (f"file://{tmp_path}/{n}" for n in ("one", "two", "manifest"))
    texts = {f"c{i}": f"text {i}" for i in range(30)}

    def table():
        return spark.createDataFrame([(k, p, t) for k, t in texts.items() for p in range(2)], "chapter_id string, pos int, text string").repartition(3)

    def both(run):
        mark = lambda df: df.where("text <> 'nothing'").withColumn("run", F.lit(run))
        a = manifest.run(table(), mark, out, path, "one")
        b = manifest.run(spark.read.parquet(out).drop("run"), mark, later, path, "two")
        rows = {r.chapter_id: r for r in spark.read.parquet(later).collect()}
        return a, b, {k: (r.text, r.run) for k, r in rows.items()}

    assert both(1)[:2] == (30, 30)
    assert both(2) == (0, 0, {k: (t, 1) for k, t in texts.items()})
    texts["c7"] = "another text"
    want = {k: (t, 3 if k == "c7" else 1) for k, t in texts.items()}
    assert both(3) == (1, 1, want)
    texts["c8"] = "nothing"
    del texts["c9"], want["c8"], want["c9"]
    assert both(4) == (1, 0, want)
    texts["c8"] = "back"
    assert both(5) == (1, 1, want | {"c8": ("back", 5)})
