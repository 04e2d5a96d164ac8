import json
import sys

import pytest
from pyspark import cloudpickle

from inkwell.functions import model_json as J
from inkwell.operators import classify, dialogue
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _segments(spark, texts, chapter="c"):
    rows = [(chapter, i, f"p{i}", t, "", "", f"p{i}") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "chapter_id string, pos int, segment_id string, text string, context_before string, context_after string, paragraph_id string")


def _good(ids, **more):
    return json.dumps([{"id": i, "type": "dialogue", "speaker": "Ann", "character_type": "character", "confidence": 0.9} | more for i in ids])


def _run(spark, texts, model, size=20, **others):
    judged = dialogue.ladder(dialogue.batches(_segments(spark, texts), size), model, **others).cache()
    rows = [r.asDict() for r in dialogue.resolved(judged).orderBy("pos").collect()]
    return rows, dialogue.diagnostics(judged).first(), judged.collect()


TEXTS = ['"Hello," she said. "Go."', "He walked.", '"Yes"']


def test_a_good_reply_is_taken_as_it_is(spark):
    rows, found, _ = _run(spark, TEXTS, lambda s, u, n: _good(["p0", "p1", "p2"]))
    assert [(r["id"], r["type"], r["speaker"], r["llm_status"]) for r in rows] == [(f"p{i}", "dialogue", "Ann", "ok") for i in range(3)]
    assert (found.fallback_count, found.needs_review, found.asks, found.id_match_ratio) == (0, False, 1, 1.0)
    assert set(J.CANDIDATE_KEYS) <= set(rows[0])


def test_a_repair_prompt_names_the_error_and_the_last_reply(spark):
    def model(system, user, name):
        if name.endswith("_r0"):
            return "not json"
        assert "payload is not a list" in user and "not json" in user and "p1" in user
        return _good(["p0", "p1", "p2"])

    rows, found, _ = _run(spark, TEXTS, model)
    assert {r["llm_status"] for r in rows} == {"ok"} and found.asks == 2


def test_heuristic_segments_where_all_rungs_fail(spark):
    def broken(system, user, name):
        raise RuntimeError("down")

    rows, found, judged = _run(spark, [*TEXTS, "   "], broken, fallback=lambda s, u, n: _good(["p0"]), formatter=lambda s, u, n: "{}")
    note = (0.0, "heuristic fallback")
    assert [(r["type"], r["speaker"], r["confidence"], r["notes"]) for r in rows] == [("dialogue", "unknown", *note), ("narration", "narrator", *note), ("dialogue", "unknown", *note)]
    assert found.fallback_count == 4 and found.needs_review and found.malformed_json and not found.validation_passed and len(found.llm_failures) == 3
    assert "down" in judged[0].failures[0] and judged[0].asks == 5


@pytest.mark.parametrize(
    "reply,error,ratio",
    [
        (_good(["p0", "p0", "p1"]), "unexpected or duplicate id: p0", 1 / 3),
        (_good(["p0", "p9"]), "unexpected or duplicate id: p9", 1 / 3),
        (_good(["p0", "p1"]), "missing ids in response: p2", 2 / 3),
        (_good(["p0", "p1", "p2"], confidence=3), "confidence must be within [0, 1]", 1 / 3),
        (_good(["p0", "p1", "p2"], delimiter_type="odd"), "delimiter_type is invalid", 1 / 3),
        (_good(["p0", "p1", "p2"], character_type="odd"), "character_type is invalid", 1 / 3),
        ('["a", "b"]', "candidate is not an object", 0.0),
        (json.dumps({"id": "p0", "type": "narration"}), "payload is not a list", 0.0),
        ("{}", "payload is not a list", 0.0),
        ("[]", "missing ids in response: p0,p1,p2", 0.0),
    ],
)
def test_breaches_of_the_contract(spark, reply, error, ratio):
    _, found, judged = _run(spark, TEXTS, lambda s, u, n: reply, retries=0)
    assert judged[0].error == error and abs(found.id_match_ratio - ratio) < 1e-9


def test_a_single_object_and_an_envelope(spark):
    one = json.dumps({"id": "p0", "type": "thought", "speaker": "Bo", "character_type": "character"})
    assert _run(spark, ["*Hm*"], lambda s, u, n: one)[0][0]["speaker"] == "Bo"
    rows, _, _ = _run(spark, TEXTS, lambda s, u, n: json.dumps({"segments": json.loads(_good(["p2", "p0", "p1"]))}))
    assert [r["id"] for r in rows] == ["p0", "p1", "p2"] and {r["llm_status"] for r in rows} == {"ok"}


def test_fallback_and_formatter_are_asked_in_turn_and_batch_by_batch(spark):
    bad = lambda s, u, n: "?"
    rows, found, judged = _run(spark, TEXTS, bad, size=2, retries=1, fallback=lambda s, u, n: _good(["p0", "p1"]) if "b0" in n else "?", formatter=lambda s, u, n: _good(["p2"]))
    assert {r["llm_status"] for r in rows} == {"ok"} and found.fallback_used and found.repair_succeeded
    assert sorted((r.batch, r.rung, r.asks) for r in judged) == [(0, "fallback", 3), (1, "formatter", 4)]


def test_structured_replies_are_repaired_once_or_empty(spark):
    line = {"line_id": "a", "normalized_text": " Hi ", "speaker_name": None, "character_type": "Dialogue", "speaker_confidence": "x"}
    replies = [json.dumps([line]), json.dumps({"segments": [line]}), "{}", "broken", json.dumps([line | {"speaker_confidence": 2}]), '["x"]', None]
    rows = spark.createDataFrame([(i, r) for i, r in enumerate(replies)], "k int, reply string")
    sizes = [len(r.segments) for r in dialogue.parsed(rows).orderBy("k").collect()]
    assert sizes == [1, 1, 0, 0, 0, 0, 0]

    def repair(raw):
        if raw == "broken":
            return json.dumps([line, line])
        raise ValueError("no")

    out = dialogue.parsed(rows, repair=repair).orderBy("k").collect()
    assert [len(r.segments) for r in out] == [1, 1, 0, 2, 0, 0, 0]
    assert out[0].segments[0].asDict() == {"line_id": "a", "raw_text": "", "normalized_text": "Hi", "speaker_name": None, "speaker_confidence": 0.0, "character_type": "dialogue", "voice_hint": None}
    named = dialogue.lines(dialogue.parsed(rows), "k").where("k = 0").first()
    assert (named.speaker, named.character_id, named.text) == ("Unknown", "char_1", "Hi")


def test_classified_has_a_prompt_for_each_attempt_and_repairs(spark):
    item = lambda i: {"id": i, "type": "thought", "speaker": "Bo", "gender": "male", "speaker_confidence": 1, "gender_confidence": 1, "character_confidence": 1}

    def model(system, user):
        ids = [x["id"] for x in json.loads(user)]
        if "was not valid: ID mismatch" in system:
            return json.dumps([item(i) for i in ids])
        return json.dumps([item(i) for i in ids[1:]])

    rows = classify.classified(_segments(spark, TEXTS), model, size=20).collect()
    assert {(r.type, r.llm_status) for r in rows} == {("thought", "ok")}
    twice = lambda u: json.dumps([item("p0"), item("p0"), item("p1"), item("p2")])
    rows = sorted(classify.classified(_segments(spark, TEXTS), twice, size=20, limit=99).collect())
    assert [(r.type, r.llm_status) for r in sorted(rows, key=lambda r: r.pos)] == [("dialogue", "fallback"), ("narration", "fallback"), ("dialogue", "fallback")]
    mended = classify.classified(_segments(spark, TEXTS), twice, size=20, repair=lambda raw, error: json.dumps([item(f"p{i}") for i in range(3)])).collect()
    assert {(r.llm_status, r.repair_attempts) for r in mended} == {("ok", 1)}


def test_snippets(spark):
    row = spark.createDataFrame([('say {"a": 1} now',), ("none",)], "r string").select(J.inner_snippet(F.col("r")).alias("s")).collect()
    assert [r.s for r in row] == ['{"a": 1}', None]
    with pytest.raises(Exception, match="no JSON"):
        spark.createDataFrame([("none",)], "r string").select(J.strict_snippet(F.col("r")).alias("s")).collect()


def test_classified_joins_nothing_and_keeps_a_chapter_without_key(spark):
    rows = [(c, p, f"s{p}", '"Hi."' if p % 2 else "He left.", "", "", f"p{p}") for c in (1, None) for p in range(5)]
    df = spark.createDataFrame(rows, "chapter_id int, pos int, segment_id string, text string, context_before string, context_after string, paragraph_id string")
    out = classify.classified(df, size=2)
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
    got = sorted(((r.chapter_id or 0, r.pos, r.type, r.batch, r.batch_size, r.llm_status) for r in out.collect()))
    assert got == [(c, p, "dialogue" if p % 2 else "narration", p // 2, 1 if p == 4 else 2, "ok") for c in (0, 1) for p in range(5)]


def test_a_worker_holds_few_questions_at_once(spark):
    held = lambda s, u, n: str(int(open("/proc/self/statm").read().split()[1]) * 4096 // 10**6)  # noqa: E731  MB
    rows = spark.range(3000, numPartitions=1).select(dialogue.asked(held, F.lit(""), F.concat(F.repeat(F.lit("x"), 100_000), F.col("id").cast("string")), F.lit("n")).alias("a"))
    assert rows.agg(F.max(F.col("a.reply").cast("int"))).first()[0] < 300
