"""Batch classification by a pluggable model, with validation, retries and a heuristic fallback."""

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.functions import model_json as J
from inkwell.functions import text as T
from inkwell.operators import segments as S

OK, FALLBACK = "ok", "fallback"
OUT = "text string, type string, speaker string, gender string, speaker_confidence double, gender_confidence double, character_confidence double, paragraph_id string, voice string, emotion string, prior_segment_text string, next_segment_text string, llm_status string"


def prompts(segments: DataFrame, size: int, chapter: str = "chapter_id") -> DataFrame:
    """(chapter, batch, ids, prompt): tumbling batches of segments as JSON for a model."""
    rows = segments.withColumn("batch", S.batch_number(F.col("pos"), size))
    item = F.to_json(F.struct(F.col("segment_id").alias("id"), "text", "context_before", "context_after"))
    grouped = rows.groupBy(chapter, "batch").agg(F.array_sort(F.collect_list(F.struct("pos", F.col("segment_id").alias("id"), item.alias("item")))).alias("rows"))
    return grouped.select(chapter, "batch", F.transform("rows", lambda r: r["id"]).alias("ids"), F.concat(F.lit("["), F.array_join(F.transform("rows", lambda r: r["item"]), ","), F.lit("]")).alias("prompt"))


def applied(segments: DataFrame, replies: DataFrame, size: int, chapter: str = "chapter_id") -> DataFrame:
    """Segments with a batch reply's classification where it keeps the contract, else the heuristic segment with status fallback.

    replies has (chapter, batch, reply). Nothing but built-in expressions runs.
    """
    expected = prompts(segments, size, chapter).select(chapter, "batch", "ids")
    judged = expected.join(replies, [chapter, "batch"], "left").withColumn("error", F.when(F.col("reply").isNull(), "no reply").otherwise(J.error(F.col("reply"), F.col("ids"))))
    good = judged.where("error is null").select(chapter, "batch", F.explode(J.items(F.col("reply"))).alias("i")).select(chapter, J.sanitized(F.col("i")).alias("c"))
    good = good.select(F.col(chapter).alias("__c"), F.col("c.id").alias("__i"), "c")
    rows = segments.join(good, (F.col(chapter) == F.col("__c")) & (F.col("segment_id") == F.col("__i")), "left")
    given = lambda name, default: F.coalesce(F.col(name), F.lit(default)) if name in segments.columns else F.lit(default)
    pick = lambda k, default: F.coalesce(F.col(f"c.{k}"), F.lit(default)).alias(k)
    kind = T.heuristic_type(F.col("text"))
    return rows.select(
        chapter, "pos", "text", F.coalesce("c.type", kind).alias("type"), F.coalesce("c.speaker", T.heuristic_speaker(kind)).alias("speaker"), pick("gender", "unknown"), *(pick(k, 0.0) for k in J.CONFIDENCES), "paragraph_id",
        given("voice", "").alias("voice"), given("emotion", "neutral").alias("emotion"), F.col("context_before").alias("prior_segment_text"), F.col("context_after").alias("next_segment_text"),
        F.when(F.col("c").isNotNull(), OK).otherwise(FALLBACK).alias("llm_status"),
    )


def heuristic_reply(prompt: str) -> str:
    """A deterministic stand-in for a model: quoted text is speech by an unknown speaker, all else narration."""
    import json

    out = []
    for item in json.loads(prompt):
        text = item["text"].strip()
        speech = text[:1] in "\"“'" and text[-1:] in "\"”'" and bool(text)
        out.append({"id": item["id"], "type": "dialogue" if speech else "narration", "speaker": "unknown" if speech else "narrator", "gender": "unknown", "speaker_confidence": 0.5, "gender_confidence": 0.0, "character_confidence": 0.0})
    return json.dumps(out)


#: What a model is told at its first, second and later attempts; the second names what was wrong.
SYSTEMS = ("Classify each segment. Answer with a JSON array of objects with the fields " + ", ".join(J.KEYS) + ".", "Your last answer was not valid: {error}. Answer with the JSON array only, one object for each id.", "Answer with nothing but a JSON array that starts with [ and ends with ].")


def fault_of(reply, expected: list[str]) -> tuple[str | None, dict]:
    """What breaks the contract of a batch's reply (null if nothing), and its items by id."""
    import json

    try:
        found = json.loads(reply) if isinstance(reply, str) else reply
    except ValueError:
        return "not JSON", {}
    if isinstance(found, dict):
        found = found.get("segments", [found] if len(expected) == 1 else None)
    if not isinstance(found, list):
        return "Top-level must be an array", {}
    by_id: dict = {}
    for i, item in enumerate(found):
        missing = [k for k in J.KEYS if not isinstance(item, dict) or item.get(k) is None]
        if missing:
            return f"Item {i} lacks {missing[0]}", {}
        if str(item["type"]).strip().lower() not in J.TYPES:
            return f"Item {i} has invalid type: {item['type']}", {}
        for k in J.CONFIDENCES:
            try:
                if not 0 <= float(item[k]) <= 1:
                    return f"Item {i} {k} is out of range", {}
            except (TypeError, ValueError):
                return f"Item {i} {k} is not a number", {}
        key = str(item["id"]).strip()
        if key in by_id:
            return "Duplicate ids in response", {}
        by_id[key] = item
    return (None, by_id) if set(by_id) == set(expected) else ("ID mismatch", {})


def question(ids, texts, befores, afters) -> str:
    """The user text of a batch."""
    import json

    return json.dumps([{"id": i, "text": t, "context_before": b, "context_after": a} for i, t, b, a in zip(ids, texts, befores, afters)])


def attempted(model: Callable, plain: bool, attempt: int, error: str, ask: str, expected: list[str], repair, left: int) -> tuple[str | None, dict, int]:
    """One attempt at a batch: the breach of the contract (null if none), items by id, and how many repairs it took of those that are left."""
    mended = 0
    try:
        reply = model(ask) if plain else model(SYSTEMS[min(attempt, 2)].format(error=error), ask)
        error, got = fault_of(reply, expected)
        while error and repair is not None and mended < left:
            mended += 1
            error, got = fault_of(repair(str(reply), error), expected)
        return error, got, mended
    except Exception as fault:  # noqa: BLE001  any failure of a model is a failed attempt
        return str(fault) or "failed", {}, mended


def classified(segments: DataFrame, model: Callable = heuristic_reply, size: int = 20, limit: int = 3, attempts: int = 3, chapter: str = "chapter_id", repair: Callable[[str, str], str] | None = None, repairs: int = 1) -> DataFrame:
    """Runs a model over each chapter's segments in order.

    The model is called with (system, user), or with the user text alone if it takes one argument. Each attempt has its
    own system text, and a bad reply may be mended up to `repairs` times by repair(reply, error). After `limit` failed
    batches a chapter goes on with single segments, so batch borders depend on what came before; that state is why a
    chapter is one group. A batch that fails all attempts becomes the heuristic segment.
    """
    import inspect

    plain = len(inspect.signature(model).parameters) == 1

    def answers(table: list[dict]) -> list[tuple]:
        import json

        rows, at, failures, batch = [], 0, 0, 0
        while at < len(table):
            n = 1 if failures >= limit else max(1, size or len(table))
            part = table[at : at + n]
            expected = [str(r["segment_id"]) for r in part]
            ask = question(expected, *([r[c] for r in part] for c in ("text", "context_before", "context_after")))
            error, got, mended = "no reply", {}, 0
            for attempt in range(attempts):
                error, got, more = attempted(model, plain, attempt, error, ask, expected, repair, repairs - mended)
                mended += more
                if error is None:
                    break
            failures += error is not None
            rows += [(batch, len(part), error is None, mended, json.dumps(got[i]) if error is None else None) for i in expected]
            at, batch = at + n, batch + 1
        return rows

    import pyarrow as pa

    kind = pa.struct([("batch", pa.int32()), ("batch_size", pa.int32()), ("ok", pa.bool_()), ("repair_attempts", pa.int32()), ("item", pa.string())])

    @F.arrow_udf("array<struct<batch:int,batch_size:int,ok:boolean,repair_attempts:int,item:string>>")
    def answered(chapters: pa.Array) -> pa.Array:
        out, total = [], [0]
        for one in chapters:
            rows = answers(one.as_py())
            out.append(pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kind)], fields=list(kind)))
            total.append(total[-1] + len(rows))
        return pa.ListArray.from_arrays(pa.array(total, pa.int32()), pa.concat_arrays(out) if out else pa.array([], kind))

    # A chapter is one row: it goes to the model and back beside its texts, so no frame is made and nothing is joined.
    told = ("segment_id", "text", "context_before", "context_after")
    whole = segments.groupBy(chapter).agg(F.array_sort(F.collect_list(F.struct("pos", *told, "paragraph_id"))).alias("__s"))
    asked = whole.withColumn("__a", answered.asNondeterministic()(F.transform("__s", lambda x: F.struct(*(x[c].alias(c) for c in told)))))
    rows = asked.select(chapter, F.explode(F.arrays_zip("__s", "__a")).alias("__r")).select(chapter, *(F.col(f"__r.__s.{c}").alias(c) for c in ("pos", "text", "paragraph_id")), "__r.__a.*")
    item = J.sanitized(F.from_json("item", f"STRUCT<{J.ITEM}>"))
    rows = rows.withColumn("c", F.when(F.col("ok"), item))
    guess = T.heuristic_type(F.col("text"))
    pick = lambda k, default: F.coalesce(F.col(f"c.{k}"), F.lit(default)).alias(k)
    return rows.select(chapter, "pos", "text", F.coalesce("c.type", guess).alias("type"), F.coalesce("c.speaker", T.heuristic_speaker(guess)).alias("speaker"), pick("gender", "unknown"), *(pick(k, 0.0) for k in J.CONFIDENCES), "paragraph_id", "batch", "batch_size", "repair_attempts", F.when(F.col("ok"), OK).otherwise(FALLBACK).alias("llm_status"))


def with_heuristics(segments: DataFrame, text: str = "text") -> DataFrame:
    kind = T.thought_or(T.heuristic_type(F.col(text)), F.col(text))
    return segments.withColumn("type", kind).withColumn("speaker", T.heuristic_speaker(F.col("type")))
