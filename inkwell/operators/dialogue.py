"""Pass 2 by a ladder of models: each rung is asked only where the reply before broke the contract, then heuristics.

A rung is a column over a table of batches, so all batches of all chapters run side by side, the table is never
shuffled between rungs, and what was asked, failed and repaired stays on the batch's own row.
"""

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions import model_json as J
from inkwell.functions import text as T
from inkwell.functions.bind import let
from inkwell.operators import characters as C
from inkwell.operators import replies
from inkwell.operators import segments as S

SYSTEM = "Classify every segment. Answer with a JSON array that has one object for each id, with the fields " + ", ".join(J.CANDIDATE_KEYS) + "."
FORMAT = "You mend malformed JSON. Answer with a JSON array only."


class Model(Protocol):
    """A model that is asked with a system text, a user text and a name for logs, and answers with text; what it raises is a failure."""

    def __call__(self, system: str, user: str, name: str) -> str: ...


def asked(model: Callable[[str, str, str], str], system: Column, user: Column, name: Column) -> Column:
    """struct<reply, fault>: the model's answer where user is not null. It is not asked twice for a row of one plan.

    Questions are long and each rung of each task has a worker of its own, so they go there as rows, a hundred at a
    time: an Arrow batch would hold ten thousand at once, whatever their length.
    """

    @F.udf("reply string, fault string", useArrow=False)
    def ask(s: str, u: str, n: str) -> tuple:
        try:
            return (None, None) if u is None else (model(s, u, n), None)
        except Exception as fault:  # noqa: BLE001  any failure of a model is a failed attempt
            return None, f"{n}:{fault}"

    return ask.asNondeterministic()(system, user, name)


def _verdict(reply: Column, items: Column, chunk: Column) -> Column:
    """struct<error, ratio>: the first breach of the pass-2 contract (null if none), and the share of ids met until then."""
    count = F.greatest(F.size(items), F.lit(1)).cast("double")

    def judged(found: Column) -> Column:
        ids = F.transform(found, lambda e: T.strip(F.coalesce(F.get_json_object(e, "$.id"), F.lit(""))))

        def faults(ids: Column) -> Column:
            def one(e: Column, i: Column) -> Column:
                own = F.get(ids, i)
                source = F.get(F.filter(items, lambda x: x["id"] == own), F.lit(0))
                strange = source.isNull() | F.array_contains(F.slice(ids, 1, i), own)
                said = J.candidate(e, own, source["text"], chunk)["error"]
                # Fixed values here and below: the error texts of the contract.
                return F.coalesce(
                    F.when(e.isNull() | ~F.startswith(F.ltrim(e), F.lit("{")), F.struct(F.lit("candidate is not an object").alias("error"), F.lit(0.0).alias("ratio"))),
                    F.when(strange, F.struct(F.concat(F.lit("unexpected or duplicate id: "), F.when(own == "", "<empty>").otherwise(own)).alias("error"), (i / count).alias("ratio"))),
                    F.when(said.isNotNull(), F.struct(said.alias("error"), ((i + 1) / count).alias("ratio"))),
                )

            missing = F.array_sort(F.array_except(F.transform(items, lambda x: x["id"]), ids))
            short = F.struct(F.concat(F.lit("missing ids in response: "), F.array_join(missing, ",")).alias("error"), (F.size(ids) / count).alias("ratio"))
            fine = F.struct(F.lit(None).cast("string").alias("error"), F.lit(1.0).alias("ratio"))
            return F.coalesce(F.get(F.filter(F.transform(found, one), lambda f: f.isNotNull()), F.lit(0)), F.when(F.size(missing) > 0, short), fine)

        bad = F.struct(F.lit("payload is not a list").alias("error"), F.lit(0.0).alias("ratio"))
        return F.when(found.isNull(), bad).otherwise(let(ids, faults))

    return let(J.elements(reply, F.size(items) == 1), judged)


def batches(segments: DataFrame, size: int = 20, chapter: str = "chapter_id") -> DataFrame:
    """(chapter, batch, items): tumbling batches; items are (pos, id, text, context_before, context_after) in order."""
    rows = segments.withColumn("batch", S.batch_number(F.col("pos"), size))
    item = F.struct(F.col("pos").cast("long").alias("pos"), F.col("segment_id").alias("id"), "text", "context_before", "context_after")
    return rows.groupBy(chapter, "batch").agg(F.array_sort(F.collect_list(item)).alias("items"))


def ladder(work: DataFrame, model: Model, fallback: Model | None = None, formatter: Model | None = None, retries: int = 2, chapter: str = "chapter_id", store: str | None = None) -> DataFrame:
    """Batches with the reply that kept the contract, which rung gave it, and what went wrong on the way.

    The model is asked, then asked to repair its reply up to `retries` times; a fallback model is asked as at first;
    a formatter is given the model's last reply to mend. Adds reply, error (null where a reply is good), ratio (ids
    met by the last reply), rung (model, fallback, formatter or heuristic), asks, malformed and failures. Write the
    result once: whoever reads this plan twice asks the models twice. With `store`, the path of a table of replies, each
    question is asked once, in this run and in later ones (replies.answered); what failed is asked again.
    """
    chunk = F.col(chapter).cast("string")
    source = F.to_json(F.transform("items", lambda x: F.struct(x["id"].alias("id"), x["text"].alias("text"), x["context_before"].alias("context_before"), x["context_after"].alias("context_after"))))
    ids = F.to_json(F.transform("items", lambda x: x["id"]))
    last = F.coalesce(F.col("primary"), F.lit("[]"))
    again = F.concat(F.lit("Your last reply broke the protocol. Answer again, with JSON only.\nERROR: "), F.coalesce("error", F.lit("")), F.lit("\nEXPECTED_IDS: "), ids, F.lit("\nSOURCE_LIST: "), source, F.lit("\nINVALID_RESPONSE: "), last, F.lit("\nFields of each item: " + ", ".join(J.CANDIDATE_KEYS)))
    mend = F.concat(F.lit("SOURCE_LIST: "), source, F.lit("\nMALFORMED_RESPONSE: "), last, F.lit("\nFields of each item: " + ", ".join(J.CANDIDATE_KEYS)))
    rungs = [("model", model, SYSTEM, source if i == 0 else again, f"r{i}") for i in range(retries + 1)]
    rungs += [("fallback", fallback, SYSTEM, source, "f")] if fallback else []
    rungs += [("formatter", formatter, FORMAT, mend, "m")] if formatter else []
    none = F.lit(None).cast("string")
    df = work.select("*", none.alias("reply"), none.alias("primary"), F.lit("no reply").alias("error"), F.lit(0.0).alias("ratio"), F.lit("heuristic").alias("rung"), F.lit(0).alias("asks"), F.array().cast("array<string>").alias("failures"))
    for kind, who, system, user, mark in rungs:
        open_ = F.col("error").isNotNull()
        name = F.concat(chunk, F.lit("_p2b"), F.col("batch").cast("string"), F.lit(f"_{mark}"))
        if store is None:
            df = df.withColumn("__a", asked(who, F.lit(system), F.when(open_, user), name))
        else:
            df = df.withColumns({"__s": F.lit(system), "__u": F.when(open_, user), "__n": name})
            df = replies.answered(df, lambda s, u, n, who=who: asked(who, s, u, n), store, kind, "__s", "__u", "__n", "__a").drop("__s", "__u", "__n")
        df = df.withColumn("__v", F.when(open_, _verdict(F.col("__a.reply"), F.col("items"), chunk)))
        good = open_ & F.col("__v.error").isNull()
        df = df.withColumns({
            "reply": F.when(good, F.col("__a.reply")).otherwise(F.col("reply")),
            "primary": F.when(open_, F.col("__a.reply")).otherwise(F.col("primary")) if kind == "model" else F.col("primary"),
            "ratio": F.when(open_, F.col("__v.ratio")).otherwise(F.col("ratio")),
            "rung": F.when(good, kind).otherwise(F.col("rung")),
            "asks": F.col("asks") + open_.cast("int"),
            "failures": F.when(F.col("__a.fault").isNotNull(), F.array_append("failures", F.col("__a.fault"))).otherwise(F.col("failures")),
            "error": F.when(open_, F.col("__v.error")).otherwise(F.col("error")),
        }).drop("__a", "__v")
    return df.withColumn("malformed", F.col("error").isNotNull()).drop("primary")


def resolved(judged: DataFrame, chapter: str = "chapter_id") -> DataFrame:
    """Segments of judged batches in the 13 protocol fields and llm_status: a good reply's candidate by id, else the heuristic segment.

    A fallback segment has its heuristic type and speaker, confidence 0 and a note. Blank texts are dropped, and types
    and speakers are made valid (see `tidy`).
    """
    chunk = F.col(chapter).cast("string")

    def candidates(found: Column) -> Column:
        def one(e: Column) -> Column:
            own = T.strip(F.get_json_object(e, "$.id"))
            return F.struct(own, J.candidate(e, own, F.get(F.filter("items", lambda x: x["id"] == own), F.lit(0))["text"], chunk))

        return F.map_from_entries(F.transform(found, one))

    by_id = F.when(F.col("error").isNull(), let(J.elements(F.col("reply"), F.size("items") == 1), candidates))
    rows = judged.withColumn("__m", by_id).select(chapter, "__m", F.explode("items").alias("i")).select(chapter, "i.pos", "i.id", F.col("i.text").alias("__t"), F.col("__m")[F.col("i.id")].alias("c"))
    kind = T.heuristic_type(F.col("__t"))
    missed = {
        "source_id": F.col("id"), "chunk_id": chunk, "span_start": F.lit(None).cast("int"), "span_end": F.lit(None).cast("int"), "delimiter_type": T.delimiter_type(F.col("__t")), "is_dialogue": F.lit(False),
        "type": kind, "speaker": T.heuristic_speaker(kind), "character_type": F.lit("unknown"), "confidence": F.lit(0.0), "notes": F.lit("heuristic fallback"),
    }
    pick = lambda k: F.when(F.col("c").isNotNull(), F.col(f"c.{k}")).otherwise(missed[k]).alias(k)
    out = rows.select(chapter, "pos", "id", pick("source_id"), pick("chunk_id"), F.col("__t").alias("text"), *(pick(k) for k in list(missed)[2:]), F.when(F.col("c").isNotNull(), "ok").otherwise("fallback").alias("llm_status"))
    return tidy(out)


def tidy(segments: DataFrame, text: str = "text") -> DataFrame:
    """Without segments of blank text; every type is valid and every speaker named."""
    rows = segments.where(T.strip(F.coalesce(F.col(text), F.lit(""))) != "").withColumn("type", T.segment_type(F.col("type")))
    return rows.withColumn("speaker", T.speaker(F.col("speaker"), F.col("type")))


def diagnostics(judged: DataFrame, chapter: str = "chapter_id") -> DataFrame:
    """One row for each chapter: how its batches went. A chapter without batches has none; an id ratio is 1 where nothing was asked."""
    rung = lambda *names: F.coalesce(F.bool_or(F.col("rung").isin(*names)), F.lit(False))
    bad = F.col("error").isNotNull()
    return judged.groupBy(chapter).agg(
        F.count("*").alias("batches"),
        F.sum(F.when(bad, F.size("items")).otherwise(0)).alias("fallback_count"),
        F.bool_or("malformed").alias("malformed_json"),
        F.bool_or(bad).alias("needs_review"),
        F.bool_and(~bad).alias("validation_passed"),
        rung("fallback").alias("fallback_used"),
        rung("formatter").alias("repair_succeeded"),
        F.sum("asks").alias("asks"),
        id_match_ratio(F.col("ratio")).alias("id_match_ratio"),
        F.flatten(F.array_sort(F.collect_list(F.struct("batch", "failures")))["failures"]).alias("llm_failures"),
    )


def id_match_ratio(ratio: Column) -> Column:
    """An aggregate: the mean of the batches' ratios, 1 without any."""
    return F.coalesce(F.avg(ratio), F.lit(1.0))


# ---- replies that are whole lists of segments ----

#: Fields of a structured segment, all read as text.
LINE = ("line_id", "raw_text", "normalized_text", "speaker_name", "speaker_confidence", "character_type", "voice_hint")


def structured(raw: Column) -> Column:
    """A reply's segments, null if it is no JSON of them: a list, or an object whose segments are a list (none if it has none)."""
    kind = f"ARRAY<STRUCT<{', '.join(f'{k} STRING' for k in LINE)}>>"

    def parsed(p: Column) -> Column:
        inner = F.get_json_object(p, "$.segments")
        whole = F.when(p.startswith("["), p).when(p.startswith("{") & F.from_json(p, "MAP<STRING,STRING>").isNotNull(), F.coalesce(inner, F.lit("[]")))
        return let(F.from_json(whole, "ARRAY<STRING>"), lambda e: F.when(~F.exists(e, lambda x: x.isNull() | ~F.startswith(F.ltrim(x), F.lit("{"))), F.from_json(whole, kind)))

    def valid(lines: Column) -> Column:
        sure = lambda x: F.coalesce(x["speaker_confidence"].try_cast("double"), F.lit(0.0))
        line = lambda x: F.struct(F.coalesce(x["line_id"], F.lit("")).alias("line_id"), F.coalesce(x["raw_text"], F.lit("")).alias("raw_text"), T.strip(F.coalesce(x["normalized_text"], F.lit(""))).alias("normalized_text"), x["speaker_name"].alias("speaker_name"), sure(x).alias("speaker_confidence"), T.structured_type(x["character_type"]).alias("character_type"), x["voice_hint"].alias("voice_hint"))
        return F.when(F.forall(lines, lambda x: sure(x).between(0.0, 1.0)), F.transform(lines, line))

    return let(let(J.cleaned(raw), parsed), valid)


def parsed(replies: DataFrame, raw: str = "reply", repair: Callable[[str], str] | None = None, out: str = "segments") -> DataFrame:
    """Adds the structured segments of each reply; a bad one is repaired once at most, and is an empty list if that fails too."""
    rows = replies.withColumn(out, structured(F.col(raw)))
    if repair is not None:
        told = asked(lambda system, user, name: repair(user), F.lit(""), F.when(F.col(out).isNull(), F.coalesce(F.col(raw), F.lit(""))), F.lit("repair"))
        rows = rows.withColumn("__r", told).withColumn(out, F.coalesce(F.col(out), F.when(F.col("__r.reply").isNotNull(), structured(F.col("__r.reply"))))).drop("__r")
    empty = structured(F.lit("[]"))
    return rows.withColumn(out, F.coalesce(F.col(out), empty))


def lines(replies: DataFrame, *keys: str, segments: str = "segments", narrator: str = "Narrator", unknown: str = "Unknown") -> DataFrame:
    """(keys, pos, line_id, text, segment_type, speaker, character_id, speaker_confidence, voice_hint) of structured segments.

    Blank texts go; a missing speaker is the narrator's name, or the unknown one's for speech and thoughts. A speaker
    is spelt as at its first place, and numbered within keys by that (see characters.registry).
    """
    rows = replies.select(*keys, F.posexplode(segments).alias("pos", "s")).where(T.strip(F.col("s.normalized_text")) != "")
    named = F.nullif(T.strip(F.coalesce("s.speaker_name", F.lit(""))), F.lit(""))
    rows = rows.select(*keys, "pos", F.col("s.line_id").alias("line_id"), F.col("s.normalized_text").alias("text"), F.col("s.character_type").alias("segment_type"), F.coalesce(named, F.when(F.col("s.character_type").isin("dialogue", "thought"), unknown).otherwise(narrator)).alias("speaker"), F.col("s.speaker_confidence").alias("speaker_confidence"), F.col("s.voice_hint").alias("voice_hint"))
    ids = C.registry(rows, *keys).select(*keys, F.col("key").alias("__k"), "character_id", "display_name")
    out = rows.withColumn("__k", F.lower(T.strip(F.col("speaker")))).join(ids, [*keys, "__k"])
    return out.select(*keys, "pos", "line_id", "text", "segment_type", F.col("display_name").alias("speaker"), "character_id", "speaker_confidence", "voice_hint")
