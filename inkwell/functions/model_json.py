"""Tolerant reading and strict checking of semi-structured model output, on Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkwell.functions import text as T
from inkwell.functions.bind import let

# The keys of a classified item, its types and its confidences.
KEYS = ("id", "type", "speaker", "gender", "speaker_confidence", "gender_confidence", "character_confidence")
TYPES, GENDERS = ("dialogue", "thought", "narration"), ("male", "female", "unknown")
CONFIDENCES = KEYS[4:]
# All fields are read as text, so that quoted numbers are numbers too.
ITEM = ", ".join(f"{k} STRING" for k in KEYS)
CANDIDATE_KEYS = ("id", "source_id", "chunk_id", "text", "span_start", "span_end", "delimiter_type", "is_dialogue", "type", "speaker", "character_type", "confidence", "notes")
CANDIDATE = ", ".join(f"{k} STRING" for k in CANDIDATE_KEYS)


def strip_fence(raw: Column) -> Column:
    """Without the first and last line of a fenced block."""

    def unfenced(bare: Column) -> Column:
        inner = F.regexp_replace(F.regexp_replace(bare, r"^```[^\n]*\n?", ""), r"\n?[ \t]*```[^\n]*$", "")
        return F.when(bare.startswith("```"), T.strip(inner)).otherwise(bare)

    return let(T.strip(F.coalesce(raw, F.lit(""))), unfenced)


def snippet(raw: Column) -> Column:
    """From the first opening to the last closing brace or bracket; to the end if none closes; all if none opens."""

    def cut(x: Column) -> Column:
        end = F.when(x["back"] > 0, F.length(x["text"]) - x["back"] + 1)
        size = F.when(end > x["begin"], end - x["begin"] + 1).otherwise(F.length(x["text"]))
        return F.when(x["begin"] == 0, x["text"]).otherwise(F.substring(x["text"], x["begin"], F.coalesce(size, F.length(x["text"]))))

    places = lambda t: F.struct(t.alias("text"), F.regexp_instr(t, F.lit(r"[\[{]")).alias("begin"), F.regexp_instr(F.reverse(t), F.lit(r"[\]}]")).alias("back"))
    return let(F.coalesce(raw, F.lit("")), lambda t: let(places(t), cut))


def cleaned(raw: Column) -> Column:
    """Unfenced, plain quotes, no trailing commas, the JSON part alone."""
    plain = F.translate(strip_fence(raw), "“”‘’", "\"\"''")
    return T.strip(snippet(F.regexp_replace(plain, r",\s*([}\]])", "$1")))


def repair(raw: Column) -> Column:
    """Cleaned, and a single object as an array."""
    return let(cleaned(raw), lambda p: F.when(p.startswith("{") & p.endswith("}"), F.concat(F.lit("["), p, F.lit("]"))).otherwise(p))


def strict_snippet(raw: Column) -> Column:
    """The JSON part of a text; one without an opening and a closing sign after it raises."""
    part = snippet(raw)
    return F.when(part.rlike(r"(?s)^[\[{].*[\]}]$"), part).otherwise(F.raise_error(F.lit("no JSON in the reply")).cast("string"))


def inner_snippet(raw: Column) -> Column:
    """The JSON part of a text, or null where none opens and closes."""
    return let(snippet(raw), lambda part: F.when(part.rlike(r"(?s)^[\[{].*[\]}]$"), part))


def elements(raw: Column, single: Column) -> Column:
    """The items of a reply as JSON texts: a list, also under `segments`; an object alone only where single. Null otherwise."""

    def parsed(p: Column) -> Column:
        inner = F.get_json_object(p, "$.segments")
        whole = F.when(p.startswith("["), p).when(p.startswith("{"), F.when(inner.isNotNull(), F.when(inner.startswith("["), inner)).otherwise(F.when(single, F.concat(F.lit("["), p, F.lit("]")))))
        return F.from_json(whole, "ARRAY<STRING>")

    return let(cleaned(unwrap(raw)), parsed)


def unwrap(raw: Column) -> Column:
    """The text inside a reply's envelope, whichever it has; else the reply."""
    return F.coalesce(F.get_json_object(raw, "$.response"), F.get_json_object(raw, "$.message.content"), F.get_json_object(raw, "$.choices[0].message.content"), F.get_json_object(raw, "$.choices[0].text"), raw)


def items(raw: Column) -> Column:
    """The array of items (all fields text) that a reply holds, also under `segments`; null if it is no such JSON."""

    def parsed(fixed: Column) -> Column:
        inner = F.get_json_object(fixed, "$[0].segments")
        return F.from_json(F.coalesce(F.when(inner.startswith("["), inner), fixed), f"ARRAY<STRUCT<{ITEM}>>")

    return let(repair(unwrap(raw)), parsed)


def _fault(x: Column, i: Column) -> Column:
    """The first breach within item i; null if there is none."""
    say = lambda *parts: F.concat(F.lit("Item "), i.cast("string"), *parts)
    return F.coalesce(
        F.when(x.isNull(), say(F.lit(" is not an object"))),
        *(F.when(x[k].isNull(), say(F.lit(f" lacks {k}"))) for k in KEYS),
        F.when(~F.lower(T.strip(x["type"])).isin(*TYPES), say(F.lit(" has invalid type: "), x["type"])),
        *(F.when(x[k].try_cast("double").isNull(), say(F.lit(f" {k} is not a number"))) for k in CONFIDENCES),
        *(F.when(~x[k].try_cast("double").between(0.0, 1.0), say(F.lit(f" {k} is out of range"))) for k in CONFIDENCES),
    )


def error(raw: Column, expected: Column) -> Column:
    """The first breach of the contract, in a fixed order; null if there is none.

    Checked item by item: required keys, type, confidences; then duplicate, missing and extra ids.
    """

    def ids(got: Column) -> Column:
        def apart(x: Column) -> Column:
            text = F.concat(F.lit("ID mismatch: missing "), F.array_join(x["missing"], ","), F.lit("; extra "), F.array_join(x["extra"], ","))
            return F.when((F.size(x["missing"]) > 0) | (F.size(x["extra"]) > 0), text)

        both = F.struct(F.array_sort(F.array_except(expected, got)).alias("missing"), F.array_sort(F.array_except(got, expected)).alias("extra"))
        return F.coalesce(F.when(F.size(got) != F.size(F.array_distinct(got)), F.lit("Duplicate ids in response")), let(both, apart))

    def judged(parsed: Column) -> Column:
        first = F.get(F.filter(F.transform(parsed, _fault), lambda f: f.isNotNull()), F.lit(0))
        return F.when(parsed.isNull(), F.lit("Top-level must be an array")).otherwise(F.coalesce(first, let(F.transform(parsed, lambda x: T.strip(x["id"])), ids)))

    return let(items(raw), judged)


def sanitized(item: Column) -> Column:
    """An item with every field valid: type, gender and confidences fall back to narration, unknown and 0."""
    kind = T.one_of(item["type"], TYPES, "narration")
    name = T.strip(F.coalesce(item["speaker"], F.lit("narrator")))
    number = lambda k: F.coalesce(item[k].try_cast("double"), F.lit(0.0)).alias(k)
    return F.struct(T.strip(item["id"]).alias("id"), kind.alias("type"), F.when(name == "", "narrator").otherwise(name).alias("speaker"), T.one_of(item["gender"], GENDERS, "unknown").alias("gender"), *(number(k) for k in CONFIDENCES))


def by_id(parsed: Column) -> Column:
    """Items as a map by id; of several with one id, the last."""
    named = F.filter(parsed, lambda x: x.isNotNull() & (T.strip(F.coalesce(x["id"], F.lit(""))) != ""))

    def last(kept: Column) -> Column:
        alone = F.filter(kept, lambda x, i: ~F.exists(F.slice(kept, i + 2, F.size(kept)), lambda y: T.strip(y["id"]) == T.strip(x["id"])))
        return F.map_from_entries(F.transform(alone, lambda x: F.struct(T.strip(x["id"]), x)))

    return let(named, last)


def candidate(raw: Column, expected_id: Column, source_text: Column, chunk_id: Column) -> Column:
    """One protocol candidate with defaults filled in, and `error`, its first breach (null if none)."""
    return let(F.from_json(raw, CANDIDATE), lambda x: _candidate(x, raw, expected_id, source_text, chunk_id))


def _candidate(x: Column, raw: Column, expected_id: Column, source_text: Column, chunk_id: Column) -> Column:
    or_else = lambda k, d: F.coalesce(F.nullif(T.strip(F.coalesce(x[k], F.lit(""))), F.lit("")), d)
    kind = T.segment_type(F.coalesce(x["type"], F.lit("narration")))
    name = F.when(x["speaker"].isNotNull(), T.speaker(x["speaker"], kind)).when(kind == "narration", "narrator")
    whole = F.lower(or_else("character_type", F.when(kind == "narration", "narrator").otherwise("unknown")))
    delimiter = or_else("delimiter_type", T.delimiter_type(source_text))
    sure = F.coalesce(x["confidence"].try_cast("double"), F.when(x["confidence"].isNull(), 1.0).otherwise(0.0))
    begin, end = x["span_start"].try_cast("int"), x["span_end"].try_cast("int")
    # The error texts of the contract.
    fault = F.coalesce(
        F.when(x.isNull() | ~F.startswith(F.ltrim(raw), F.lit("{")), "candidate is not an object"),
        F.when(T.strip(F.coalesce(x["id"], F.lit(""))) != expected_id, "id mismatch"),
        F.when(~whole.isin("character", "narrator", "unknown"), "character_type is invalid"),
        F.when(~delimiter.isin("none", *(d for d, _ in T.DELIMITERS)), "delimiter_type is invalid"),
        F.when(~sure.between(0.0, 1.0), "confidence must be within [0, 1]"),
        F.when(x["span_start"].isNotNull() & begin.isNull(), "span_start must be integer or null"),
        F.when(x["span_end"].isNotNull() & end.isNull(), "span_end must be integer or null"),
        F.when(end < begin, "span_end must not be before span_start"),
    )
    return F.struct(
        T.strip(x["id"]).alias("id"), or_else("source_id", expected_id).alias("source_id"), or_else("chunk_id", chunk_id).alias("chunk_id"), or_else("text", source_text).alias("text"),
        begin.alias("span_start"), end.alias("span_end"), delimiter.alias("delimiter_type"), F.coalesce(x["is_dialogue"].try_cast("boolean"), kind.isin("dialogue", "thought")).alias("is_dialogue"),
        kind.alias("type"), name.alias("speaker"), whole.alias("character_type"), sure.alias("confidence"), x["notes"].alias("notes"), fault.alias("error"),
    )


def character_rows(raw: Column) -> Column:
    """Detected characters (name, gender, confidence) of a payload, one object or an array; those without a name go."""
    parsed = F.from_json(repair(unwrap(raw)), "ARRAY<STRUCT<name STRING, gender STRING, confidence STRING>>")
    named = F.filter(parsed, lambda x: F.coalesce(x["name"], F.lit("")) != "")
    return F.transform(named, lambda x: F.struct(T.strip(x["name"]).alias("name"), T.gender(x["gender"]).alias("gender"), F.coalesce(x["confidence"].try_cast("double"), F.lit(0.0)).alias("confidence")))


def weak_extraction(found: Column, summary: Column) -> Column:
    """Whether a summary hints at more names than the number found: at most one was found and over one more is hinted."""
    names = F.regexp_extract_all(F.coalesce(summary, F.lit("")), F.lit(r"\b[A-Z][a-z]+\b"), F.lit(0))
    hinted = F.size(F.array_distinct(F.filter(names, lambda n: ~F.lower(n).isin("you", "the"))))
    return (found <= 1) & (hinted > F.greatest(found + 1, F.lit(0)))
