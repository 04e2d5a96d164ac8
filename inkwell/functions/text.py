"""Text functions: Column in, Column out, all built on Spark's own expressions except `normalize`."""



from functools import partial, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkwell.functions.bind import let

# Characters without width, words of reader controls, and lines of user interfaces.
ZERO_WIDTH = "\u200b\u200c\u200d\ufeff\u2060\u180e"
CONTROL_WORDS = ("raws", "translate", "forum", "reader settings", "text", "a−", "a-", "a+", "compact", "normal", "wide", "theme", "dark", "sepia", "light", "width", "default", "tools", "bottom", "top", "reset", "report bug")
CONTROL_LINES_NEEDED = 4
NAVIGATION = (r"^[←→↑↓‹›«»]\s", r"(?i)\bback to novel\b", r"(?i)^reader mode\b", r"(?i)^chapter\s+\d+\s*$")
UI_LINES = ("next chapter", "subscribe now")
# Marks of speech and thought.
SPEECH = (r"(?d)^[\"“].+[\"”]\s*$", r"(?d)^\".+?\"", r"^[A-Z][a-z]+: ", r"^\w+\s*—")
QUOTE_OPEN, QUOTE_CLOSE = r"^\s*[\"'「『【（《<]", r"[\"'「』】）》>]"
THOUGHT = (r"(?d)^\*(.*?)\*$", r"(?d)^_(.*?)_$", r"(?d)^'(.*?)'$", r"(?d)^\((.*?)\)$")
DELIMITERS = (("double_quotes", r'"([^"]+?)"'), ("single_quotes", r"(?<!\w)'([^']+?)'(?!\w)"), ("square_brackets", r"\[([^\[\]]+?)\]"), ("curly_braces", r"\{([^{}]+?)\}"), ("angle_brackets", r"<([^<>]+?)>"), ("parentheses", r"\(([^()]+?)\)"))


def strip(text: Column) -> Column:
    """Without white space (not only blanks) at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def squeeze(text: Column) -> Column:
    """Stripped, with each run of white space as one blank."""
    return strip(F.regexp_replace(text, r"\s+", " "))


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def unlines(parts: Column) -> Column:
    return F.array_join(parts, "\n")


def any_match(text: Column, patterns: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (text.rlike(p) for p in patterns))


def remove_zero_width(text: Column) -> Column:
    return F.translate(text, ZERO_WIDTH, "")


def normalize_whitespace(text: Column) -> Column:
    """Runs of blanks and of newlines shrink before lines are stripped, so blank lines made by stripping stay."""
    text = F.regexp_replace(F.regexp_replace(text, " +", " "), "\n\n+", "\n\n")
    return strip(unlines(F.transform(lines(text), strip)))


def is_control_line(line: Column) -> Column:
    return squeeze(F.lower(line)).isin(*CONTROL_WORDS)


def control_lines(text: Column) -> Column:
    """How many lines are words of reader controls."""
    return F.size(F.filter(lines(text), is_control_line))


def remove_reader_controls(text: Column) -> Column:
    """Drops control lines, but only where a text has enough of them."""
    kept = unlines(F.filter(lines(text), lambda line: ~is_control_line(line)))
    return F.when(control_lines(text) >= CONTROL_LINES_NEEDED, kept).otherwise(text)


def remove_site_navigation(text: Column) -> Column:
    return unlines(F.filter(lines(text), lambda line: ~any_match(strip(line), NAVIGATION)))


def clean(text: Column) -> Column:
    return normalize_whitespace(remove_reader_controls(remove_site_navigation(remove_zero_width(text))))


def remove_ui_lines(text: Column) -> Column:
    return strip(unlines(F.filter(lines(text), lambda line: ~F.lower(strip(line)).isin(*UI_LINES))))


def nonblank(parts: Column) -> Column:
    return F.filter(F.transform(parts, strip), lambda p: p != "")


def paragraphs(text: Column) -> Column:
    """Stripped blocks between blank lines."""
    return nonblank(F.split(text, "\n{2,}|\r{2,}", -1))


def line_paragraphs(text: Column) -> Column:
    """Stripped lines that are not blank."""
    return nonblank(F.split(text, "\n\\s*\n|\n", -1))


def sentences(text: Column) -> Column:
    return nonblank(F.split(text, "[.!?]+", -1))


def is_speech_candidate(text: Column) -> Column:
    return any_match(text, SPEECH)


def is_quoted_line(text: Column) -> Column:
    return text.rlike(QUOTE_OPEN) & text.rlike(QUOTE_CLOSE)


def thought_or(kind: Column, text: Column) -> Column:
    return F.when(any_match(strip(text), THOUGHT), F.lit("thought")).otherwise(kind)


def heuristic_type(text: Column) -> Column:
    text = strip(text)
    opens = reduce(lambda a, b: a | b, (text.startswith(q) for q in ('"', "“", "'")))
    closes = reduce(lambda a, b: a | b, (text.endswith(q) for q in ('"', "”", "'")))
    return F.when(opens & closes, "dialogue").otherwise("narration")


def heuristic_speaker(kind: Column) -> Column:
    return F.when(kind == "narration", "narrator").otherwise("unknown")


def delimiter_type(text: Column) -> Column:
    """The first kind of delimiter, in a fixed order, that encloses something; else none."""
    out = F.lit("none")
    for name, pattern in reversed(DELIMITERS):
        out = F.when(text.rlike(pattern), name).otherwise(out)
    return out


def _collector(whole: Column, inner: Column, between: Column, rank: int):
    """A fold's step: appends match i and moves on by the piece before it and its own length."""

    def step(acc: Column, i: Column) -> Column:
        at = acc["at"] + F.length(F.element_at(between, i))
        item = F.struct(at.alias("at"), F.lit(rank).alias("rank"), strip(F.element_at(inner, i)).alias("fragment"))
        return F.struct((at + F.length(F.element_at(whole, i))).alias("at"), F.array_append(acc["out"], item).alias("out"))

    return step


def fragments(text: Column, kinds: tuple[str, ...] | None = None) -> Column:
    """Delimited fragments as array<struct<at,rank,fragment>>, by where they start; kinds that are off give none.

    A match's place is the length of all that stands before it: pieces between matches and matches so far.
    """
    empty = F.array().cast("array<struct<at:int,rank:int,fragment:string>>")
    found = []
    for rank, (name, pattern) in enumerate(DELIMITERS):
        if kinds is not None and name not in kinds:
            continue
        parts = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("whole"), F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("inner"), F.split(text, pattern, -1).alias("between"))
        start = F.struct(F.lit(0).alias("at"), empty.alias("out"))

        def folded(p: Column, rank: int, start: Column) -> Column:
            step = _collector(p["whole"], p["inner"], p["between"], rank)
            return F.aggregate(F.sequence(F.lit(1), F.size(p["whole"])), start, step, lambda acc: acc["out"])

        found.append(F.when(text.rlike(pattern), let(parts, partial(folded, rank=rank, start=start))).otherwise(empty))
    every = F.array_sort(F.filter(F.flatten(F.array(*found)) if found else empty, lambda x: x["fragment"] != ""))
    fresh = lambda e: F.filter(e, lambda x, i: ~F.exists(F.slice(e, F.greatest(i - 5, F.lit(1)), F.least(i, F.lit(6))), lambda y: (y["at"] == x["at"]) & (y["fragment"] == x["fragment"])))
    return let(every, fresh)


def delimited_only(text: Column, kinds: tuple[str, ...] | None = None) -> Column:
    return strip(F.array_join(F.transform(fragments(text, kinds), lambda x: x["fragment"]), "\n"))


def name_key(name: Column) -> Column:
    """A name for look-ups: stripped, lower, without full stops and commas, double blanks halved once."""
    return F.replace(F.regexp_replace(F.lower(strip(name)), "[.,]", ""), F.lit("  "), F.lit(" "))


def squeezed_key(name: Column) -> Column:
    return squeeze(F.lower(F.coalesce(name, F.lit(""))))


def speaker(name: Column, kind: Column) -> Column:
    """Without closing punctuation; narrator and unknown in lower case; an empty name goes by the segment's type."""
    bare = F.regexp_replace(strip(F.coalesce(name, F.lit(""))), r"(\s*[.,!?;:])+\s*$", "")
    low = F.lower(bare)
    return F.when(bare == "", F.when(kind == "narration", "narrator").otherwise("unknown")).when(low.isin("narrator", "unknown"), low).otherwise(bare)


def one_of(value: Column, allowed: tuple[str, ...], default: str) -> Column:
    low = F.lower(strip(F.coalesce(value, F.lit(""))))
    return F.when(low.isin(*allowed), low).otherwise(default)


def segment_type(value: Column) -> Column:
    return one_of(value, ("dialogue", "thought", "narration"), "narration")


def gender(value: Column) -> Column:
    return one_of(value, ("male", "female"), "unknown")


def structured_type(value: Column) -> Column:
    low = F.lower(strip(F.coalesce(value, F.lit(""))))
    return F.when(low.isin("dialogue", "thought", "system"), low).otherwise("narration")


def escape_markup(text: Column, quotes: bool = False) -> Column:
    pairs = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")] + ([('"', "&quot;"), ("'", "&#x27;")] if quotes else [])
    return reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), pairs, text)


def slug(text: Column, default: str = "book") -> Column:
    out = F.regexp_replace(F.regexp_replace(F.lower(strip(text)), r"[^\p{L}\p{N}]+", "-"), "^-+|-+$", "")
    return F.when(out == "", default).otherwise(out)


def safe_filename(text: Column, default: str = "untitled") -> Column:
    out = strip(F.translate(text, '\\/:*?"<>|', ""))
    return F.when(out == "", default).otherwise(out)


def wav_filename(path: Column) -> Column:
    base = F.regexp_extract(path, r"([^/\\]*)$", 1)
    bare = F.regexp_replace(F.regexp_replace(base, "[^A-Za-z0-9._-]", "_"), r"^[._-]+|[._-]+$", "")
    return F.when(F.lower(bare).endswith(".wav"), bare).otherwise(F.concat(bare, F.lit(".wav")))


def preview(text: Column, size: int = 500) -> Column:
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("…"))).otherwise(text)


def file_number(stem: Column, position: Column) -> Column:
    """A chapter's number in a file name: after chapter, ch, ep or part; else leading, else trailing digits; else its place from 1."""
    found = (F.regexp_extract(stem, r"(?i)(?:chapter|ch|ep|part)[_\-\s]*(\d+)", 1), F.regexp_extract(stem, r"^(\d+)", 1), F.regexp_extract(stem, r"(\d+)$", 1))
    return F.coalesce(*(F.nullif(x, F.lit("")).cast("int") for x in found), (position + 1).cast("int"))


def apply_rules(text: Column, rules: list[dict], glossary: dict[str, str] | None = None, case_sensitive: bool = True) -> Column:
    """Replaces by rules in order, then by the glossary, which always minds case.

    A rule has pattern, replacement, is_regex (false) and enabled (true). Back references are \\1 as in Python;
    a pattern that does not compile is skipped.
    """
    import re

    for rule in rules:
        if not rule.get("enabled", True):
            continue
        pattern, new = rule["pattern"], rule["replacement"]
        if not rule.get("is_regex") and case_sensitive:
            text = F.replace(text, F.lit(pattern), F.lit(new)) if pattern else text
            continue
        try:
            re.compile(pattern if rule.get("is_regex") else re.escape(pattern))
        except re.error:
            continue
        if not rule.get("is_regex"):
            pattern = re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", pattern)
        new = re.sub(r"\\(\d)", r"$\1", new.replace("$", "\\$"))
        text = F.regexp_replace(text, pattern if case_sensitive else f"(?i){pattern}", new)
    for term, new in (glossary or {}).items():
        text = F.replace(text, F.lit(term), F.lit(new))
    return text


def normalize(text: Column) -> Column:
    """Character references decoded, NFC, typographic quotes and dots made plain, at most two newlines in a row, stripped."""
    import pandas as pd

    @F.pandas_udf("string")
    def decoded(values: pd.Series) -> pd.Series:
        import html
        import unicodedata

        return values.map(lambda v: None if v is None else unicodedata.normalize("NFC", html.unescape(v)))

    plain = F.replace(F.translate(decoded(text), "‘’“”\u00a0", "''\"\" "), F.lit("…"), F.lit("..."))
    return strip(F.regexp_replace(plain, "\n{3,}", "\n\n"))
