"""Chapters to ordered segments: paragraphs with ids and neighbours, chunks, batches, timings."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions import text as T
from inkwell.operators import ranks


def explode_parts(chapters: DataFrame, parts: Column, chapter: str = "chapter_id", out: str = "text") -> DataFrame:
    """(chapter, pos, text) for each element of parts; pos counts from 0."""
    return chapters.select(chapter, F.posexplode(parts).alias("pos", out))


def with_ids(segments: DataFrame, chapter: str = "chapter_id") -> DataFrame:
    number = lambda kind: F.concat(F.col(chapter).cast("string"), F.lit(f"_{kind}"), F.lpad(F.col("pos").cast("string"), F.greatest(F.lit(3), F.length(F.col("pos").cast("string"))), F.lit("0")))
    return segments.withColumn("paragraph_id", number("p")).withColumn("segment_id", number("s"))


def with_context(segments: DataFrame, *keys: str, order: str = "pos", text: str = "text") -> DataFrame:
    """Adds the texts before and after, "" at the edges. keys are partition columns."""
    by = Window.partitionBy(*keys).orderBy(order)
    return segments.withColumn("context_before", F.lag(text, 1, "").over(by)).withColumn("context_after", F.lead(text, 1, "").over(by))


def extract(chapters: DataFrame, chapter: str = "chapter_id", text: str = "text", by_line: bool = True) -> DataFrame:
    """First pass over cleaned chapters: segments with ids, neighbours and whether they look like speech.

    Neighbours come from the row's own array: no window and so no shuffle.
    """
    parts = T.line_paragraphs(F.col(text)) if by_line else T.paragraphs(F.col(text))
    rows = chapters.select(chapter, parts.alias("__parts")).select(chapter, "__parts", F.posexplode("__parts").alias("pos", "text"))
    at = lambda shift: F.coalesce(F.get("__parts", F.col("pos") + shift), F.lit(""))
    rows = rows.select(chapter, "pos", "text", at(-1).alias("context_before"), at(1).alias("context_after"), T.is_speech_candidate(F.col("text")).alias("is_dialogue_candidate"))
    return with_ids(rows, chapter)


def chunks(text: Column, size: int, overlap: int) -> Column:
    """Pieces of `size` characters that overlap; the last is the first that reaches the end. An empty text is one empty piece."""
    step = max(1, size - max(0, overlap))
    n = F.when(F.length(text) <= size, 1).otherwise(1 + F.ceil((F.length(text) - size) / step)).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(text, i * step + 1, F.lit(size)))


def chunk_name(chapter: Column, index: Column, count: Column) -> Column:
    return F.when(count == 1, chapter).otherwise(F.concat(chapter, F.lit("_c"), index.cast("string")))


def batch_number(position: Column, size: int) -> Column:
    return F.floor(position / size).cast("int") if size > 0 else F.lit(0)


def timed(segments: DataFrame, *keys: str, seconds: str = "seconds", order: str = "pos", block: int = ranks.BLOCK) -> DataFrame:
    """Adds clip_begin and clip_end, running sums of durations in two levels; a null duration takes no time. order is a number."""
    own = F.coalesce(F.col(seconds), F.lit(0.0))
    return ranks.running(segments, *keys, value=seconds, order=order, name="clip_begin", block=block).withColumn("clip_end", F.col("clip_begin") + own)


def clock(seconds: Column) -> Column:
    return F.format_string("%.3fs", seconds)


def long_clock(seconds: Column) -> Column:
    """HH:MM:SS.mmm"""
    ms = F.round(seconds * 1000).cast("long")
    return F.format_string("%02d:%02d:%02d.%03d", F.floor(ms / 3600000), F.pmod(F.floor(ms / 60000), F.lit(60)), F.pmod(F.floor(ms / 1000), F.lit(60)), F.pmod(ms, F.lit(1000)))


def duration_ms(samples: Column, rate: Column) -> Column:
    return F.floor(samples / F.greatest(rate, F.lit(1)) * 1000).cast("long")


def in_range(number: Column, start: int, end: int) -> Column:
    """Inclusive range from 1; an end of 0 or less is open."""
    return (number >= max(1, start)) & (F.lit(end <= 0) | (number <= end))


def numbered(chapters: DataFrame, *order: str) -> DataFrame:
    """Chapters with number 1, 2, ... in an order."""
    return ranks.numbered(chapters, *order)


def renumbered(chapters: DataFrame, book: str, number: str = "number", order: str = "pos") -> DataFrame:
    """A book's chapter numbers, all by position if any of them repeats. Distinct numbers are counted by shuffle, so no book is one task's window."""
    rows = chapters.withColumn("__n", F.col(number))
    seen = rows.groupBy(F.col(book).alias("__book"), "__n").agg(F.count("*").alias("c"))
    clash = seen.groupBy("__book").agg(F.coalesce(F.max((F.col("c") > 1) & F.col("__n").isNotNull()), F.lit(False)).alias("__clash"), F.coalesce(F.max(F.col("__n").isNull()), F.lit(False)).alias("__gap"))
    marked = rows.drop("__n").join(clash, F.col(book).eqNullSafe(F.col("__book"))).withColumn("__clash", F.col("__clash") | F.col("__gap")).drop("__book", "__gap")
    placed = ranks.numbered(marked, order, keys=(book,), name="__place")
    return placed.withColumn(number, F.when(F.col("__clash"), F.col("__place").cast(chapters.schema[number].dataType)).otherwise(F.col(number))).drop("__clash", "__place")


def progress(segments: DataFrame, *keys: str, order: str = "pos") -> DataFrame:
    by = Window.partitionBy(*keys)
    return segments.withColumn("percent", F.floor(F.row_number().over(by.orderBy(order)) * 100 / F.count("*").over(by)).cast("int"))


def next_in(selection: DataFrame, *keys: str, order: str = "number") -> DataFrame:
    return selection.withColumn("next_number", F.lead(order).over(Window.partitionBy(*keys).orderBy(order)))


def with_first_failure(batches: DataFrame, chapter: str, limit: int, failed: str = "failed", order: str = "batch") -> DataFrame:
    """Failures so far, and whether the limit was reached before this batch."""
    so_far = Window.partitionBy(chapter).orderBy(order)
    return batches.withColumn("failures", F.sum(F.col(failed).cast("int")).over(so_far)).withColumn("single_mode", F.coalesce(F.sum(F.col(failed).cast("int")).over(so_far.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) >= limit)


def translator(provider: str, **functions):
    """The Column function of a translation provider, by its name in any case; texts stay as they are where there is none.

    functions are plain text functions by provider, run in batches of rows; what fails or is blank gives null.
    """
    import pandas as pd

    function = {k.lower(): f for k, f in functions.items()}.get((provider or "").strip().lower())
    if function is None:
        return lambda text: text

    def one(value):
        try:
            return function(value) if value and value.strip() else value
        except Exception:  # noqa: BLE001  a piece that can't be translated stays
            return None

    @F.pandas_udf("array<string>")
    def pieces(values: pd.Series) -> pd.Series:
        return values.map(lambda parts: None if parts is None else [one(v) for v in parts])

    return pieces.asNondeterministic()


def translated_by(chapters: DataFrame, provider: str, text: str = "text", limit: int = 4000, piece: int = 2000, **functions) -> DataFrame:
    """Texts by a provider's function; longer ones line by line, or in pieces where they are one line. What fails stays as it was."""
    ask = translator(provider, **functions)
    lined = F.contains(F.col(text), F.lit("\n"))
    cut = F.when(F.length(text) <= limit, F.array(F.col(text))).when(lined, F.split(text, "\n", -1)).otherwise(chunks(F.col(text), piece, 0))
    rows = chapters.withColumn("__cut", cut).withColumn("__new", ask(F.col("__cut")))
    best = F.zip_with("__cut", "__new", lambda old, new: F.coalesce(F.nullif(new, F.lit("")), old))
    glue = F.when((F.length(text) > limit) & lined, F.array_join(best, "\n")).otherwise(F.array_join(best, ""))
    return rows.withColumn(text, glue).drop("__cut", "__new")


def translated(chapters: DataFrame, translate, chapter: str = "chapter_id", text: str = "text", limit: int = 4000, piece: int = 2000) -> DataFrame:
    """Texts by a Column function; longer ones line by line, or in pieces where they are one line. What fails stays as it was."""
    cut = F.when(F.length(text) <= limit, F.array(F.col(text))).when(F.contains(F.col(text), F.lit("\n")), F.split(text, "\n", -1)).otherwise(chunks(F.col(text), piece, 0))
    glue = F.when((F.length(text) > limit) & F.contains(F.col(text), F.lit("\n")), "\n").otherwise("")
    done = F.transform(cut, lambda part: F.coalesce(F.nullif(translate(part), F.lit("")), part))
    return chapters.withColumn(text, F.array_join(F.transform(F.sequence(F.lit(1), F.size(done)), lambda i: F.concat(F.when(i > 1, glue).otherwise(""), F.element_at(done, i))), ""))
