"""Views of segments for review: numbered rows, selections, zips of predictions."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions import text as T


def review_rows(segments: DataFrame, *keys: str, order: str = "pos", size: int = 80) -> DataFrame:
    """(keys, row, type, speaker, preview, confidence as a percentage, flag) in order."""
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    percent = F.concat(F.bround(F.coalesce("speaker_confidence", F.lit(0.0)) * 100).cast("int").cast("string"), F.lit("%"))
    return segments.select(*keys, number.alias("row"), "type", "speaker", F.substring("text", 1, size).alias("preview"), percent.alias("confidence"), F.when(F.col("needs_review"), "!").otherwise("").alias("flag"))


def selected(chapters: DataFrame, chosen: DataFrame, key: str) -> DataFrame:
    return chapters.join(chosen.select(key).distinct(), key, "left_semi")


def zipped(originals: DataFrame, predictions: DataFrame, *keys: str, order: str = "pos") -> DataFrame:
    """Originals with the predictions of the same place; what either lacks is cut off."""
    number = lambda df: df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))
    return number(originals).join(number(predictions).drop(order), [*keys, "__n"]).drop("__n")


def titled(projects: DataFrame, title: str = "title") -> DataFrame:
    """Projects; one without a title raises when it is read."""
    fault = F.raise_error(F.lit("a project needs a title")).cast("string")
    return projects.withColumn(title, F.when(T.strip(F.coalesce(title, F.lit(""))) != "", T.strip(F.col(title))).otherwise(fault))


def flattened(files: DataFrame, path: str = "path") -> DataFrame:
    """Audio files by their bare name; of equal names the one whose path sorts last."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    return files.where(F.col(path).endswith(".wav")).groupBy(name.alias("name")).agg(F.max(path).alias("path"))


def totals(chapters: DataFrame, done: DataFrame, *keys: str, chapter: str = "chapter_id") -> DataFrame:
    """(keys, discovered, processed): chapters of the list, and those that a stage has done."""
    marked = chapters.join(done.select(chapter).distinct().withColumn("__done", F.lit(1)), chapter, "left")
    return marked.groupBy(*keys).agg(F.count("*").alias("discovered"), F.count("__done").alias("processed"))


def with_audio(chapters: DataFrame, clips: DataFrame, timing: DataFrame, *keys: str) -> DataFrame:
    """Adds has_audio: a chapter has audio only if it has both a clip and timing."""
    has = lambda df, name: df.select(*keys).distinct().withColumn(name, F.lit(True))
    rows = chapters.join(has(clips, "__w"), list(keys), "left").join(has(timing, "__t"), list(keys), "left")
    return rows.withColumn("has_audio", F.coalesce(F.col("__w") & F.col("__t"), F.lit(False))).drop("__w", "__t")


def timed_paragraphs(paragraphs: DataFrame, timing: DataFrame, *keys: str) -> DataFrame:
    """Paragraphs with clip_begin and clip_end by paragraph_id; those without timing have none and no audio."""
    rows = paragraphs.join(timing.select(*keys, "paragraph_id", "clip_begin", "clip_end"), [*keys, "paragraph_id"], "left")
    return rows.withColumn("has_audio", F.col("clip_begin").isNotNull())
