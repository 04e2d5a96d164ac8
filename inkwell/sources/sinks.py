"""Sinks: stage tables, logs, and packaged books (XHTML, SMIL, OPF, NCX, navigation, EPUB archives, WAV)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions import text as T
from inkwell.operators import segments as S
from inkwell.sources import pieces


def save_stage(df: DataFrame, path: str, partition: str | None = "chapter_id") -> None:
    """One table for each stage; only the partitions that df has are replaced, so a stage can be resumed."""
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    (writer.partitionBy(partition) if partition else writer).parquet(path)


def pending(chapters: DataFrame, done: DataFrame, key: str = "chapter_id") -> DataFrame:
    """Chapters that a stage has not done yet."""
    return chapters.join(done.select(key).distinct(), key, "left_anti")


def save_text(df: DataFrame, path: str, text: str = "text") -> None:
    df.select(F.col(text).alias("value")).write.mode("overwrite").text(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def save_store(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def without_project(library: DataFrame, book_id: str) -> DataFrame:
    return library.where(F.col("book_id") != book_id)


def _hadoop(spark, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def remove_project(library: DataFrame, book_id: str, root: str) -> DataFrame:
    """The library without the project, whose folder below root is deleted too. book_id names one folder, not a path."""
    if not book_id or "/" in book_id or book_id in (".", ".."):
        raise ValueError(f"{book_id!r} is no project")
    place, store = _hadoop(library.sparkSession, f"{root.rstrip('/')}/{book_id}")
    store.delete(place, True)
    return without_project(library, book_id)


def copy_flat(files: DataFrame, folder: str) -> int:
    """Copies files (name, path; see review.flattened) of one book into a folder by their bare names; how many."""
    spark, rows = files.sparkSession, files.orderBy("name").collect()  # one book's audio files
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for row in rows:
        (a, from_store), (b, to_store) = _hadoop(spark, row["path"]), _hadoop(spark, f"{folder.rstrip('/')}/{row['name']}")
        spark.sparkContext._jvm.org.apache.hadoop.fs.FileUtil.copy(from_store, a, to_store, b, False, True, conf)
    return len(rows)


def ordered_join(order: str, line: Column, glue: str = "\n") -> Column:
    """An aggregate: lines of a group in order."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), line.alias("line")))), lambda x: x["line"]), glue)


def _page(title: Column, body: Column, link: str = "") -> Column:
    return F.concat(F.lit('<?xml version="1.0" encoding="utf-8"?>\n<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops">\n<head><title>'), title, F.lit(f"</title>{link}</head>\n<body>\n"), body, F.lit("\n</body>\n</html>"))


def inline_pages(segments: DataFrame, *keys: str, title: str = "title", order: str = "pos") -> DataFrame:
    """(keys, xhtml): a page for each chapter with a plain paragraph for each segment; quotes stay as they are."""
    line = F.concat(F.lit('<p id="'), F.col("paragraph_id"), F.lit('">'), T.escape_markup(F.col("text")), F.lit("</p>"))
    rows = segments.groupBy(*keys, title).agg(ordered_join(order, line).alias("body"))
    name = T.escape_markup(F.col(title))
    return rows.select(*keys, _page(name, F.concat(F.lit("<h1>"), name, F.lit("</h1>\n"), F.col("body"))).alias("xhtml"))


def chapter_pages(segments: DataFrame, *keys: str, title: str = "title", order: str = "pos") -> DataFrame:
    """(keys, xhtml): a page for each chapter, with a paragraph of its type's class for each segment."""
    line = F.concat(F.lit('<p id="'), F.col("paragraph_id"), F.lit('" class="'), F.col("type"), F.lit('">'), T.escape_markup(F.col("text"), quotes=True), F.lit("</p>"))
    rows = segments.groupBy(*keys, title).agg(ordered_join(order, line).alias("body"))
    name = T.escape_markup(F.col(title), quotes=True)
    return rows.select(*keys, _page(name, F.concat(F.lit("<h1>"), name, F.lit("</h1>\n"), F.col("body"))).alias("xhtml"))


def overlays(timing: DataFrame, *keys: str, page: str = "page", audio: str = "audio", order: str = "pos", long: bool = False) -> DataFrame:
    """(keys, smil): a par element for each timed segment, clocks in seconds or as HH:MM:SS.mmm."""
    clock = S.long_clock if long else S.clock
    line = F.concat(F.lit('<par id="par_'), F.col("paragraph_id"), F.lit('"><text src="'), F.col(page), F.lit("#"), F.col("paragraph_id"), F.lit('"/><audio src="'), F.col(audio), F.lit('" clipBegin="'), clock(F.col("clip_begin")), F.lit('" clipEnd="'), clock(F.col("clip_end")), F.lit('"/></par>'))
    head = '<?xml version="1.0" encoding="utf-8"?>\n<smil xmlns="http://www.w3.org/ns/SMIL" version="3.0">\n<body><seq>\n'
    return timing.groupBy(*keys).agg(ordered_join(order, line).alias("b")).select(*keys, F.concat(F.lit(head), F.col("b"), F.lit("\n</seq></body>\n</smil>")).alias("smil"))


def packages(chapters: DataFrame, book: str = "book_id", modified: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """(book, opf, ncx, nav) from chapters (book, number, title, author, book_title, file, has_audio)."""
    at = F.col("number").cast("string")
    name = T.escape_markup(F.col("title"), quotes=True)
    item = F.concat(F.lit('<item id="c'), at, F.lit('" href="'), F.col("file"), F.lit('" media-type="application/xhtml+xml"'), F.when(F.col("has_audio"), F.concat(F.lit(' media-overlay="s'), at, F.lit('"'))).otherwise(""), F.lit("/>"), F.when(F.col("has_audio"), F.concat(F.lit('\n<item id="s'), at, F.lit('" href="'), F.col("file"), F.lit('.smil" media-type="application/smil+xml"/>'))).otherwise(""))
    point = F.concat(F.lit('<navPoint id="n'), at, F.lit('" playOrder="'), at, F.lit('"><navLabel><text>'), name, F.lit('</text></navLabel><content src="'), F.col("file"), F.lit('"/></navPoint>'))
    entry = F.concat(F.lit('<li><a href="'), F.col("file"), F.lit('">'), name, F.lit("</a></li>"))
    rows = chapters.groupBy(book).agg(F.first("book_title").alias("t"), F.first("author").alias("a"), ordered_join("number", item).alias("items"), ordered_join("number", F.concat(F.lit('<itemref idref="c'), at, F.lit('"/>'))).alias("spine"), ordered_join("number", point).alias("points"), ordered_join("number", entry).alias("entries"))
    title, key = T.escape_markup(F.col("t"), quotes=True), F.concat(F.lit("urn:uuid:"), F.sha1(F.col(book).cast("string")))
    opf = F.concat(F.lit('<?xml version="1.0" encoding="utf-8"?>\n<package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="id">\n<metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:identifier id="id">'), key, F.lit("</dc:identifier><dc:title>"), title, F.lit("</dc:title><dc:creator>"), T.escape_markup(F.coalesce("a", F.lit(""))), F.lit(f'</dc:creator><dc:language>en</dc:language><meta property="dcterms:modified">{modified}</meta></metadata>\n<manifest>\n<item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/>\n'), F.col("items"), F.lit("\n</manifest>\n<spine>\n"), F.col("spine"), F.lit("\n</spine>\n</package>"))
    ncx = F.concat(F.lit('<?xml version="1.0" encoding="utf-8"?>\n<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/" version="2005-1"><head><meta name="dtb:uid" content="'), key, F.lit('"/></head><docTitle><text>'), title, F.lit("</text></docTitle>\n<navMap>\n"), F.col("points"), F.lit("\n</navMap></ncx>"))
    nav = _page(title, F.concat(F.lit('<nav epub:type="toc"><ol>\n'), F.col("entries"), F.lit("\n</ol></nav>")))
    return rows.select(book, opf.alias("opf"), ncx.alias("ncx"), nav.alias("nav"))


def archives(files: DataFrame, book: str = "book_id") -> DataFrame:
    """(book, epub) from files (book, name, content), for books that fit into a value; pieces.save writes larger ones."""
    return pieces.joined(pieces.epub_pieces(files, book), book, out="epub")
