"""Sources: chapters from text files, folders, URL lists, spines and EPUB archives; JSON stores; audio."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkwell.functions import text as T
from inkwell.operators import ranks
from inkwell.operators import segments as S

CHAPTER_FILES = (".txt", ".html", ".htm")


def _stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[^.]*$", "")


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """(title, content): each file is one chapter, titled by its name without the ending."""
    return spark.read.text(path, wholetext=True).select(_stem(F.url_decode(F.input_file_name())).alias("title"), T.strip(F.col("value")).alias("content"))


def folder_chapters(spark: SparkSession, folder: str, endings: tuple[str, ...] = CHAPTER_FILES, start: int = 1, end: int = 0) -> DataFrame:
    """(number, title, source, source_type) of a folder's files by name; numbers come from names, or from places if they repeat."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder).select("path")
    files = files.where(F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1)).isin(*endings)).select("path", F.lit(1).alias("book"), F.regexp_extract("path", r"([^/]*)$", 1).alias("name"))
    placed = ranks.numbered(files, "name", name="pos", start=0).withColumn("pos", F.col("pos").cast("int"))
    named = placed.withColumn("number", T.file_number(_stem(F.col("path")), F.col("pos")))
    rows = S.renumbered(named, "book").where(S.in_range(F.col("number"), start, end))
    return rows.select("number", _stem(F.col("path")).alias("title"), F.col("path").alias("source"), F.lit("file").alias("source_type"))


def url_chapters(lists: DataFrame, urls: str = "urls", start: int = 1, end: int = 0, keep: tuple[str, ...] = ()) -> DataFrame:
    """A list of URLs as chapters numbered from 1."""
    rows = lists.select(*keep, F.posexplode(urls).alias("pos", "source")).withColumn("number", F.col("pos") + 1)
    return rows.where(S.in_range(F.col("number"), start, end)).select(*keep, "number", F.col("source").alias("title"), "source", F.lit("url").alias("source_type"))


def spine_chapters(lists: DataFrame, items: str = "items", start: int = 1, end: int = 0, keep: tuple[str, ...] = ()) -> DataFrame:
    """Spine items (id, href, title) as chapters; the source is href, else id; the title has a default."""
    rows = lists.select(*keep, F.posexplode(items).alias("pos", "i")).withColumn("number", F.col("pos") + 1)
    given = lambda c: F.nullif(F.coalesce(c, F.lit("")), F.lit(""))
    title = F.coalesce(given(F.col("i.title")), F.concat(F.lit("Chapter "), F.col("number").cast("string")))
    return rows.where(S.in_range(F.col("number"), start, end)).select(*keep, "number", title.alias("title"), F.coalesce(given(F.col("i.href")), F.col("i.id")).alias("source"), F.lit("epub_spine").alias("source_type"))


def placeholder_free(urls: Column, marker: str = "paywalled") -> Column:
    return F.filter(urls, lambda u: ~F.contains(u, F.lit(marker)))


def epub_chapters(spark: SparkSession, path: str) -> DataFrame:
    """(path, pos, title, content) of every document in EPUB archives, in spine order; title is the first heading or the item's name."""
    from inkwell.operators.html_tree import Page

    def read(batches):
        import io
        import posixpath
        import re
        import zipfile

        import pandas as pd

        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                rows = []
                with zipfile.ZipFile(io.BytesIO(content)) as book:
                    package = re.search(r'full-path="([^"]+)"', book.read("META-INF/container.xml").decode())[1]
                    opf = book.read(package).decode()
                    hrefs = {}
                    for item in re.findall(r"<item\b[^>]*>", opf):
                        found = dict(re.findall(r'([\w-]+)="([^"]*)"', item))
                        if "html" in found.get("media-type", "") and "nav" not in found.get("properties", "").split():
                            hrefs[found["id"]] = found["href"]
                    order = [i for i in re.findall(r'<itemref\b[^>]*idref="([^"]+)"', opf) if i in hrefs]
                    for pos, item in enumerate([*order, *(i for i in hrefs if i not in order)]):
                        page = Page(book.read(posixpath.join(posixpath.dirname(package), hrefs[item])).decode("utf-8", "replace"))
                        rows.append((path, pos, page.first_heading() or hrefs[item], page.text("\n")))
                yield pd.DataFrame(rows, columns=["path", "pos", "title", "content"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(read, "path string, pos int, title string, content string")


def pdf_chapters(spark: SparkSession, path: str) -> DataFrame:
    """(path, pos, title, content) with a row for each page; needs pypdf on the executors."""

    def read(batches):
        import io

        import pandas as pd
        from pypdf import PdfReader

        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                pages = PdfReader(io.BytesIO(content)).pages
                yield pd.DataFrame([(path, i, f"Page {i + 1}", p.extract_text() or "") for i, p in enumerate(pages)], columns=["path", "pos", "title", "content"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(read, "path string, pos int, title string, content string")


def retrieved(sources: DataFrame, content: str = "content") -> DataFrame:
    """Text of a retrieved chapter: cleaned only if it holds both < and >."""
    text = F.col(content)
    return sources.withColumn("text", F.when(F.contains(text, F.lit("<")) & F.contains(text, F.lit(">")), T.clean(text)).otherwise(text))


def json_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON files; what is corrupt gives nulls, and files that are not there give no rows."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(place)
    if found is None or not len(found):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def first_json(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """Rows of the first of the files that is there and has any; none if no file has."""
    for path in paths:
        rows = json_rows(spark, path, schema)
        if not rows.isEmpty():
            return rows
    return spark.createDataFrame([], schema)


def chapter_index(spark: SparkSession, root: str, schema: str = "title STRING, source STRING") -> DataFrame:
    """A project's chapters: of chapters.json, else of chapters_raw.json, else of the project's own data."""
    return first_json(spark, [f"{root}/chapters.json", f"{root}/chapters_raw.json", f"{root}/project.json"], schema)


def image_chapters(spark: SparkSession, path: str, read_image) -> DataFrame:
    """(path, pos, title, content): one chapter for each image; read_image(bytes) is an OCR function of the caller's."""

    def read(batches):
        import posixpath

        import pandas as pd

        for batch in batches:
            yield pd.DataFrame([(p, 0, posixpath.splitext(posixpath.basename(p))[0], read_image(bytes(c)) or "") for p, c in zip(batch["path"], batch["content"])], columns=["path", "pos", "title", "content"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(read, "path string, pos int, title string, content string")


def by_priority(*tables: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Rows of the first table that has their key."""
    marked = [t.withColumn("__p", F.lit(i)) for i, t in enumerate(tables)]
    every = marked[0]
    for t in marked[1:]:
        every = every.unionByName(t)
    best = F.min("__p").over(Window.partitionBy(*keys))
    return every.withColumn("__best", best).where("__p = __best").drop("__p", "__best")


def audio_inventory(files: DataFrame, path: str = "path") -> DataFrame:
    """(number, path) of files ch<number>.wav; others are skipped."""
    number = F.expr(f"try_cast(substring(regexp_extract({path}, '([^/]*)[.]wav$', 1), 3) AS INT)")
    return files.where(F.col(path).rlike(r"(^|/)ch[^/]*\.wav$")).select(number.alias("number"), F.col(path)).where("number is not null")


def load_rules(spark: SparkSession, path: str) -> list[dict]:
    """Replacement rules of a JSON file, in order; a small configuration, so it is read on the driver."""
    rows = spark.read.schema("pattern STRING, replacement STRING, is_regex BOOLEAN, enabled BOOLEAN").option("multiLine", True).json(path).collect()
    return [{"pattern": r.pattern, "replacement": r.replacement or "", "is_regex": bool(r.is_regex), "enabled": r.enabled is not False} for r in rows if r.pattern]


def load_glossary(spark: SparkSession, path: str) -> dict[str, str]:
    """Terms of a JSON file, one object or a list of pairs."""
    import json

    found = json.loads("".join(r.value for r in spark.read.text(path, wholetext=True).collect()) or "{}")
    return {str(k): str(v) for k, v in (found.items() if isinstance(found, dict) else found)}


try:
    from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
except ImportError:  # before Spark 4
    DataSource = None

if DataSource is not None:

    def _named(place: str):
        """The function module:name, which options can only give as text."""
        from importlib import import_module

        module, _, name = place.partition(":")
        return getattr(import_module(module), name)

    class ItemReader(DataSourceReader):
        """Reads pages of a JSON array, each a partition, with attempts; the option transform names a function of an item that gives the row's fields."""

        def __init__(self, schema, options):
            self.names, self.options = schema.names, options
            self.transform = _named(options["transform"]) if options.get("transform") else dict

        def partitions(self):
            return [InputPartition(i) for i in range(int(self.options.get("pages", "1")))]

        def read(self, partition):
            import json

            from inkwell.sources.fetch import Fetcher

            url = self.options["url"].replace("{page}", str(partition.value + 1))
            asker = Fetcher(int(self.options.get("attempts", "3")), float(self.options.get("delay", "1")), float(self.options.get("timeout", "30")), headers=json.loads(self.options.get("headers", "{}")))
            _, _, _, text, fault = asker.page(url)
            if fault:
                raise OSError(fault)
            for item in json.loads(text):
                item = self.transform(item)
                yield tuple(None if item.get(n) is None else str(item[n]) for n in self.names)

    class ItemSource(DataSource):
        """spark.dataSource.register(ItemSource); spark.read.format("inkwell_items").option("url", ...)"""

        @classmethod
        def name(cls):
            return "inkwell_items"

        def schema(self):
            return "title string, content string, url string"

        def reader(self, schema):
            return ItemReader(schema, self.options)
