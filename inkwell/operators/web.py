"""Pages as tables: links, titles, main content, and a crawl over captured pages."""



from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.functions import text as T
from inkwell.functions import urls as U
from inkwell.operators import ranks
from inkwell.sources import scratch

# A page's anchors, headings and title as regular expressions, for pages without nesting in them.
ANCHOR = r"(?is)<a\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*?\shref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))(?:[^>\"']|\"[^\"]*\"|'[^']*')*>(.*?)</a\s*>"
#: Hosts whose chapters stand in CSS order.
ORDERED_HOSTS = ("noveldex.io",)
FAILED = "Failed to scrape"
TITLES = (r"(?is)<h1\b[^>]*>(.*?)</h1>", r"(?is)<h2\b[^>]*>(.*?)</h2>", r"(?is)<title\b[^>]*>(.*?)</title>", r"(?is)<h3\b[^>]*>(.*?)</h3>")


def anchors(pages: DataFrame, *keep: str, html: str = "html") -> DataFrame:
    """(keep, pos, href, label) for each anchor with a href, however it is quoted, with built-in expressions only."""
    double, single, bare, labels = (F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(i)) for i in (1, 2, 3, 4))
    rows = pages.select(*keep, F.posexplode(F.arrays_zip(double.alias("d"), single.alias("s"), bare.alias("b"), labels.alias("l"))).alias("pos", "a"))
    href = F.concat(F.col("a.d"), F.col("a.s"), F.col("a.b"))  # two of them are empty
    return rows.select(*keep, "pos", F.replace(href, F.lit("&amp;"), F.lit("&")).alias("href"), T.strip(F.regexp_replace(F.col("a.l"), "<[^>]*>", "")).alias("label"))


def classified_links(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", index: str | None = None) -> DataFrame:
    """(key, pos, url, kind) of followable links of a page's own host: chapter, pagination or other.

    Numbered chapters lie below the index page, which is the page itself, or that of the URL `index`.
    """
    return _classified(anchors(pages, key, url, html=html), key, url, index)


def _classified(rows: DataFrame, key: str, url: str, index: str | None) -> DataFrame:
    rows = rows.where(U.is_followable(F.col("href")))
    rows = rows.withColumn("link", U.resolve(F.col("href"), F.col(url))).where(U.authority(F.col("link")) == U.authority(F.col(url)))
    index = F.regexp_replace(U.path(F.col(url) if index is None else F.lit(index)), "/+$", "")
    return rows.select(key, "pos", F.col("link").alias("url"), U.link_kind(F.col("link"), F.col("label"), index).alias("kind"))


def title(html, default: str = "Chapter"):
    """The first h1, h2, title or h3 of 1 to 199 characters, markup removed."""
    found = [T.strip(F.regexp_replace(F.regexp_extract(html, p, 1), "<[^>]*>", "")) for p in TITLES]
    return F.coalesce(*(F.when(F.length(t).between(1, 199), t) for t in found), F.lit(default))


def chapters(pages: DataFrame, url: str = "url", html: str = "html", error: str | None = None, selectors: tuple[str, ...] = (), exclude: tuple[str, ...] = (), ordered_hosts: tuple[str, ...] = ORDERED_HOSTS) -> DataFrame:
    """(url, title, content, error): a page's cleaned content.

    What `exclude` names is taken out first. Pages of the ordered hosts and their subdomains give their paragraphs in
    CSS order; others what the selectors name, else the main content, else the body's text. A page that can't be read
    has an error, and so has one whose column `error` says why it could not be fetched; the rest goes on.
    """

    def read(batches):
        from urllib.parse import urlsplit

        import pandas as pd

        from inkwell.operators.html_tree import Page

        for batch in batches:
            rows = []
            for url, page, fault in zip(batch["url"], batch["html"], batch["error"]):
                if fault is not None:
                    rows.append((FAILED, "", fault))
                    continue
                try:
                    tree = Page(page)
                    tree.remove(*exclude)
                    host = urlsplit(url or "").netloc
                    ordered = any(host == h or host.endswith(f".{h}") for h in ordered_hosts)
                    content = "\n\n".join(t for _, _, t in tree.ordered_content()) if ordered else tree.content(*selectors)
                    rows.append((tree.title(), content, None))
                except Exception as fault:  # noqa: BLE001  one page must not end the batch
                    rows.append((FAILED, "", str(fault)))
            yield pd.concat([batch[["url"]].reset_index(drop=True), pd.DataFrame(rows, columns=["title", "content", "error"])], axis=1)

    fault = F.col(error) if error else F.lit(None).cast("string")
    rows = pages.select(F.col(url).alias("url"), F.col(html).alias("html"), fault.alias("error")).mapInPandas(read, "url string, title string, content string, error string")
    return rows.withColumn("content", T.clean(F.col("content")))


def ordered_text(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, pos, text) of paragraphs by CSS order, then by place."""
    import pandas as pd

    @F.pandas_udf("array<struct<ord:int,place:int,text:string>>")
    def parts(pages: pd.Series) -> pd.Series:
        from inkwell.operators.html_tree import Page

        return pages.map(lambda p: [{"ord": o, "place": i, "text": t} for o, i, t in Page(p).ordered_content()])

    return pages.select(key, F.posexplode(F.array_sort(parts(html))).alias("pos", "p")).select(key, "pos", "p.text")


def crawl(pages: DataFrame, start: str, max_pages: int = 50) -> DataFrame:
    """(url, level, ord): chapter URLs that are found from a start page over captured pages (url, html), first in, first out.

    The frontier and what was seen are tables. A level's pages are visited in the order of their ranks, so a link's
    place in the queue is (rank of its page, place in the page); of equal canonical URLs the first counts. The anchors of
    all captured pages are read once. Each level joins its frontier with them, takes out what was seen before by an anti join, sorts what is left and
    writes it. Only counts come to the driver. Pages that are not captured count towards max_pages, which is the
    feature's own cap; 0 or less is no cap. A page that was captured more than once counts once.
    """
    spark = pages.sparkSession
    captured = pages.select(U.canonical(F.col("url")).alias("c"), "html").groupBy("c").agg(F.min("html").alias("html"))
    read = scratch.write(anchors(captured, "c"))
    captured = spark.read.parquet(read)
    canonical = U.canonical(F.col("url")).alias("c")
    first = spark.createDataFrame([(start,)], "url string").select(canonical, "url", F.lit(0).cast("long").alias("rank"), U.index_is_chapter(F.col("url")).alias("is_chapter"))
    links = [scratch.write(first.where("is_chapter").select("c", "url", F.lit(-1).alias("level"), "rank", F.lit(0).alias("pos"), F.lit("chapter").alias("kind")))]
    seen, visited, count = [scratch.write(first.drop("is_chapter"))], 0, 1
    while count and (max_pages <= 0 or visited < max_pages):
        frontier, visited = spark.read.parquet(seen[-1]), visited + count
        kept = _classified(frontier.join(captured, "c").withColumnsRenamed({"rank": "page_id", "url": "page"}), "page_id", "page", start).where("kind <> 'other'")
        links.append(scratch.write(kept.select(canonical, "url", F.lit(len(links)).alias("level"), F.col("page_id").alias("rank"), "pos", "kind")))
        queued = spark.read.parquet(links[-1]).where("kind = 'pagination'").groupBy("c").agg(F.min(F.struct("rank", "pos", "url")).alias("m"))
        queued = queued.join(spark.read.parquet(*seen).select("c"), "c", "left_anti").select("c", "m.url", F.col("m.rank").alias("__r"), F.col("m.pos").alias("__p"))
        # Rows sorted by ranges get growing numbers with gaps, which keep the order.
        dealt = queued.repartitionByRange("__r", "__p").sortWithinPartitions("__r", "__p")
        seen.append(scratch.write(dealt.select("c", "url", F.monotonically_increasing_id().alias("rank"))))
        count = spark.read.parquet(seen[-1]).count()
        if max_pages > 0 and visited + count > max_pages and visited < max_pages:
            rest = scratch.write(spark.read.parquet(seen[-1]).orderBy("rank").limit(max_pages - visited))
            scratch.discard(spark, seen.pop())
            seen.append(rest)
            count = max_pages - visited
    every = spark.read.parquet(*links).where("kind = 'chapter'").groupBy("c").agg(F.min(F.struct("level", "rank", "pos", "url")).alias("m")).select("m.*")
    out = scratch.write(ranks.numbered(every, "level", "rank", "pos", name="ord", start=0).select("url", "level", "ord"))
    scratch.discard(spark, read, *links, *seen)
    return spark.read.parquet(out).orderBy("ord")
