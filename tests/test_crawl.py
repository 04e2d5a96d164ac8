import random
import re

from inkwell.operators import web


def _canonical(url):
    head, _, tail = url.partition("?")
    site, path = re.match(r"(http://[^/]*)(.*)", head).groups()
    return site + (path.rstrip("/") or "/") + (f"?{tail}" if tail else "")


def _walk(pages, start, most):
    """The queue as a loop: pages maps canonical URLs to lists of (url, label)."""
    index = re.sub("/+$", "", re.sub(r"^http://[^/]*|\?.*", "", start))
    chapters, known, seen, queue, n = [], set(), set(), [start], 0
    while queue and (most <= 0 or n < most):
        url = queue.pop(0)
        if _canonical(url) in seen:
            continue
        seen.add(_canonical(url))
        n += 1
        for link, label in pages.get(_canonical(url), []):
            if not link.startswith("http://h/"):
                continue
            path = re.sub(r"^http://[^/]*|\?.*", "", link).lower()
            if re.search(r"[?&]page=\d+", link) or label == "next":
                if _canonical(link) not in seen:
                    queue.append(link)
            elif "chapter" in path or re.search(r"/\d+/?$", path) and path.startswith(index) and path != index + "/":
                if _canonical(link) not in known:
                    known.add(_canonical(link))
                    chapters.append(link)
    return chapters


def _site(rng, n):
    pages = {}
    for i in range(n):
        links = []
        for _ in range(rng.randint(0, 6)):
            kind = rng.randrange(4)
            to = rng.randrange(n + 3)
            slash = rng.choice(["", "/"])
            links.append([(f"http://h/book{slash}?page={to}", "x"), (f"http://h/book/p{to}{slash}", "next"), (f"http://h/book/{rng.randrange(60)}{slash}", "read"), (f"http://h/chapter-{rng.randrange(60)}{slash}", "read")][kind])
        links += [("http://other/chapter-1", "read"), ("http://h/about", "about")]
        pages[rng.choice([f"http://h/book?page={i}", f"http://h/book/p{i}"])] = links
    pages["http://h/book"] = [(f"http://h/book?page={i}", "2") for i in range(0, n, 3)] + [(f"http://h/book/p{i}", "next") for i in range(1, n, 4)]
    return pages


def test_crawl_equals_the_queue(spark):
    for seed, most in ((1, 7), (2, 25), (3, 0)):
        rng = random.Random(seed)
        pages = _site(rng, 40)
        rows = [(url, "".join(f"<a href='{u}'>{t}</a>" for u, t in links)) for url, links in pages.items()]
        got = web.crawl(spark.createDataFrame(rows, "url string, html string"), "http://h/book", most).orderBy("ord").collect()
        assert [r.url for r in got] == _walk(pages, "http://h/book", most) and [r.ord for r in got] == list(range(len(got)))
        assert len(got) > 5


def test_the_driver_gets_no_links(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    sizes = []
    collect = DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda self: sizes.append(len(rows := collect(self))) or rows)
    rows = [("http://h/i", "".join(f"<a href='/chapter-{i}'>c</a>" for i in range(500)))]
    out = web.crawl(spark.createDataFrame(rows, "url string, html string"), "http://h/i")
    assert max(sizes, default=0) <= 1 and out.count() == 500
