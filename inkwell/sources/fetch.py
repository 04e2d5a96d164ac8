"""Fetching pages: attempts with a delay, headers in turn, a pause for each host, and an error row where all attempts fail."""

import json
import time
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from inkwell.functions import urls as U

#: Systems and versions of the agents that requests name in turn.
SYSTEMS, VERSIONS = ("Windows NT 10.0; Win64; x64", "X11; Linux x86_64", "Macintosh; Intel Mac OS X 10_15_7"), (124, 125)
AGENTS = tuple(f"Mozilla/5.0 ({system}) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/{version}.0.0.0 Safari/537.36" for version in VERSIONS for system in SYSTEMS)
ACCEPT = {"Accept": "text/html,application/xhtml+xml,application/xml;q=0.9,*/*;q=0.8", "Accept-Language": "en-US,en;q=0.9"}
SCHEMA = "url string, status int, attempts int, html string, error string"


class Fetcher:
    """Asks for pages one after another: `attempts` times each with `delay` seconds between, `pause` seconds between an answer of a host and the next request."""

    def __init__(self, attempts: int = 3, delay: float = 1.0, timeout: float = 20.0, pause: float = 0.0, headers: dict | None = None, agents=AGENTS):
        self.attempts, self.delay, self.timeout, self.pause = max(1, attempts), delay, timeout, pause
        self.headers, self.agents, self.asked, self.last = ACCEPT | (headers or {}), agents, 0, {}

    def _wait(self, url: str) -> None:
        from urllib.parse import urlsplit

        host = urlsplit(url).netloc
        left = self.last.get(host, -1e9) + self.pause - time.monotonic()
        if left > 0:
            time.sleep(left)

    def _answered(self, url: str) -> None:
        from urllib.parse import urlsplit

        self.last = {urlsplit(url).netloc: time.monotonic()}  # pages come host by host

    def page(self, url: str | None) -> tuple:
        """(url, status, attempts, html, error); status is the last answer's, if there was one."""
        from urllib.error import HTTPError
        from urllib.request import Request, urlopen

        status, fault = None, "no URL"
        if url:
            for attempt in range(1, self.attempts + 1):
                self._wait(url)
                agent = self.agents[self.asked % len(self.agents)]
                self.asked += 1
                try:
                    with urlopen(Request(url, headers=self.headers | {"User-Agent": agent}), timeout=self.timeout) as reply:
                        return url, reply.status, attempt, reply.read().decode(reply.headers.get_content_charset() or "utf-8", "replace"), None
                except Exception as why:  # noqa: BLE001  one page must not end the job
                    status, fault = why.code if isinstance(why, HTTPError) else status, f"{type(why).__name__}: {why}"
                finally:
                    self._answered(url)
                if attempt < self.attempts:
                    time.sleep(self.delay)
        return url, status, self.attempts if url else 0, None, f"Failed to fetch URL after retries: {url} ({fault})"


def fetched(urls: DataFrame, url: str = "url", keep: tuple[str, ...] = (), lanes: int = 1, **options) -> DataFrame:
    """Columns keep, and url, status, attempts, html and error of each row; options are Fetcher's.

    Rows are dealt by host, so that one task at a time asks a host and can pause; `lanes` tasks where a host bears
    more. A null URL and one that fails have an error and no html. Another run may give other pages: write the result
    once, as a table.
    """
    fields = [urls.schema[k] for k in keep]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), SCHEMA.replace("url string", "`__url` string", 1)])

    def run(batches: Iterator):
        import pyarrow as pa

        asker = Fetcher(**options)
        for batch in batches:
            for i, one in enumerate(batch.column("__url").to_pylist()):  # a page at a time, so that a batch of long ones is not held
                row = asker.page(one)
                values = [pa.array([v], kind) for v, kind in zip(row, (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()))]
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(i, 1) for k in keep), *values], [*keep, "__url", "status", "attempts", "html", "error"])

    host, lane = U.authority(F.col(url)), F.pmod(F.xxhash64(url), F.lit(max(1, lanes)))
    dealt = urls.select(*keep, F.col(url).alias("__url"), F.coalesce(host, F.lit("")).alias("__host"), F.coalesce(lane, F.lit(0)).alias("__lane"))
    dealt = dealt.repartition("__host", "__lane").sortWithinPartitions("__host", "__url").drop("__host", "__lane")
    return dealt.mapInArrow(run, schema).withColumnRenamed("__url", url)


class HostPartition(InputPartition):
    def __init__(self, urls: list[str]):
        super().__init__(urls)


class PageReader(DataSourceReader):
    def __init__(self, options):
        self.urls = json.loads(options["urls"])
        self.options = {name: kind(options[name]) for name, kind in (("attempts", int), ("delay", float), ("timeout", float), ("pause", float), ("headers", json.loads)) if name in options}

    def partitions(self):
        from urllib.parse import urlsplit

        hosts: dict[str, list] = {}
        for url in self.urls:
            hosts.setdefault(urlsplit(url).netloc, []).append(url)
        return [HostPartition(urls) for urls in hosts.values()]

    def read(self, partition):
        asker = Fetcher(**self.options)
        for url in partition.value:
            yield asker.page(url)


class PageSource(DataSource):
    """spark.dataSource.register(PageSource); spark.read.format("inkwell_pages").option("urls", json.dumps([...]))

    For a list that a program holds; each host is a partition. Tables of URLs go through fetched(). Options: attempts,
    delay, timeout, pause, headers (JSON).
    """

    @classmethod
    def name(cls):
        return "inkwell_pages"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return PageReader(self.options)
