import json
import threading
import time
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from inkwell.operators import web
from inkwell.sources import fetch


class Site(BaseHTTPRequestHandler):
    """/flaky fails twice, /slow answers late, /gone is not there, all else is a page."""

    log: list = []

    def do_GET(self):
        Site.log.append((self.path, self.headers["User-Agent"], time.monotonic()))
        times = sum(path == self.path for path, _, _ in Site.log)
        if self.path.startswith("/slow"):
            time.sleep(1.5)
        status = 503 if self.path.startswith("/flaky") and times <= 2 else 404 if self.path.startswith("/gone") else 200
        body = f"<html><h1>T{self.path}</h1><main><p>Text of {self.path} é</p></main></html>".encode("latin-1")
        try:
            self.send_response(status)
            self.send_header("Content-Type", "text/html; charset=latin-1")
            self.end_headers()
            self.wfile.write(body)
        except OSError:
            pass

    def log_message(self, *_):
        pass


@pytest.fixture(scope="module")
def site():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_pages_attempts_and_error_rows(spark, site):
    Site.log.clear()
    urls = [(1, f"{site}/a"), (2, f"{site}/flaky"), (3, f"{site}/gone"), (4, f"{site}/slow"), (5, "http://127.0.0.1:1/refused"), (6, None), (7, "no url"), (1, f"{site}/a")]
    df = spark.createDataFrame([(*u, 9) for u in urls], "id int, link string, status int")
    rows = fetch.fetched(df, "link", keep=("id",), attempts=3, delay=0.05, timeout=0.5).collect()
    got = {r.id: r for r in rows}
    assert len(rows) == 8 and Counter(r.id for r in rows)[1] == 2
    assert got[1].html.endswith("<p>Text of /a é</p></main></html>") and (got[1].status, got[1].attempts, got[1].error) == (200, 1, None)
    assert (got[2].status, got[2].attempts, got[2].error) == (200, 3, None)
    assert (got[3].status, got[3].attempts, got[3].html) == (404, 3, None) and "404" in got[3].error and f"{site}/gone" in got[3].error
    assert got[4].status is None and got[4].html is None and got[5].error and got[6].attempts == 0 and got[7].error
    asked = Counter(path for path, _, _ in Site.log)
    assert asked == {"/a": 2, "/flaky": 3, "/gone": 3, "/slow": 3}
    agents = [agent for path, agent, _ in Site.log]
    assert set(agents) <= set(fetch.AGENTS) and len(set(agents)) > 2


def test_a_host_is_asked_by_one_task_with_a_pause(spark, site):
    Site.log.clear()
    df = spark.createDataFrame([(f"{site}/p{i}",) for i in range(6)], "url string").repartition(4)
    assert fetch.fetched(df, pause=0.2).where("error IS NULL").count() == 6
    times = [t for _, _, t in Site.log]
    assert len(times) == 6 and min(b - a for a, b in zip(times, times[1:])) > 0.15


def test_chapters_of_fetched_pages_have_error_rows(spark, site):
    df = spark.createDataFrame([(f"{site}/one",), (f"{site}/gone",)], "url string")
    got = {r.url: r for r in web.chapters(fetch.fetched(df, attempts=2, delay=0.01), error="error").collect()}
    assert (got[f"{site}/one"].title, got[f"{site}/one"].error) == ("T/one", None) and got[f"{site}/one"].content.endswith("Text of /one é")
    assert got[f"{site}/gone"].title == "Failed to scrape" and got[f"{site}/gone"].content == "" and "404" in got[f"{site}/gone"].error


def test_source_has_a_partition_for_each_host(spark, site):
    spark.dataSource.register(fetch.PageSource)
    urls = [f"{site}/x", f"{site}/flaky2", "http://127.0.0.1:1/no"]
    df = spark.read.format("inkwell_pages").option("urls", json.dumps(urls)).option("attempts", "3").option("delay", "0.01").load()
    assert df.rdd.getNumPartitions() == 2
    got = {r.url: (r.status, r.error is None) for r in df.collect()}
    assert got == {urls[0]: (200, True), urls[1]: (200, True), urls[2]: (None, False)}
