import json
import sys
from types import ModuleType

import numpy as np
import pytest

from inkwell.operators import audio, ledger, review, web
from inkwell.operators import segments as S
from inkwell.operators.html_tree import Page
from inkwell.plans import phases
from inkwell.sources import files, sinks
from pyspark.sql import functions as F


def test_a_chain_of_index_pages_is_followed_to_its_end(spark):
    page = lambda i: f'<a href="/book/chapter-{i}">Read</a><a href=\'/book/chapter-{i - 1}/\'>Again</a><a href=/book?page={i + 1}>Next</a><a href="?page=1#top">1</a>'
    rows = [(f"https://h.example/book?page={i}", page(i)) for i in range(20)]
    pages = spark.createDataFrame(rows, "url string, html string")
    out = web.crawl(pages, "https://h.example/book?page=0", max_pages=100).collect()
    want = ["https://h.example/book/chapter-0", "https://h.example/book/chapter--1/"] + [f"https://h.example/book/chapter-{i}" for i in range(1, 20)]
    assert [r.url for r in out] == want
    assert len(web.crawl(pages, "https://h.example/book?page=0", max_pages=5).collect()) == 5
    assert web.crawl(pages, "https://h.example/none").collect() == []


def test_anchors_in_any_quoting(spark):
    html = '<a href="/a">A</a><A class=x HREF=\'/b?x=1&amp;y=2\'>B <b>b</b></A><a title="a > b" href=/c>C</a ><a name=x>no</a>'
    rows = web.anchors(spark.createDataFrame([(1, html)], "page_id long, html string"), "page_id").collect()
    assert [(r.href, r.label) for r in rows] == [("/a", "A"), ("/b?x=1&y=2", "B b"), ("/c", "C")]


def test_selectors_exclusions_and_ordered_hosts(spark):
    html = '<body><h1>T</h1><div class="ad x">Ad</div><div id="c"><p>One</p><p data-k="v">Two</p></div><section><div><p>Three</p></div></section></body>'
    pages = spark.createDataFrame([("https://h.example/1", html)], "url string, html string")
    content = lambda **o: web.chapters(pages, **o).first().content
    assert content(selectors=("#c > p", "section p")) == "One\n\nTwo\n\nThree"
    assert content(selectors=("p[data-k=v]",)) == "Two"
    assert "Ad" not in content(selectors=("body",), exclude=(".ad", "::bad")) and "Ad" in content(selectors=("body",))
    assert content(selectors=(".none",)).startswith("T")
    ordered = '<div><p style="order: 2">b</p><p style="order:1">a</p></div>'
    two = spark.createDataFrame([("https://sub.noveldex.io/1", ordered), ("https://other.example/1", ordered), ("https://h.example/x", None)], "url string, html string")
    got = {r.url: (r.content, r.error) for r in web.chapters(two).collect()}
    assert got["https://sub.noveldex.io/1"] == ("a\n\nb", None) and got["https://other.example/1"][0].startswith("b")
    with pytest.raises(ValueError):
        Page(html).root.select("p::first")


def test_phases_run_in_order_and_stop(spark):
    seen = []
    step = lambda c, i, n: seen.append((c, i, n)) or c != "bad"
    assert phases.run_all([], step) and not seen
    assert phases.run_all(["a", "b"], step, told=lambda i, n: 1 / 0) and seen == [("a", 1, 2), ("b", 2, 2)]
    assert not phases.run_all(["bad", "b"], step) and len(seen) == 3
    assert not phases.run_all(["a", "b"], step, confirm=lambda c, after: (c, after) != ("a", "b"))
    assert not phases.run_all(["a", "b"], step, confirm=lambda c, after: 1 / 0) and phases.run_all(["a", "b"], step, confirm=lambda c, after: False, mode="auto")
    assert not phases.run_all(["a"], step, cancelled=lambda: True)


def test_a_phase_reports_fails_and_cancels(spark):
    rows, told, kept = spark.createDataFrame([("a", 1), ("b", 2)], "chapter_id string, n int"), [], []
    phase = phases.TablePhase(spark, "double", rows, lambda df: df.withColumn("n", F.col("n") * 2), lambda df: kept.append(df.collect()))
    phase.on_progress(told.append)
    assert phase("b").success and [r.n for r in kept[0]] == [4] and told == [0, 100]
    phase.sink = lambda df: 1 / 0
    assert not phase("a").success
    phase.cancel()
    assert phase("a").message == "cancelled" and phase.is_cancelled()
    phase.reset()
    assert not phase.is_cancelled()


def test_characters_evolve_chapter_by_chapter(spark):
    start = spark.createDataFrame([("x",)], "name string")
    out = phases.evolve(start, [1, 2], lambda known, c: spark.createDataFrame([(f"n{c}{known.count()}",)], "name string"), lambda a, b: a.union(b), lambda df, n: df.cache())
    assert sorted(r.name for r in out.collect()) == ["n11", "n22", "x"]


def test_speech_engines_of_any_shape(spark):
    assert audio.as_clip(([[0.1, 0.2]], 8000))[1] == 8000 and audio.as_clip(np.ones((1, 5)))[1] == audio.RATE
    for bad in ([], np.ones((2, 3))):
        with pytest.raises(ValueError):
            audio.as_clip(bad)
    rows = spark.createDataFrame([(1, "hello", "v", 9.0), (2, " ", "v", 1.0), (3, "boom", "v", None)], "k int, text string, voice string, speed double")

    def engine(text, voice, speed):
        if text == "boom":
            raise RuntimeError("no voice")
        return [speed] * 24, 24

    out = {r.k: r for r in audio.spoken(rows, engine, "k").collect()}
    assert out[1].samples[0] == 4.0 and out[1].duration_ms == 1000 and out[2].error == "blank text" and out[3].error == "no voice" and out[3].samples is None


def test_translation_providers(spark):
    rows = spark.createDataFrame([(1, "short"), (2, "line one\nbad\n\nline two"), (3, "x" * 25)], "k int, text string")

    def upper(text):
        if text == "bad":
            raise RuntimeError("refused")
        return text.upper()

    got = {r.k: r.text for r in S.translated_by(rows, " LLM ", limit=10, piece=10, llm=upper).collect()}
    assert got == {1: "SHORT", 2: "LINE ONE\nbad\n\nLINE TWO", 3: "X" * 25}
    assert {r.k: r.text for r in S.translated_by(rows, "none", limit=10, llm=upper).collect()}[1] == "short"


def test_files_are_copied_flat_and_projects_go_with_their_folder(spark, tmp_path):
    for name in ("a/x.wav", "b/x.wav", "b/y.wav", "b/z.txt"):
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_text(name)
    found = spark.createDataFrame([(f"file://{p}",) for p in (tmp_path / "in").rglob("*.*")], "path string")
    assert sinks.copy_flat(review.flattened(found), f"file://{tmp_path}/out") == 2
    assert {p.name: p.read_text() for p in (tmp_path / "out").glob("*.wav")} == {"x.wav": "b/x.wav", "y.wav": "b/y.wav"}
    library = spark.createDataFrame([("in",), ("other",)], "book_id string")
    assert [r.book_id for r in sinks.remove_project(library, "in", f"file://{tmp_path}").collect()] == ["other"]
    assert not (tmp_path / "in").exists() and (tmp_path / "out").exists()
    with pytest.raises(ValueError):
        sinks.remove_project(library, "../x", f"file://{tmp_path}")


def test_chapter_indexes_fall_back_in_turn(spark, tmp_path):
    root = f"file://{tmp_path}"
    assert files.chapter_index(spark, root).collect() == []
    (tmp_path / "project.json").write_text('{"title": "p", "source": "s"}')
    assert files.chapter_index(spark, root).first().title == "p"
    (tmp_path / "chapters_raw.json").write_text('{"title": "raw"}\n')
    (tmp_path / "chapters.json").write_text("")
    assert files.chapter_index(spark, root).first().title == "raw"


def test_items_of_a_json_address_with_a_transform(spark, tmp_path, monkeypatch):
    (tmp_path / "items.json").write_text(json.dumps([{"name": "One", "body": "x"}]))
    module = ModuleType("item_names")
    module.renamed = lambda item: {"title": item["name"], "content": item["body"].upper(), "url": None}
    monkeypatch.setitem(sys.modules, "item_names", module)
    reader = files.ItemReader(spark.createDataFrame([], "title string, content string, url string").schema, {"url": f"file://{tmp_path}/items.json", "transform": "item_names:renamed"})
    assert [row for p in reader.partitions() for row in reader.read(p)] == [("One", "X", None)]


def test_pages_of_a_pdf_and_images(spark, tmp_path, monkeypatch):
    (tmp_path / "a.pdf").write_bytes(b"one|two")
    fake = tmp_path / "lib"
    fake.mkdir()
    (fake / "pypdf.py").write_text("class _P:\n    def __init__(s, t): s.t = t\n    def extract_text(s): return s.t\nclass PdfReader:\n    def __init__(s, f): s.pages = [_P(t.decode()) for t in f.read().split(b'|')]\n")
    spark.sparkContext.addPyFile(str(fake / "pypdf.py"))
    rows = files.pdf_chapters(spark, f"file://{tmp_path}/a.pdf").orderBy("pos").collect()
    assert [(r.title, r.content) for r in rows] == [("Page 1", "one"), ("Page 2", "two")]
    (tmp_path / "scan.png").write_bytes(b"img")
    image = files.image_chapters(spark, f"file://{tmp_path}/scan.png", lambda data: data.decode().upper()).first()
    assert (image.title, image.content) == ("scan", "IMG")


def test_new_ids_differ(spark):
    assert ledger.with_new_ids(spark.range(50)).select("book_id").distinct().count() == 50
