import io
import json
import zipfile

from pyspark.sql import functions as F

from inkwell.sources import files, sinks
from inkwell.streaming import events


def test_folder_and_text_files(spark, tmp_path):
    for name in ("ch10.txt", "ch2.txt", "note.md", "Part 3.html"):
        (tmp_path / name).write_text(f" {name} ")
    got = files.folder_chapters(spark, f"file://{tmp_path}").orderBy("number").collect()
    assert [r.number for r in got] == [2, 3, 10] and files.folder_chapters(spark, f"file://{tmp_path}", start=3, end=9).count() == 1
    assert {(r.title, r.content) for r in files.text_files(spark, f"file://{tmp_path}/ch2.txt").collect()} == {("ch2", "ch2.txt")}


def test_lists(spark):
    df = spark.sql("SELECT 1 AS b, array('u1', 'paywalled', 'u2') AS urls, array(named_struct('id','i','href','','title','')) AS items")
    df = df.withColumn("urls", files.placeholder_free(F.col("urls")))
    assert [(r.number, r.source) for r in files.url_chapters(df).collect()] == [(1, "u1"), (2, "u2")]
    assert [(r.title, r.source) for r in files.spine_chapters(df).collect()] == [("Chapter 1", "i")]


def test_json_rules_and_glossary(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps([{"pattern": "a", "replacement": "b"}, {"pattern": "c", "replacement": "d", "enabled": False}]))
    (tmp_path / "g.json").write_text(json.dumps([["x", "y"]]))
    assert [r["enabled"] for r in files.load_rules(spark, f"file://{tmp_path}/r.json")] == [True, False]
    assert files.load_glossary(spark, f"file://{tmp_path}/g.json") == {"x": "y"}
    assert files.json_rows(spark, f"file://{tmp_path}/none.json", "a int").count() == 0


def test_epub_round_trip(spark, tmp_path):
    segments = spark.createDataFrame([("b", 1, "One", 0, "p0", "narration", "Hello <world>"), ("b", 1, "One", 1, "p1", "dialogue", '"Hi"'), ("b", 2, "Two", 0, "p0", "narration", "End")], "book_id string, number int, title string, pos int, paragraph_id string, type string, text string")
    pages = sinks.chapter_pages(segments, "book_id", "number")
    chapters = segments.select("book_id", "number", "title").distinct().select("*", F.lit("A & B").alias("book_title"), F.lit("Me").alias("author"), F.concat(F.lit("c"), "number", F.lit(".xhtml")).alias("file"), (F.col("number") == 1).alias("has_audio"))
    package = sinks.packages(chapters)
    timing = spark.createDataFrame([("b", 1, 0, "p0", 0.0, 1.25, "c1.xhtml", "c1.wav")], "book_id string, number int, pos int, paragraph_id string, clip_begin double, clip_end double, page string, audio string")
    smil = sinks.overlays(timing, "book_id", "number")
    assert 'clipEnd="1.250s"' in smil.first().smil and 'clipEnd="00:00:01.250"' in sinks.overlays(timing, "book_id", long=True).first().smil
    named = pages.select("book_id", F.concat(F.lit("c"), "number", F.lit(".xhtml")).alias("name"), F.col("xhtml").alias("content"))
    for part, name in (("opf", "content.opf"), ("ncx", "toc.ncx"), ("nav", "nav.xhtml")):
        named = named.union(package.select("book_id", F.lit(name), part))
    named = named.union(smil.select("book_id", F.concat(F.lit("c"), "number", F.lit(".xhtml.smil")), "smil"))
    content = bytes(sinks.archives(named).first().epub)
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        first = book.infolist()[0]
        assert (first.filename, first.compress_type) == ("mimetype", zipfile.ZIP_STORED)
        assert 'media-overlay="s1"' in book.read("OEBPS/content.opf").decode() and "A &amp; B" in book.read("OEBPS/nav.xhtml").decode()
    (tmp_path / "x.epub").write_bytes(content)
    rows = files.epub_chapters(spark, f"file://{tmp_path}/x.epub").orderBy("pos").collect()
    assert [(r.title, r.content.split("\n")[-1]) for r in rows] == [("One", '"Hi"'), ("Two", "End")]


def test_stage_tables_resume(spark, tmp_path):
    done = spark.createDataFrame([(1, "a"), (2, "b")], "chapter_id int, text string")
    sinks.save_stage(done, f"file://{tmp_path}/s")
    sinks.save_stage(spark.createDataFrame([(2, "new")], "chapter_id int, text string"), f"file://{tmp_path}/s")
    table = spark.read.parquet(f"file://{tmp_path}/s")
    assert {(r.chapter_id, r.text) for r in table.collect()} == {(1, "a"), (2, "new")}
    assert [r.chapter_id for r in sinks.pending(spark.createDataFrame([(2,), (3,)], "chapter_id int"), table).collect()] == [3]


def test_inventory_and_priority(spark):
    df = spark.createDataFrame([("a/ch1.wav",), ("ch02.wav",), ("chx.wav",), ("b.wav",)], "path string")
    assert sorted(r.number for r in files.audio_inventory(df).collect()) == [1, 2]


def test_streams(spark, tmp_path):
    rows = "SELECT CAST(id AS BIGINT) AS event_id, TIMESTAMP'2024-01-01' + make_interval(0,0,0,0,0,CAST(id * 20 AS INT),0) AS ts, id % 3 AS user_id, concat('t', id % 2) AS event_type, CAST((id * 7) % 11 AS DOUBLE) AS value, '{}' AS props FROM range(30)"
    table = spark.sql(rows)
    table.repartition(2).write.parquet(f"file://{tmp_path}/e")
    stream = events.event_stream(spark, f"file://{tmp_path}/e")
    q = events.best_by_key(stream).writeStream.outputMode("update").format("memory").queryName("best").option("checkpointLocation", f"file://{tmp_path}/c1").start()
    q.processAllAvailable()
    q.stop()
    want = {}
    for r in table.collect():
        want[r.user_id] = max(want.get(r.user_id, (-1, -1)), (r.value, r.event_id))
    assert {r.user_id: (r.value, r.event_id) for r in spark.sql("SELECT * FROM best").collect()} == want
    q = events.windowed(stream).writeStream.outputMode("complete").format("memory").queryName("hours").option("checkpointLocation", f"file://{tmp_path}/c2").start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.sql("SELECT * FROM hours").collect()} == {tuple(r) for r in events.windowed(table).collect()}
    events.sessions(table).count()
    (tmp_path / "log").mkdir()
    sinks.append_log(spark.createDataFrame([("c", 1, "q", "a")], "chapter_id string, attempt int, request string, response string"), f"file://{tmp_path}/log")
    q = events.call_log(spark, f"file://{tmp_path}/log").writeStream.format("memory").queryName("calls").option("checkpointLocation", f"file://{tmp_path}/c3").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT * FROM calls").count() == 1
