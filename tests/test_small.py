import datetime

import pytest
from pyspark.sql import functions as F

from inkwell.functions import urls as U
from inkwell.operators import characters as C
from inkwell.operators import ledger, requests, review
from inkwell.sources import files, sinks


def test_retrieved_text_is_cleaned_only_if_it_has_markup(spark):
    rows = spark.createDataFrame([(1, "Raws\nTranslate\nA+\nA-\nDark\n a  < b > c "), (2, "Raws\nTranslate\nA+\nDark\n a  b "), (3, None)], "i int, content string")
    got = {r.i: r.text for r in files.retrieved(rows).collect()}
    assert got[2] == "Raws\nTranslate\nA+\nDark\n a  b " and got[3] is None and got[1].endswith("a < b > c") and "  " not in got[1]


def test_text_and_store_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", "one"), ("b", "two\tthree")], "k string, text string")
    sinks.save_text(df, f"file://{tmp_path}/t")
    assert sorted(r.value for r in spark.read.text(f"file://{tmp_path}/t").collect()) == ["one", "two\tthree"]
    for rows in (df, df.where("k = 'b'")):
        sinks.save_store(rows, f"file://{tmp_path}/s")
        assert sorted(map(tuple, spark.read.parquet(f"file://{tmp_path}/s").collect())) == sorted(map(tuple, rows.collect()))


def test_clamped_numbers_and_utc_times(spark):
    values = spark.createDataFrame([(-1.0,), (0.25,), (7.0,)], "v double").select(ledger.clamp(F.col("v")).alias("c"))
    assert [r.c for r in values.collect()] == [0.0, 0.25, 1.0]
    at = spark.createDataFrame([(datetime.datetime(2024, 2, 3, 4, 5, 6, 7),)], "t timestamp").select(ledger.iso_utc(F.col("t")).alias("s")).first().s
    assert at.endswith("Z") and len(at) == 20 and at[10] == "T"


def test_a_project_needs_a_title(spark):
    rows = spark.createDataFrame([(1, " A b "), (2, " \t"), (3, None)], "i int, title string")
    assert review.titled(rows.where("i = 1")).first().title == "A b"
    for i in (2, 3):
        with pytest.raises(Exception, match="needs a title"):
            review.titled(rows.where(f"i = {i}")).collect()


def test_profiles_and_precedence(spark):
    rows = {r.profile: (r.source, r.target, r.keep_honorifics) for r in requests.profiles(spark).collect()}
    assert set(rows) == {"zh_en_webnovel", "ko_en_webnovel", "ja_en_lightnovel"} and all(t == "en" for _, t, _ in rows.values())
    got = spark.createDataFrame([(None, 2, 3), (None, None, 3)], "a int, b int, c int").select(C.first_set(F.col("a"), F.col("b"), F.col("c")).alias("x"))
    assert [r.x for r in got.collect()] == [2, 3]


# The URL standard's examples, for the base http://a/b/c/d;p?q.
JOINED = (("g", "http://a/b/c/g"), ("./g", "http://a/b/c/g"), ("g/", "http://a/b/c/g/"), ("/g", "http://a/g"), ("//g", "http://g"), ("?y", "http://a/b/c/d;p?y"), ("g?y", "http://a/b/c/g?y"), ("#s", "http://a/b/c/d;p?q#s"), ("g#s", "http://a/b/c/g#s"), (";x", "http://a/b/c/;x"), (".", "http://a/b/c/"), ("./", "http://a/b/c/"), ("..", "http://a/b/"), ("../", "http://a/b/"), ("../g", "http://a/b/g"), ("../..", "http://a/"), ("../../g", "http://a/g"), ("../../../g", "http://a/g"), ("./g/.", "http://a/b/c/g/"), ("g/../h", "http://a/b/c/h"), ("g?y/../x", "http://a/b/c/g?y/../x"), ("mailto:x@y", "mailto:x@y"), ("https://z/q", "https://z/q"))


def test_links_are_resolved_as_in_the_standard(spark):
    rows = spark.createDataFrame(list(JOINED), "href string, link string").select("href", "link", U.resolve(F.col("href"), F.lit("http://a/b/c/d;p?q")).alias("got"))
    assert [(r.href, r.got) for r in rows.collect()] == [(h, link) for h, link in JOINED]
