import json

import pytest
from pyspark.sql import functions as F

from inkwell.functions import model_json as J
from inkwell.functions import urls as U
from inkwell.operators import audio, classify, ledger, web
from inkwell.operators import characters as C
from inkwell.operators import fuzzy, names
from inkwell.operators import segments as S
from inkwell.operators.html_tree import Page

ITEM = {"id": "a", "type": "dialogue", "speaker": "X", "gender": "male", "speaker_confidence": 0.5, "gender_confidence": "0.25", "character_confidence": 1}


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("v")).first().v


@pytest.mark.parametrize("raw,want", [
    (json.dumps([ITEM]), None), ("```json\n" + json.dumps([ITEM]) + "\n```", None), ("Sure: " + json.dumps([ITEM])[:-1] + ",] bye", None), (json.dumps(ITEM), None),
    (json.dumps({"response": json.dumps([ITEM])}), None), (json.dumps({"segments": [ITEM]}), None), ("", "Top-level must be an array"), (None, "Top-level must be an array"),
    (json.dumps([ITEM, ITEM]), "Duplicate ids in response"), (json.dumps([{**ITEM, "id": "b"}]), "ID mismatch: missing a; extra b"), (json.dumps([{**ITEM, "type": "song"}]), "Item 0 has invalid type: song"),
    (json.dumps([{k: v for k, v in ITEM.items() if k != "gender"}]), "Item 0 lacks gender"), (json.dumps([{**ITEM, "speaker_confidence": 2}]), "Item 0 speaker_confidence is out of range"), (json.dumps([{**ITEM, "gender_confidence": "x"}]), "Item 0 gender_confidence is not a number"),
])
def test_contract(spark, raw, want):
    assert one(spark, lambda t: J.error(t, F.array(F.lit("a"))), raw) == want


def test_sanitized_and_last_of_an_id(spark):
    bad = {"id": " a ", "type": "SONG", "speaker": " ", "gender": "robot", "speaker_confidence": "x"}
    got = one(spark, lambda t: F.transform(J.items(t), J.sanitized), json.dumps([bad]))[0]
    assert tuple(got) == ("a", "narration", "narrator", "unknown", 0.0, 0.0, 0.0)
    assert one(spark, lambda t: J.by_id(J.items(t)), json.dumps([{**ITEM, "speaker": "1"}, {**ITEM, "speaker": "2"}, {"id": ""}]))["a"].speaker == "2"


def test_candidate(spark):
    check = lambda raw: one(spark, lambda t: J.candidate(t, F.lit("p1"), F.lit('"Hi" he said'), F.lit("c0")), raw)
    good = check('{"id": "p1", "type": "dialogue", "speaker": "Bob."}')
    assert (good.error, good.speaker, good.delimiter_type, good.is_dialogue, good.confidence, good.chunk_id, good.text) == (None, "Bob", "double_quotes", True, 1.0, "c0", '"Hi" he said')
    assert check('{"id": "p2"}').error == "id mismatch"
    assert check('{"id": "p1", "span_start": 4, "span_end": 2}').error == "span_end must not be before span_start"
    assert check('{"id": "p1", "confidence": 3}').error == "confidence must be within [0, 1]"
    assert check("[]").error is not None


def test_characters_of_a_payload_and_weak_extraction(spark):
    rows = one(spark, J.character_rows, '{"name": " Ann ", "gender": "FEMALE", "confidence": "0.5"}')
    assert [tuple(r) for r in rows] == [("Ann", "female", 0.5)]
    assert one(spark, lambda t: J.weak_extraction(F.lit(0), t), "Ann met Bob") is True
    assert one(spark, lambda t: J.weak_extraction(F.lit(1), t), "You met The Bob") is False


def test_segments_chunks_and_ids(spark):
    df = spark.createDataFrame([(7, "a\n\nBob: b\nc")], "chapter_id long, text string")
    rows = S.extract(df).orderBy("pos").collect()
    assert [(r.segment_id, r.paragraph_id, r.context_before, r.context_after, r.is_dialogue_candidate) for r in rows] == [("7_s000", "7_p000", "", "Bob: b", False), ("7_s001", "7_p001", "a", "c", True), ("7_s002", "7_p002", "Bob: b", "", False)]
    assert one(spark, lambda t: S.chunks(t, 4, 1), "abcdefgh") == ["abcd", "defg", "gh"]
    assert one(spark, lambda t: S.chunks(t, 4, 9), "") == [""]
    upper = S.translated(spark.createDataFrame([(1, "ab\ncd" * 900), (2, "x"), (3, "y" * 4100)], "chapter_id int, text string"), F.upper)
    assert {r.chapter_id: r.text for r in upper.collect()} == {1: "AB\nCD" * 900, 2: "X", 3: "Y" * 4100}


def test_timing(spark):
    df = spark.createDataFrame([("c", 0, 1.5), ("c", 1, None), ("c", 2, 2.0)], "ch string, pos int, seconds double")
    assert [(r.clip_begin, r.clip_end) for r in S.timed(df, "ch").orderBy("pos").collect()] == [(0.0, 1.5), (1.5, 1.5), (1.5, 3.5)]
    assert one(spark, lambda t: S.long_clock(t.cast("double")), "3661.25") == "01:01:01.250"


def test_resolution_ladder(spark):
    people = spark.createDataFrame([("Dr. Watson", ["John"], "v1", 0), ("Sherlock Holmes", ["Holmes"], "v2", 1)], "name string, aliases array<string>, voice string, pos int")
    said = spark.createDataFrame([(i, s) for i, s in enumerate(["dr watson", "HOLMES,", "Sherlok Holmes", "Moriarty", "", None])], "i int, speaker string")
    got = {r.i: (r.character, r.how, r.voice_of) for r in C.resolved(said, people).collect()}
    assert got == {0: ("Dr. Watson", "exact", "v1"), 1: ("Sherlock Holmes", "alias", "v2"), 2: ("Sherlock Holmes", "fuzzy", "v2"), 3: (None, None, None), 4: (None, None, None), 5: (None, None, None)}


def test_fuzzy_ratio_is_that_of_the_standard_library(spark):
    from difflib import get_close_matches

    keys = ["anna bell", "annabel", "bob stone", "bob stones", "carla", "carlo"]
    asked = ["anna bel", "annabell", "bob stonne", "carli", "karl", "zzz"]
    got = {r.k: r.name for r in fuzzy.closest(spark.createDataFrame([(a,) for a in asked], "k string"), spark.createDataFrame([(k, k) for k in keys], "c string, name string"), 0.85).collect()}
    assert got == {a: m[0] for a in asked if (m := get_close_matches(a, keys, 1, 0.85))}


def test_merge_registry_and_pairs(spark):
    rows = [(0, "Bob.", "unknown"), (1, "bob", "male"), (2, "Narrator", "male"), (3, "BOB", "female"), (4, "Ann", "unknown"), (5, " ", "male")]
    df = spark.createDataFrame([("c", *r) for r in rows], "ch string, pos int, speaker string, gender string")
    assert {r.key: (r.name, r.aliases, r.gender) for r in C.merged(df, "ch").collect()} == {"bob": ("Bob.", ["bob", "BOB"], "male"), "ann": ("Ann", [], "unknown")}
    assert {r.key: r.character_id for r in C.registry(df, "ch").collect()} == {"bob.": "char_1", "bob": "char_2", "narrator": "char_3", "ann": "char_4"}
    both = spark.sql("SELECT named_struct('name','A','gender','unknown','voice','','aliases',array('x'),'description','') AS a, named_struct('name','B','gender','male','voice','v','aliases',array('b','x'),'description','d') AS b")
    assert tuple(both.select(C.merge_pair(F.col("a"), F.col("b")).alias("m")).first().m) == ("A", "male", "v", ["A", "B", "b", "x"], "d")


def test_pronouns_genders_and_names(spark):
    df = spark.createDataFrame([(1, 0, "He gave her the book"), (1, 1, "She saw him")], "doc_id int, pos int, sentence string")
    counts = {(r.pronoun, r.category): r.n for r in C.pronoun_rows(df, "doc_id").groupBy("pronoun", "category").agg(F.count("*").alias("n")).collect()}
    assert counts == {("he", "subject"): 1, ("her", "object"): 1, ("her", "possessive"): 1, ("she", "subject"): 1, ("him", "object"): 1}
    assert one(spark, lambda t: C.preferred_pronouns(t), "female")["reflexive"] == "herself"
    text = spark.createDataFrame([(1, "Captain Ahab sailed to Boston. Ishmael met Ahab. He saw Ishmael, Ahab and Queequeg. Rose knight fell")], "doc_id int, text string")
    assert [(r.name, r.n) for r in names.name_candidates(text).orderBy("rank").collect()] == [("Ahab", 3), ("Ishmael", 2), ("Captain Ahab", 1), ("Queequeg", 1)]


def test_back_references(spark):
    rows = [(1, i, s) for i, s in enumerate(["Ann came", "She sat", "nothing", "nothing", "nothing", "He left"])]
    got = C.back_references(spark.createDataFrame(rows, "doc_id int, pos int, sentence string"), F.array(F.lit("Ann"))).orderBy("pos").collect()
    assert [r.referent for r in got] == ["Ann", "Ann", None, None, None, None]


def test_voices_and_overrides(spark):
    args = lambda *a: C.route_voice(*(F.lit(x) for x in a), "nar", "m", "f")
    row = spark.range(1).select(args(" own ", "thought", "X", "male", "c").alias("a"), args("", "thought", "X", "male", "c").alias("b"), args(None, "dialogue", "X", "male", "c").alias("c"), args(None, "dialogue", "X", "Female", "").alias("d"), args(None, "dialogue", " unknown ", "male", "c").alias("e"), args(None, "dialogue", "X", None, None).alias("f")).first()
    assert tuple(row) == ("own", "nar", "c", "f", "nar", "nar")
    segments = spark.createDataFrame([("s1", "a", 1), ("s2", "b", 2)], "segment_id string, speaker string, n int")
    fixes = spark.createDataFrame([("s2", None, "new")], "segment_id string, speaker string, extra string")
    assert sorted(map(tuple, C.overridden(segments, fixes).collect())) == [("s1", "a", 1, None), ("s2", None, 2, "new")]


def test_model_batches_fall_back_and_switch_to_single(spark):
    df = S.extract(spark.createDataFrame([(1, '"a"\nb\nc\nd\ne')], "chapter_id long, text string"))
    rows = classify.classified(df, size=2).orderBy("pos").collect()
    assert [r.type for r in rows] == ["dialogue"] + ["narration"] * 4 and {r.llm_status for r in rows} == {"ok"}

    def broken(prompt):
        if len(json.loads(prompt)) > 1:
            raise ValueError
        return classify.heuristic_reply(prompt)

    got = classify.classified(df, broken, size=2, limit=1, attempts=2).orderBy("pos").collect()
    assert [(r.batch_size, r.llm_status) for r in got] == [(2, "fallback"), (2, "fallback"), (1, "ok"), (1, "ok"), (1, "ok")]


def test_urls(spark):
    assert one(spark, U.canonical, "https://h:8/a//?q=1#f") == "https://h:8/a?q=1#f"
    assert one(spark, U.canonical, "http://h") == "http://h/"
    assert one(spark, U.registrable, "https://a.b.Example.com:80/x") == "example.com"
    to = lambda href: one(spark, lambda t: U.resolve(t, F.lit("https://h.x/a/b?q")), href)
    assert [to("//o/p"), to("/p"), to("c"), to("http://z"), to("?p=2")] == ["https://o/p", "https://h.x/p", "https://h.x/a/c", "http://z", "https://h.x/a/b?p=2"]
    assert one(spark, U.index_is_chapter, "http://h/chapters/1") and not one(spark, U.index_is_chapter, "http://h/novel/1")


def test_pages():
    html = "<html><head><title>T</title></head><body><nav>menu</nav><div id=a><p>" + "words " * 30 + "</p><p>" + "more " * 30 + "</p><div class=ads-x>buy</div></div><div style='order: 2'><p>z</p></div></body></html>"
    page = Page(html)
    assert page.title() == "T" and page.main_content() == ("words " * 30).strip() + "\n\n" + ("more " * 30).strip()
    assert [r[0] for r in page.ordered_content()] == [0, 0, 2]
    assert Page("<article>" + "x" * 60 + "</article>").main_content() == "x" * 60
    assert Page("<p>short").main_content() is None and Page("").title() == "Chapter"


def test_crawl(spark):
    pages = [("http://h/n", '<a href="/n/1">One</a><a href="/n?page=2">2</a><a href="http://other/n/9">x</a><a href="#top">t</a>'), ("http://h/n?page=2", '<a href="/n/1/">again</a><a href="/chapter-7">Seven</a><a href="/n">next</a>')]
    got = web.crawl(spark.createDataFrame(pages, "url string, html string"), "http://h/n").collect()
    assert [r.url for r in got] == ["http://h/n/1", "http://h/chapter-7"]


def test_ledger(spark):
    rows = spark.createDataFrame([(1, '{"a": {"b": 1, "c": [1]}, "d": 2}', '{"a": {"b": 2, "c": [1]}}')], "i int, l string, r string")
    assert sorted((r.path, r.a, r.b) for r in ledger.json_differences(rows, "i", left="l", right="r").collect()) == [("a.b", "1", "2"), ("d", "2", "<missing>")]
    assert one(spark, lambda t: ledger.as_bool(t, False), "Yes") is True and one(spark, lambda t: ledger.as_int(t, 7), "x") == 7
    models = spark.createDataFrame([("Llama:8b",)], "name string")
    assert ledger.installed(spark.createDataFrame([("llama",), ("other",)], "name string"), models).collect()[0].name == "llama"
    assert one(spark, ledger.not_retryable, "Model NOT installed") is True


def test_audio(spark, tmp_path):
    (tmp_path / "x.wav").write_bytes(audio.wav_bytes([0.0] * 10 + [0.5] * 10 + [0.0] * 10, 100))
    clip = audio.wav_files(spark, f"file://{tmp_path}/x.wav")
    row = clip.select("rate", "duration_ms", F.size(audio.trimmed(F.col("samples"), F.col("rate"), -20.0, 20)).alias("n"), F.round(audio.peak(F.col("samples")), 2).alias("p")).first()
    assert tuple(row) == (100, 300, 14, 0.5)
    clips = spark.createDataFrame([("c", 1, [0.2], 8), ("c", 0, [0.1], 8)], "ch string, pos int, samples array<float>, rate int")
    assert [round(x, 1) for x in audio.concatenated(clips, "ch").first().samples] == [0.1, 0.2]
    with pytest.raises(Exception, match="differ"):
        audio.concatenated(clips.withColumn("rate", F.col("pos")), "ch").collect()
    assert one(spark, lambda t: audio.viewed(F.array(*map(F.lit, range(10))), F.lit(5.0), F.lit(1.0)), "") == [8, 9]
