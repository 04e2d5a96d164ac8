import pytest
from pyspark.sql import functions as F

from inkwell.functions import text as T


def value(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("v")).first().v


CASES = [
    (T.remove_zero_width, "a​b﻿c᠎", "abc"),
    (T.strip, "\t a \n", "a"),
    (T.normalize_whitespace, "a  b \n\n\n c\n \n \nd ", "a b\n\nc\n\n\nd"),
    (T.remove_reader_controls, "Raws\nstory\nTranslate\nText\n A+ ", "story"),
    (T.remove_reader_controls, "Raws\nstory\nTranslate\nText", "Raws\nstory\nTranslate\nText"),
    (T.remove_site_navigation, "← Back\nChapter 487\nChapter 487: A title\nback to novel\nreader mode x\nkeep", "Chapter 487: A title\nkeep"),
    (T.clean, None, None),
    (T.clean, "", ""),
    (T.remove_ui_lines, "x\n Next Chapter \ny\nSUBSCRIBE NOW", "x\ny"),
    (T.paragraphs, "a\nb\n\n\n c \n\n", ["a\nb", "c"]),
    (T.line_paragraphs, "a\n \n b\n\n", ["a", "b"]),
    (T.sentences, "One. Two!? three ... ", ["One", "Two", "three"]),
    (T.is_speech_candidate, "“Hi” ", True),
    (T.is_speech_candidate, "Bob: hi", True),
    (T.is_speech_candidate, "He left.", False),
    (T.is_quoted_line, " 「x」", True),
    (T.is_quoted_line, "x\"", False),
    (lambda t: T.thought_or(F.lit("narration"), t), " *hm* ", "thought"),
    (T.heuristic_type, " 'x\" ", "dialogue"),
    (T.heuristic_type, "", "narration"),
    (T.delimiter_type, "don't [x] (y)", "square_brackets"),
    (T.delimiter_type, "he said 'x' now", "single_quotes"),
    (T.delimiter_type, "none", "none"),
    (T.delimited_only, "(b) then \"a [c] d\" <e> ' '", "b\na [c] d\nc\ne"),
    (T.name_key, " Dr.  Who,  Jr ", "dr who jr"),
    (T.squeezed_key, " A \t B ", "a b"),
    (lambda t: T.speaker(t, F.lit("dialogue")), "Bob . , !", "Bob"),
    (lambda t: T.speaker(t, F.lit("narration")), " ?! ", "narrator"),
    (lambda t: T.speaker(t, F.lit("dialogue")), None, "unknown"),
    (lambda t: T.speaker(t, F.lit("dialogue")), "NARRATOR:", "narrator"),
    (T.segment_type, " Thought ", "thought"),
    (T.segment_type, "song", "narration"),
    (T.structured_type, "System", "system"),
    (T.gender, "FEMALE", "female"),
    (T.gender, None, "unknown"),
    (lambda t: T.escape_markup(t, True), "<a & 'b'>", "&lt;a &amp; &#x27;b&#x27;&gt;"),
    (T.slug, " Élan Vital! 2 ", "élan-vital-2"),
    (T.slug, "!!!", "book"),
    (T.safe_filename, ' a/b:"c"? ', "abc"),
    (T.wav_filename, "../x/my file.mp3", "my_file.mp3.wav"),
    (T.preview, "x" * 501, "x" * 500 + "…"),
    (lambda t: T.file_number(t, F.lit(4)), "ch010", 10),
    (lambda t: T.file_number(t, F.lit(4)), "Part-7 end", 7),
    (lambda t: T.file_number(t, F.lit(4)), "03 intro", 3),
    (lambda t: T.file_number(t, F.lit(4)), "plain", 5),
    (T.normalize, "&amp;‘q’… é\n\n\n\nz ", "&'q'... é\n\nz"),
    (T.normalize, None, None),
]


@pytest.mark.parametrize("column,text,want", CASES)
def test_function(spark, column, text, want):
    assert value(spark, column, text) == want


def test_fragments_keep_order_overlaps_and_switches(spark):
    text = 'x "a (b) c" (b) [ ] <q>'
    assert [(f.at, f.fragment) for f in value(spark, T.fragments, text)] == [(2, "a (b) c"), (5, "b"), (12, "b"), (20, "q")]
    assert [f.fragment for f in value(spark, lambda t: T.fragments(t, ("angle_brackets",)), text)] == ["q"]
    assert value(spark, lambda t: T.fragments(t, ()), text) == []


def test_rules(spark):
    rules = [{"pattern": "a.c", "replacement": "X"}, {"pattern": r"(\d)b", "replacement": r"<\1$>", "is_regex": True}, {"pattern": "(", "replacement": "", "is_regex": True}, {"pattern": "off", "replacement": "on", "enabled": False}]
    assert value(spark, lambda t: T.apply_rules(t, rules, {"z": "Z"}), "a.c abc 1b off z") == "X abc <1$> off Z"
    assert value(spark, lambda t: T.apply_rules(t, rules[:2], case_sensitive=False), "A.C aBc 1B") == "X aBc <1$>"
