"""All queries over the library's own operators, with the SQL that each must equal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from inkwell.functions import model_json as J
from inkwell.functions import text as T
from inkwell.functions import urls as U
from inkwell.operators import characters as C
from inkwell.operators import classify, dialogue, ledger, requests, review, web
from inkwell.operators import names as N
from inkwell.operators import segments as S
from inkwell.plans.inputs import DECORATED, LINE_KIND, SPEAKER
from inkwell.sources import files, sinks
from inkwell.streaming import events as E

QUERIES: dict = {}
ORACLE_SQL: dict = {}

# The checking SQL's own versions of what the functions do, for splicing into the queries below.
WS = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
LINES = "string_split({}, chr(10))"
PAR = f"""list_filter(list_transform(string_split_regex({{}}, '\\n\\s*\\n|\\n'), lambda p: {WS.format('p')}), lambda p: p <> '')"""
ZERO = "translate({}, '​‌‍﻿⁠᠎', '')"
NAV = f"list_filter({LINES}, lambda x: NOT (regexp_matches({WS.format('x')}, '^[←→↑↓‹›«»]\\s') OR regexp_matches({WS.format('x')}, '(?i)\\bback to novel\\b') OR regexp_matches({WS.format('x')}, '(?i)^reader mode\\b') OR regexp_matches({WS.format('x')}, '(?i)^chapter\\s+\\d+\\s*$')))"
CONTROL = "regexp_replace(" + WS.format("lower({})") + r", '\s+', ' ', 'g') IN (" + ", ".join(f"'{w}'" for w in T.CONTROL_WORDS) + ")"


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def decorated(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", *columns, F.expr(DECORATED).alias("text"))


def decorated_lines(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return S.explode_parts(table(spark, sf_dir, "documents").select("doc_id", *columns, "text"), T.line_paragraphs(F.col("text")), "doc_id", "line").withColumn("line", F.expr(LINE_KIND))


D_SQL = f"SELECT doc_id, {DECORATED} AS text FROM documents"
L_SQL = f"SELECT doc_id, pos, {LINE_KIND} AS line FROM (SELECT doc_id, unnest(parts) AS line, CAST(generate_subscripts(parts, 1) - 1 AS INTEGER) AS pos FROM (SELECT doc_id, {PAR.format('text')} AS parts FROM documents))"


@query("segment_counts", f"""
WITH p AS (SELECT lang, unnest({PAR.format('text')}) AS t FROM documents),
k AS (SELECT lang, (regexp_matches(t, '^["“''](.|\\n)*["”'']$') AND length(t) > 0) OR t IN ('"', '“', '''') AS d, length(t) AS n FROM p)
SELECT lang, count(*) AS segments, count(*) FILTER (d) AS dialogue, count(*) - count(*) FILTER (d) AS narration, CAST(sum(n) AS BIGINT) AS chars FROM k GROUP BY lang""")
def segment_counts(spark, sf_dir):
    rows = S.extract(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chapter_id"), "text", "lang").withColumn("chapter_id", F.struct("chapter_id", "lang")).select(F.col("chapter_id.lang").alias("lang"), "text"), "lang")
    kind = T.heuristic_type(F.col("text"))
    return rows.groupBy("lang").agg(F.count("*").alias("segments"), F.count_if(kind == "dialogue").alias("dialogue"), F.count_if(kind != "dialogue").alias("narration"), F.sum(F.length("text")).alias("chars"))


@query("clean_text", f"""
WITH d AS ({D_SQL}), z AS (SELECT doc_id, {ZERO.format('text')} AS t FROM d), n AS (SELECT doc_id, {NAV.format('t')} AS l FROM z),
c AS (SELECT doc_id, CASE WHEN len(list_filter(l, lambda x: {CONTROL.format('x')})) >= 4 THEN list_filter(l, lambda x: NOT {CONTROL.format('x')}) ELSE l END AS l FROM n),
w AS (SELECT doc_id, regexp_replace(regexp_replace(array_to_string(l, chr(10)), ' +', ' ', 'g'), '\\n\\n+', chr(10) || chr(10), 'g') AS t FROM c),
s AS (SELECT doc_id, {WS.format(f"array_to_string(list_transform({LINES.format('t')}, lambda x: {WS.format('x')}), chr(10))")} AS t FROM w)
SELECT doc_id, md5(t) AS digest, CAST(length(t) AS BIGINT) AS chars FROM s""")
def clean_text(spark, sf_dir):
    clean = decorated(spark, sf_dir).select("doc_id", T.clean(F.col("text")).alias("t"))
    return clean.select("doc_id", F.md5("t").alias("digest"), F.length("t").cast("long").alias("chars"))


@query("remove_site_navigation", f"WITH d AS ({D_SQL}) SELECT doc_id, md5(array_to_string({NAV.format('text')}, chr(10))) AS digest FROM d")
def remove_site_navigation(spark, sf_dir):
    return decorated(spark, sf_dir).select("doc_id", F.md5(T.remove_site_navigation(F.col("text"))).alias("digest"))


@query("reader_controls", f"""
WITH d AS ({D_SQL}), n AS (SELECT doc_id, {LINES.format('text')} AS l FROM d)
SELECT doc_id, CAST(len(list_filter(l, lambda x: {CONTROL.format('x')})) AS INTEGER) AS controls,
 md5(array_to_string(CASE WHEN len(list_filter(l, lambda x: {CONTROL.format('x')})) >= 4 THEN list_filter(l, lambda x: NOT {CONTROL.format('x')}) ELSE l END, chr(10))) AS digest FROM n""")
def reader_controls(spark, sf_dir):
    return decorated(spark, sf_dir).select("doc_id", T.control_lines(F.col("text")).alias("controls"), F.md5(T.remove_reader_controls(F.col("text"))).alias("digest"))


@query("ui_noise_lines", f"""
WITH d AS ({D_SQL}) SELECT doc_id, md5({WS.format(f"array_to_string(list_filter({LINES.format('text')}, lambda x: lower({WS.format('x')}) NOT IN ('next chapter', 'subscribe now')), chr(10))")}) AS digest FROM d""")
def ui_noise_lines(spark, sf_dir):
    return decorated(spark, sf_dir).select("doc_id", F.md5(T.remove_ui_lines(F.col("text"))).alias("digest"))


@query("paragraph_segments", f"""
WITH p AS (SELECT doc_id, unnest(parts) AS text, generate_subscripts(parts, 1) - 1 AS pos FROM (SELECT doc_id, {PAR.format('text')} AS parts FROM ({D_SQL})))
SELECT doc_id, CAST(pos AS INTEGER) AS pos, md5(text) AS digest, doc_id || '_p' || CASE WHEN pos < 1000 THEN lpad(CAST(pos AS VARCHAR), 3, '0') ELSE CAST(pos AS VARCHAR) END AS paragraph_id FROM p""")
def paragraph_segments(spark, sf_dir):
    rows = S.with_ids(S.explode_parts(decorated(spark, sf_dir), T.line_paragraphs(F.col("text")), "doc_id"), "doc_id")
    return rows.select("doc_id", "pos", F.md5("text").alias("digest"), "paragraph_id")


@query("blank_line_paragraphs", f"""
SELECT doc_id, CAST(len(list_filter(list_transform(string_split_regex(text, '\\n{{2,}}|\\r{{2,}}'), lambda p: {WS.format('p')}), lambda p: p <> '')) AS INTEGER) AS n FROM ({D_SQL})""")
def blank_line_paragraphs(spark, sf_dir):
    return decorated(spark, sf_dir).select("doc_id", F.size(T.paragraphs(F.col("text"))).alias("n"))


@query("segment_context", """
SELECT conv_id, turn, md5(lag(text, 1, '') OVER w) AS before, md5(lead(text, 1, '') OVER w) AS after FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def segment_context(spark, sf_dir):
    rows = S.with_context(table(spark, sf_dir, "conversations"), "conv_id", order="turn")
    return rows.select("conv_id", "turn", F.md5("context_before").alias("before"), F.md5("context_after").alias("after"))


@query("document_context", f"""
WITH p AS (SELECT doc_id, unnest(parts) AS text, CAST(generate_subscripts(parts, 1) - 1 AS INTEGER) AS pos FROM (SELECT doc_id, {PAR.format('text')} AS parts FROM documents))
SELECT doc_id, pos, md5(lag(text, 1, '') OVER w) AS before, md5(lead(text, 1, '') OVER w) AS after FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY pos)""")
def document_context(spark, sf_dir):
    rows = S.extract(table(spark, sf_dir, "documents"), "doc_id")
    return rows.select("doc_id", "pos", F.md5("context_before").alias("before"), F.md5("context_after").alias("after"))


@query("dialogue_candidates", f"""
SELECT doc_id, count(*) AS segments, count(*) FILTER (regexp_matches(line, '^["“].+["”]\\s*$') OR regexp_matches(line, '^".+?"') OR regexp_matches(line, '^[A-Z][a-z]+: ') OR regexp_matches(line, '^\\w+\\s*—')) AS candidates FROM ({L_SQL}) GROUP BY doc_id""")
def dialogue_candidates(spark, sf_dir):
    return decorated_lines(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("segments"), F.count_if(T.is_speech_candidate(F.col("line"))).alias("candidates"))


@query("dialogue_detector", f"""SELECT doc_id, pos, regexp_matches(line, '^\\s*["''「『【（《<]') AND regexp_matches(line, '["''」』】）》>]') AS dialogue FROM ({L_SQL})""")
def dialogue_detector(spark, sf_dir):
    return decorated_lines(spark, sf_dir).select("doc_id", "pos", T.is_quoted_line(F.col("line")).alias("dialogue"))


@query("thought_detector", f"""
SELECT doc_id, pos, CASE WHEN regexp_matches(line, '^\\*(.*?)\\*$') OR regexp_matches(line, '^_(.*?)_$') OR regexp_matches(line, '^''(.*?)''$') OR regexp_matches(line, '^\\((.*?)\\)$') THEN 'thought' ELSE 'narration' END AS type FROM ({L_SQL})""")
def thought_detector(spark, sf_dir):
    return decorated_lines(spark, sf_dir).select("doc_id", "pos", T.thought_or(F.lit("narration"), F.col("line")).alias("type"))


HEUR = """CASE WHEN (starts_with({0}, '"') OR starts_with({0}, '“') OR starts_with({0}, chr(39))) AND (ends_with({0}, '"') OR ends_with({0}, '”') OR ends_with({0}, chr(39))) THEN 'dialogue' ELSE 'narration' END"""


@query("heuristic_type", f"""
SELECT type, CASE WHEN type = 'narration' THEN 'narrator' ELSE 'unknown' END AS speaker, count(*) AS n FROM (
 SELECT CASE WHEN (starts_with(line, '"') OR starts_with(line, '“') OR starts_with(line, '''')) AND (ends_with(line, '"') OR ends_with(line, '”') OR ends_with(line, '''')) THEN 'dialogue' ELSE 'narration' END AS type FROM ({L_SQL})) GROUP BY ALL""")
def heuristic_type(spark, sf_dir):
    rows = decorated_lines(spark, sf_dir).select(T.heuristic_type(F.col("line")).alias("type"))
    return rows.select("type", T.heuristic_speaker(F.col("type")).alias("speaker")).groupBy("type", "speaker").agg(F.count("*").alias("n"))


@query("delimiter_type", f"""
SELECT doc_id, pos, CASE WHEN regexp_matches(line, '"([^"]+?)"') THEN 'double_quotes' WHEN regexp_matches(line, '(^|\\W)''([^'']+?)''(\\W|$)') THEN 'single_quotes'
 WHEN regexp_matches(line, '\\[([^\\[\\]]+?)\\]') THEN 'square_brackets' WHEN regexp_matches(line, '\\{{([^{{}}]+?)\\}}') THEN 'curly_braces'
 WHEN regexp_matches(line, '<([^<>]+?)>') THEN 'angle_brackets' WHEN regexp_matches(line, '\\(([^()]+?)\\)') THEN 'parentheses' ELSE 'none' END AS delimiter
FROM ({L_SQL})""")
def delimiter_type(spark, sf_dir):
    return decorated_lines(spark, sf_dir).select("doc_id", "pos", T.delimiter_type(F.col("line")).alias("delimiter"))


# Each kind's matches with the texts between them; places are sums of their lengths. The checking engine has no
# look-around, and the tables no single quotes that would need it: those are in the tests.
_KINDS = " UNION ALL ".join(f"SELECT doc_id, {rank} AS rank, regexp_extract_all(text, '{p}', 0) AS w, regexp_extract_all(text, '{p}', 1) AS g, string_split_regex(text, '{p}') AS b FROM d" for rank, p in enumerate(p.replace("(?<!\\w)", "").replace("(?!\\w)", "").replace("'", "''") for _, p in T.DELIMITERS))


@query("delimited_fragments", f"""
WITH d AS ({D_SQL}), k AS ({_KINDS}), i AS (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM k),
m AS (SELECT doc_id, rank, CAST(len(array_to_string(b[1:i], '')) + len(array_to_string(w[1:i - 1], '')) AS INTEGER) AS place, {WS.format('g[i]')} AS fragment FROM i),
u AS (SELECT doc_id, place, fragment, min(rank) AS rank FROM m WHERE fragment <> '' GROUP BY ALL)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY place, rank, fragment) - 1 AS INTEGER) AS pos, place AS "at", md5(fragment) AS digest FROM u""")
def delimited_fragments(spark, sf_dir):
    rows = decorated(spark, sf_dir).select("doc_id", F.posexplode(T.fragments(F.col("text"))).alias("pos", "f"))
    return rows.select("doc_id", "pos", "f.at", F.md5("f.fragment").alias("digest"))


@query("parenthesis_fragments", f"""
SELECT doc_id, md5(array_to_string(list_filter(list_transform(regexp_extract_all(text, '\\(([^()]+?)\\)', 1), lambda x: {WS.format('x')}), lambda x: x <> ''), chr(10))) AS digest FROM ({D_SQL})""")
def parenthesis_fragments(spark, sf_dir):
    return decorated(spark, sf_dir).select("doc_id", F.md5(T.delimited_only(F.col("text"), ("parentheses",))).alias("digest"))


SENT = f"list_filter(list_transform(string_split_regex(text, '[.!?]+'), lambda p: {WS.format('p')}), lambda p: p <> '')"
S_SQL = f"SELECT doc_id, unnest(s) AS sentence, CAST(generate_subscripts(s, 1) - 1 AS INTEGER) AS pos FROM (SELECT doc_id, {SENT} AS s FROM ({D_SQL}))"


def sentences(spark, sf_dir) -> DataFrame:
    return S.explode_parts(decorated(spark, sf_dir), T.sentences(F.col("text")), "doc_id", "sentence")


@query("sentence_split", f"SELECT doc_id, pos, md5(sentence) AS digest FROM ({S_SQL})")
def sentence_split(spark, sf_dir):
    return sentences(spark, sf_dir).select("doc_id", "pos", F.md5("sentence").alias("digest"))


_DIM = ", ".join(f"('{p}', '{c}')" for c, ps in C.PRONOUNS.items() for p in ps)
P_SQL = f"SELECT doc_id, t.p AS pronoun, d.c AS category FROM (SELECT doc_id, regexp_replace(unnest(string_split(regexp_replace({WS.format('lower(sentence)')}, '\\s+', ' ', 'g'), ' ')), '[^\\p{{L}}\\p{{N}}_]', '', 'g') AS p FROM ({S_SQL})) t JOIN (VALUES {_DIM}) d(p, c) ON t.p = d.p"


@query("pronoun_counts", f"SELECT pronoun, category, count(*) AS n FROM ({P_SQL}) GROUP BY ALL")
def pronoun_counts(spark, sf_dir):
    return C.pronoun_rows(sentences(spark, sf_dir), "doc_id").groupBy("pronoun", "category").agg(F.count("*").alias("n"))


@query("gender_inference", f"""
WITH g AS (SELECT doc_id, count(*) FILTER (pronoun IN {C.MALE}) AS m, count(*) FILTER (pronoun IN {C.FEMALE}) AS f, count(*) FILTER (pronoun IN {C.NEUTRAL}) AS o FROM ({P_SQL}) GROUP BY doc_id)
SELECT doc_id, CASE WHEN m > f AND m > o THEN 'male' WHEN f > m AND f > o THEN 'female' WHEN o > 0 THEN 'neutral' END AS gender FROM g""")
def gender_inference(spark, sf_dir):
    return C.pronoun_rows(sentences(spark, sf_dir), "doc_id").groupBy("doc_id").agg(C.inferred_gender().alias("gender"))


@query("mention_counts", f"""
SELECT doc_id, count(*) AS mentions, CAST(min(pos) AS INTEGER) AS first FROM ({S_SQL}) WHERE contains(sentence, 'Alice') GROUP BY doc_id""")
def mention_counts(spark, sf_dir):
    names = table(spark, sf_dir, "documents").select("doc_id", F.lit("Alice").alias("name"))
    return N.mentions(sentences(spark, sf_dir), names).groupBy("doc_id").agg(F.count("*").alias("mentions"), F.min("pos").alias("first"))


_PRON = "|".join(sorted({p for ps in C.PRONOUNS.values() for p in ps}))


@query("pronoun_backreference", f"""
WITH r AS (SELECT *, CASE WHEN contains(sentence, 'Alice') THEN 'Alice' WHEN contains(sentence, 'Bob') THEN 'Bob' END AS mentioned, regexp_matches(lower(sentence), '(^|\\s)\\W*({_PRON})\\W*(\\s|$)') AS p FROM ({S_SQL}))
SELECT doc_id, pos, CASE WHEN mentioned IS NOT NULL THEN mentioned WHEN p THEN last_value(mentioned IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) END AS referent FROM r""")
def pronoun_backreference(spark, sf_dir):
    names = F.array(F.lit("Alice"), F.lit("Bob"))
    return C.back_references(sentences(spark, sf_dir), names).select("doc_id", "pos", "referent")


_WORDS = lambda words: "(" + ", ".join(f"'{w}'" for w in words) + ")"
# The checking engine's word borders know ASCII letters only, so other letters become a low line where borders are looked for.
_PLAIN = "regexp_replace({}, '[À-ÖØ-öø-ÿŒœ]', '_', 'g')"
_NAMES = "list_distinct(regexp_extract_all({}, '\\b([A-Z][a-z]+(?:\\s+[A-Z][a-z]+)*)\\b', 1))"


@query("name_candidates", f"""
WITH s AS ({S_SQL}), t AS (SELECT doc_id, sentence, list_transform(string_split(regexp_replace({WS.format('lower(sentence)')}, '\\s+', ' ', 'g'), ' '), lambda w: regexp_replace(w, '[^\\p{{L}}\\p{{N}}_]', '', 'g')) AS w FROM s),
p AS (SELECT doc_id, w, unnest({_NAMES.format(_PLAIN.format('sentence'))}) AS name FROM t),
plain AS (SELECT doc_id, name FROM p WHERE lower(name) NOT IN {_WORDS(N.COMMON)} AND length(name) > 1 AND len(list_filter(string_split_regex(lower(name), '\\s+'), lambda x: x NOT IN {_WORDS(N.NOT_NAMES)})) > 0
 AND len(list_filter(range(1, len(w) + 1), lambda i: w[i] = lower(name) AND (i > 1 AND coalesce(w[i - 1], '') IN {_WORDS(N.PLACES)} OR coalesce(w[i + 1], '') IN {_WORDS(N.ROLES)}))) = 0),
titled AS (SELECT doc_id, unnest(regexp_extract_all({_PLAIN.format('text')}, '\\b(?i:{"|".join(sorted(N.HONORIFICS, key=len, reverse=True))})\\.?\\s+([A-Z][a-z]+(?:\\s+[A-Z][a-z]+)*)\\b', 1)) AS name FROM ({D_SQL})),
n AS (SELECT DISTINCT doc_id, name FROM (SELECT * FROM plain UNION ALL SELECT * FROM titled)),
c AS (SELECT n.doc_id, n.name, CAST((length(d.text) - length(replace(d.text, n.name, ''))) // length(n.name) AS INTEGER) AS n FROM n JOIN ({D_SQL}) d USING (doc_id))
SELECT doc_id, name, n, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, name) AS rank FROM c) WHERE rank <= 20""")
def name_candidates(spark, sf_dir):
    return N.name_candidates(decorated(spark, sf_dir)).select("doc_id", "name", "n", "rank")


@query("char_chunks", """
WITH n AS (SELECT doc_id, text, length(text) AS len, CASE WHEN length(text) <= 1000 THEN 1 ELSE 1 + CAST(ceil((length(text) - 1000) / 900.0) AS INTEGER) END AS c FROM documents)
SELECT doc_id, CAST(i AS INTEGER) AS pos, md5(substring(text, CAST(i * 900 + 1 AS INTEGER), 1000)) AS digest, CASE WHEN c = 1 THEN CAST(doc_id AS VARCHAR) ELSE doc_id || '_c' || i END AS chunk_id FROM (SELECT *, unnest(range(c)) AS i FROM n)""")
def char_chunks(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", S.chunks(F.col("text"), 1000, 100).alias("c"))
    rows = rows.select("doc_id", F.size("c").alias("n"), F.posexplode("c").alias("pos", "t"))
    return rows.select("doc_id", "pos", F.md5("t").alias("digest"), S.chunk_name(F.col("doc_id").cast("string"), F.col("pos"), F.col("n")).alias("chunk_id"))


@query("tumbling_batches", f"""
SELECT doc_id, CAST(pos // 20 AS INTEGER) AS batch, count(*) AS n FROM ({L_SQL}) GROUP BY ALL""")
def tumbling_batches(spark, sf_dir):
    rows = decorated_lines(spark, sf_dir).withColumn("batch", S.batch_number(F.col("pos"), 20))
    return rows.groupBy("doc_id", "batch").agg(F.count("*").alias("n"))


@query("clip_timing", """
WITH s AS (SELECT conv_id, turn, CASE WHEN turn % 5 = 4 THEN NULL ELSE length(text) / 16.0 END AS d FROM conversations)
SELECT conv_id, turn, round(coalesce(sum(coalesce(d, 0)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) AS clip_begin,
 round(coalesce(sum(coalesce(d, 0)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + coalesce(d, 0), 6) AS clip_end FROM s""")
def clip_timing(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("seconds", F.when(F.col("turn") % 5 != 4, F.length("text") / 16.0))
    return S.timed(rows, "conv_id", order="turn").select("conv_id", "turn", F.round("clip_begin", 6).alias("clip_begin"), F.round("clip_end", 6).alias("clip_end"))


@query("conversation_progress", "SELECT conv_id, turn, CAST(floor(row_number() OVER (PARTITION BY conv_id ORDER BY turn) * 100 / count(*) OVER (PARTITION BY conv_id)) AS INTEGER) AS percent, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS next_turn FROM conversations")
def conversation_progress(spark, sf_dir):
    rows = S.next_in(S.progress(table(spark, sf_dir, "conversations"), "conv_id", order="turn"), "conv_id", order="turn")
    return rows.select("conv_id", "turn", "percent", F.col("next_number").alias("next_turn"))


@query("batch_failures", """
WITH b AS (SELECT conv_id, turn, length(text) % 3 = 0 AS failed FROM conversations)
SELECT conv_id, turn, CAST(sum(failed::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS failures, coalesce(sum(failed::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) >= 2 AS single_mode FROM b""")
def batch_failures(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("failed", F.length("text") % 3 == 0)
    return S.with_first_failure(rows, "conv_id", 2, order="turn").select("conv_id", "turn", "failures", "single_mode")


NK = f"replace(regexp_replace(lower({WS}), '[.,]', '', 'g'), '  ', ' ')"
SP_SQL = f"SELECT c_nationkey, c_custkey AS pos, {SPEAKER} AS speaker, CASE c_custkey % 3 WHEN 0 THEN 'male' WHEN 1 THEN 'unknown' ELSE 'female' END AS gender FROM (SELECT c_custkey, c_nationkey, 'Cust ' || (c_custkey // 9) AS c_name FROM customer)"


def speakers(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", F.expr("concat('Cust ', c_custkey div 9)").alias("c_name"))
    return rows.select("c_nationkey", F.col("c_custkey").alias("pos"), F.expr(SPEAKER).alias("speaker"), F.expr("CASE c_custkey % 3 WHEN 0 THEN 'male' WHEN 1 THEN 'unknown' ELSE 'female' END").alias("gender"))


@query("character_merge", f"""
WITH s AS (SELECT *, {NK.format('speaker')} AS key FROM ({SP_SQL})), n AS (SELECT * FROM s WHERE key NOT IN ('', 'narrator', 'unknown')),
u AS (SELECT c_nationkey, key, speaker, min(pos) AS first FROM n GROUP BY ALL)
SELECT u.c_nationkey, u.key, arg_min(u.speaker, u.first) AS name, array_to_string(list(u.speaker ORDER BY u.first)[2:], '|') AS aliases,
 (SELECT coalesce(arg_min(g.gender, g.pos), 'unknown') FROM n g WHERE g.c_nationkey = u.c_nationkey AND g.key = u.key AND g.gender <> 'unknown') AS gender
FROM u GROUP BY u.c_nationkey, u.key""")
def character_merge(spark, sf_dir):
    return C.merged(speakers(spark, sf_dir), "c_nationkey").select("c_nationkey", "key", "name", F.array_join("aliases", "|").alias("aliases"), "gender")


@query("registry_ids", f"""
WITH s AS (SELECT c_nationkey, pos, speaker, lower({WS.format('speaker')}) AS key FROM ({SP_SQL})), f AS (SELECT c_nationkey, key, min(pos) AS first, arg_min(speaker, pos) AS name FROM s WHERE key <> '' GROUP BY ALL)
SELECT c_nationkey, key, 'char_' || row_number() OVER (PARTITION BY c_nationkey ORDER BY first, key) AS character_id, {WS.format('name')} AS display_name FROM f""")
def registry_ids(spark, sf_dir):
    return C.registry(speakers(spark, sf_dir), "c_nationkey")


@query("speaker_normalize", f"""
WITH k AS (SELECT pos, CASE pos % 2 WHEN 0 THEN 'narration' ELSE 'dialogue' END AS kind, regexp_replace({WS.format('speaker')}, '(\\s*[.,!?;:])+\\s*$', '') AS b FROM ({SP_SQL}))
SELECT pos, CASE WHEN b = '' THEN CASE WHEN kind = 'narration' THEN 'narrator' ELSE 'unknown' END WHEN lower(b) IN ('narrator', 'unknown') THEN lower(b) ELSE b END AS speaker FROM k""")
def speaker_normalize(spark, sf_dir):
    kind = F.when(F.col("pos") % 2 == 0, "narration").otherwise("dialogue")
    return speakers(spark, sf_dir).select("pos", T.speaker(F.col("speaker"), kind).alias("speaker"))


@query("detected_last_wins", """
SELECT lower(event_type) AS key, arg_max(event_id, (value, event_id)) AS event_id, max(value) AS value, min(event_id) AS seen FROM events WHERE value IS NOT NULL GROUP BY 1""")
def detected_last_wins(spark, sf_dir):
    rows = table(spark, sf_dir, "events").where("value is not null").select("event_type", "event_id", "value")
    return C.last_of_best(rows, name="event_type", score="value", order="event_id").select("key", "event_id", "value", "seen")


@query("first_wins", "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1")
def first_wins(spark, sf_dir):
    return C.first_of_each(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", order="event_id")


VOICE_IN = "CASE WHEN c_custkey % 11 = 0 THEN ' own ' ELSE ' ' END"


@query("voice_routing", f"""
WITH s AS (SELECT c.c_custkey, {VOICE_IN} AS v, CASE c_custkey % 4 WHEN 0 THEN 'thought' WHEN 1 THEN 'dialogue' ELSE 'narration' END AS kind, CASE c_custkey % 5 WHEN 0 THEN 'Narrator' WHEN 1 THEN '' ELSE c_name END AS who, CASE c_custkey % 3 WHEN 0 THEN 'Male' WHEN 1 THEN 'female' END AS g, CASE WHEN n_nationkey % 2 = 0 THEN 'v_' || n_name END AS cv FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey)
SELECT c_custkey, CASE WHEN trim(v) <> '' THEN trim(v) WHEN kind = 'thought' OR who = '' OR lower(who) IN ('narrator', 'unknown') THEN 'nar' WHEN cv IS NOT NULL THEN cv WHEN lower(coalesce(g, 'unknown')) = 'male' THEN 'm' WHEN lower(coalesce(g, 'unknown')) = 'female' THEN 'f' ELSE 'nar' END AS voice FROM s""")
def voice_routing(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.col("c_custkey")
    kind = F.when(k % 4 == 0, "thought").when(k % 4 == 1, "dialogue").otherwise("narration")
    who = F.when(k % 5 == 0, "Narrator").when(k % 5 == 1, "").otherwise(F.col("c_name"))
    gender = F.when(k % 3 == 0, "Male").when(k % 3 == 1, "female")
    voice = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("v_"), "n_name"))
    return rows.select("c_custkey", C.route_voice(F.expr(VOICE_IN), kind, who, gender, voice, "nar", "m", "f").alias("voice"))


@query("voice_resolution", f"""
WITH m AS (SELECT s_suppkey AS pos, s_name AS name, 'voice' || s_suppkey AS voice FROM supplier),
s AS (SELECT l_orderkey, l_linenumber, CASE l_linenumber % 3 WHEN 0 THEN s_name WHEN 1 THEN '  ' || upper(s_name) || ' ' ELSE 'Nobody' END AS speaker, CASE l_returnflag WHEN 'A' THEN ' Male' WHEN 'N' THEN 'female' END AS gender FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)
SELECT l_orderkey, l_linenumber, coalesce(a.voice, b.voice, CASE lower(trim(coalesce(gender, ''))) WHEN 'male' THEN 'm' WHEN 'female' THEN 'f' END, 'nar') AS voice,
 CASE WHEN a.voice IS NOT NULL THEN 'exact' WHEN b.voice IS NOT NULL THEN 'normalized' WHEN lower(trim(coalesce(gender, ''))) IN ('male', 'female') THEN 'fallback_gender' ELSE 'fallback' END AS resolution
FROM s LEFT JOIN m a ON s.speaker = a.name LEFT JOIN m b ON regexp_replace({WS.format('lower(s.speaker)')}, '\\s+', ' ', 'g') = lower(b.name)""")
def voice_resolution(spark, sf_dir):
    supplier = table(spark, sf_dir, "supplier")
    mapping = supplier.select(F.col("s_suppkey").alias("pos"), F.col("s_name").alias("name"), F.concat(F.lit("voice"), "s_suppkey").alias("voice"))
    n = F.col("l_linenumber")
    rows = table(spark, sf_dir, "lineitem").join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    rows = rows.select("l_orderkey", n, F.when(n % 3 == 0, F.col("s_name")).when(n % 3 == 1, F.concat(F.lit("  "), F.upper("s_name"), F.lit(" "))).otherwise("Nobody").alias("speaker"), F.when(F.col("l_returnflag") == "A", " Male").when(F.col("l_returnflag") == "N", "female").alias("gender"))
    return C.mapped_voice(rows, mapping, "nar", "m", "f").select("l_orderkey", "l_linenumber", "voice", "resolution")


@query("alias_resolution", f"""
WITH c AS (SELECT s_suppkey AS pos, s_name AS name, 'Sup ' || (s_suppkey // 2) AS alias FROM supplier),
k AS (SELECT {NK.format('name')} AS k, arg_min(name, pos) AS character FROM c GROUP BY 1), a AS (SELECT {NK.format('alias')} AS k, arg_min(name, pos) AS character FROM c GROUP BY 1),
s AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN upper('supplier#') || lpad(CAST(c_custkey AS VARCHAR), 9, '0') || '.' WHEN 1 THEN ' SUP  ' || (c_custkey // 10) ELSE c_name END AS speaker FROM customer)
SELECT c_custkey, coalesce(k.character, a.character) AS character, CASE WHEN k.character IS NOT NULL THEN 'exact' WHEN a.character IS NOT NULL THEN 'alias' END AS how FROM s LEFT JOIN k ON {NK.format('s.speaker')} = k.k LEFT JOIN a ON {NK.format('s.speaker')} = a.k""")
def alias_resolution(spark, sf_dir):
    people = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("pos"), F.col("s_name").alias("name"), F.lit("").alias("voice"), F.array(F.expr("concat('Sup ', s_suppkey div 2)")).alias("aliases"))
    k = F.col("c_custkey")
    who = F.when(k % 3 == 0, F.concat(F.lit("SUPPLIER#"), F.lpad(k.cast("string"), 9, "0"), F.lit("."))).when(k % 3 == 1, F.expr("concat(' SUP  ', c_custkey div 10)")).otherwise(F.col("c_name"))
    return C.resolved(table(spark, sf_dir, "customer").select("c_custkey", who.alias("speaker")), people, fuzzy_cutoff=None).select("c_custkey", "character", "how")


# A name and an s: no key is closer than the name itself, whose ratio is 2 n / (2 n + 1).
@query("fuzzy_resolution", f"""
SELECT p_partkey, p_name || 's' AS speaker, first_value(p_name) OVER (PARTITION BY {NK.format('p_name')} ORDER BY p_partkey) AS character, 'fuzzy' AS how FROM part""")
def fuzzy_resolution(spark, sf_dir):
    people = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pos"), F.col("p_name").alias("name"), F.lit("").alias("voice"), F.array().cast("array<string>").alias("aliases"))
    who = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.col("p_name"), F.lit("s")).alias("speaker"))
    return C.resolved(who, people).select("p_partkey", "speaker", "character", "how")


@query("manual_overrides", """
WITH o AS (SELECT conv_id, turn, CASE WHEN turn % 4 = 0 THEN NULL ELSE 'fixed' END AS role, turn * 2 AS extra FROM conversations WHERE turn % 2 = 0)
SELECT c.conv_id, c.turn, CASE WHEN o.turn IS NOT NULL THEN o.role ELSE c.role END AS role, o.extra FROM conversations c LEFT JOIN o ON c.conv_id = o.conv_id AND c.turn = o.turn""")
def manual_overrides(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.concat_ws("/", "conv_id", "turn").alias("segment_id"))
    fixes = rows.where("turn % 2 = 0").select("segment_id", F.when(F.col("turn") % 4 != 0, "fixed").alias("role"), (F.col("turn") * 2).alias("extra"))
    return C.overridden(rows, fixes).select("conv_id", "turn", "role", "extra")


@query("needs_review", """
WITH s AS (SELECT event_id, event_type, CASE WHEN event_id % 9 = 0 THEN NULL ELSE (event_id % 10) / 10.0 END AS c, CASE event_id % 7 WHEN 0 THEN true WHEN 1 THEN false END AS f FROM events)
SELECT event_type, count(*) AS segments, count(*) FILTER (coalesce(c, 1.0) < 0.8 OR coalesce(f, false)) AS review, count(*) FILTER (coalesce(c, 0.0) >= 0.8) AS sure FROM s GROUP BY 1""")
def needs_review(spark, sf_dir):
    k = F.col("event_id")
    rows = table(spark, sf_dir, "events").select("event_type", F.when(k % 9 != 0, (k % 10) / 10.0).alias("c"), F.when(k % 7 == 0, True).when(k % 7 == 1, False).alias("f"))
    return rows.groupBy("event_type").agg(F.count("*").alias("segments"), F.count_if(C.needs_review(F.col("c"), F.col("f"))).alias("review"), F.count_if(F.coalesce("c", F.lit(0.0)) >= 0.8).alias("sure"))


_EMO = ["neutral", "Happy", "SAD", "angry", "fearful", "surprised", "disgusted", "whispering", "bored"]


@query("emotion_speed", f"""
WITH e AS (SELECT event_id, {_EMO!r}[CAST(event_id % 9 AS INTEGER) + 1] AS emotion FROM events)
SELECT event_id, emotion, round(CAST(1.25 AS DOUBLE) * coalesce(CAST(m.s AS DOUBLE), 1.0), 6) AS speed FROM e LEFT JOIN (VALUES {', '.join(f"('{n}', {s})" for n, s, _, _ in C.EMOTIONS)}) m(n, s) ON lower(e.emotion) = m.n""")
def emotion_speed(spark, sf_dir):
    emotion = F.element_at(F.array(*map(F.lit, _EMO)), (F.col("event_id") % 9 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", emotion.alias("emotion"), F.round(C.emotion_speed(F.lit(1.25), emotion), 6).alias("speed"))


@query("id_contract_check", """
WITH e AS (SELECT o_orderkey AS k, unnest(range(1, 5)) AS i FROM orders), g AS (SELECT l_orderkey AS k, l_linenumber AS i, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT coalesce(e.k, g.k) AS orderkey, CAST(count(*) FILTER (g.n IS NULL) AS BIGINT) AS missing, CAST(count(*) FILTER (e.i IS NULL) AS BIGINT) AS extra, CAST(count(*) FILTER (g.n > 1) AS BIGINT) AS duplicate FROM e FULL JOIN g ON e.k = g.k AND e.i = g.i GROUP BY 1""")
def id_contract_check(spark, sf_dir):
    expected = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("orderkey"), F.explode(F.sequence(F.lit(1), F.lit(4))).alias("i"))
    got = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("orderkey"), F.col("l_linenumber").alias("i"))
    return ledger.id_contract(expected, got, "orderkey", "i")


REPLY = """CASE event_id % 8
 WHEN 0 THEN concat('[{"id":"a","type":"dialogue","speaker":"X","gender":"male","speaker_confidence":0.5,"gender_confidence":"0.75","character_confidence":1},]')
 WHEN 1 THEN concat('```json
[{"id":"a","type":"Thought","speaker":"X","gender":"male","speaker_confidence":0.5,"gender_confidence":1,"character_confidence":1}]
```')
 WHEN 2 THEN 'Sure! [{"id":"b","type":"narration","speaker":"X","gender":"x","speaker_confidence":0,"gender_confidence":0,"character_confidence":0}] done'
 WHEN 3 THEN '{"id":"a","type":"narration","speaker":"X","gender":"x","speaker_confidence":0,"gender_confidence":0,"character_confidence":0}'
 WHEN 4 THEN '[{"id":"a","type":"song","speaker":"X","gender":"x","speaker_confidence":0,"gender_confidence":0,"character_confidence":0}]'
 WHEN 5 THEN '[{"id":"a","type":"thought","speaker":"X","gender":"x","speaker_confidence":1.5,"gender_confidence":0,"character_confidence":0}]'
 WHEN 6 THEN '[{"id":"a","type":"thought","speaker":"X","gender":"x","speaker_confidence":"high","gender_confidence":0,"character_confidence":0}]'
 ELSE 'no json here' END"""


@query("contract_errors", """
SELECT event_id, CASE event_id % 8 WHEN 0 THEN '' WHEN 1 THEN '' WHEN 2 THEN 'ID mismatch: missing a; extra b' WHEN 3 THEN '' WHEN 4 THEN 'Item 0 has invalid type: song' WHEN 5 THEN 'Item 0 speaker_confidence is out of range' WHEN 6 THEN 'Item 0 speaker_confidence is not a number' ELSE 'Top-level must be an array' END AS error FROM events""")
def contract_errors(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.expr(REPLY).alias("reply"))
    return rows.select("event_id", F.coalesce(J.error(F.col("reply"), F.array(F.lit("a"))), F.lit("")).alias("error"))


@query("json_props", """
SELECT event_id, json_valid(props) AS valid, CAST(len(json_keys(props)) AS INTEGER) AS keys FROM events WHERE props IS NOT NULL""")
def json_props(spark, sf_dir):
    rows = table(spark, sf_dir, "events").where("props is not null").select("event_id", F.json_object_keys("props").alias("k"))
    return rows.select("event_id", F.col("k").isNotNull().alias("valid"), F.size("k").alias("keys"))


@query("json_diff", """
SELECT event_id, 'a' AS path, CAST(event_id AS VARCHAR) AS a, CAST(event_id + 1 AS VARCHAR) AS b FROM events WHERE event_id % 2 = 1
UNION ALL SELECT event_id, 'c', '<missing>', '{"d":1}' FROM events
UNION ALL SELECT event_id, 'list', '[' || event_id || ',{"v":2}]', '[' || event_id || ',{"v":1}]' FROM events WHERE event_id % 2 = 1
UNION ALL SELECT event_id, 'n.x.kind', 'click', event_type FROM events WHERE event_type <> 'click'
UNION ALL SELECT event_id, 'n.x.gone', '[]', '<missing>' FROM events WHERE event_id % 3 = 0""")
def json_diff(spark, sf_dir):
    k, odd, kind = F.col("event_id"), F.col("event_id") % 2, F.col("event_type")
    items = lambda v: F.array(k.cast("string"), F.concat(F.lit('{"v":'), v.cast("string"), F.lit("}")))
    text = lambda a, kind, v, gone, more: F.concat(F.lit('{"n": {"x": {"kind": "'), kind, F.lit('"'), gone, F.lit('}}, "b": "'), F.col("event_type"), F.lit('", "a": '), a.cast("string"), F.lit(', "list": ['), F.array_join(items(v), ", "), F.lit("]"), F.lit(more), F.lit("}"))
    gone = F.when(k % 3 == 0, ', "gone": []').otherwise("")
    rows = table(spark, sf_dir, "events").select(k, text(k, F.lit("click"), odd + 1, gone, "").alias("l"), text(k + odd, kind, F.lit(1), F.lit(""), ', "c": {"d": 1}').alias("r"))
    return ledger.json_differences(rows, "event_id", left="l", right="r")


@query("url_canonical", r"""
WITH p AS (SELECT page_id, url, regexp_extract(url, '^((?:[^:/?#]+:)?(?://[^/?#]*)?)', 1) AS head, regexp_replace(regexp_extract(url, '^(?:[^:/?#]+:)?(?://[^/?#]*)?([^?#]*)', 1), '/+$', '') AS path, regexp_extract(url, '([?#].*)$', 1) AS tail FROM pages)
SELECT page_id, head || CASE WHEN path = '' THEN '/' ELSE path END || tail AS canonical, regexp_extract(url, '//([^/?#]*)', 1) AS authority FROM p""")
def url_canonical(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", U.canonical(F.col("url")).alias("canonical"), U.authority(F.col("url")).alias("authority"))


@query("registrable_domain", r"SELECT page_id, array_to_string(list_reverse(list_reverse(string_split(lower(regexp_extract(url, '//([^/?#:]*)', 1)), '.'))[1:2]), '.') AS domain FROM pages")
def registrable_domain(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", U.registrable(F.col("url")).alias("domain"))


PURL = "CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN concat(url, '/chapter-', page_id) WHEN 2 THEN concat('https://h.example/x/', page_id, '/') ELSE concat(url, '?page=', page_id) END"


@query("link_kinds", f"""
WITH p AS (SELECT page_id, {PURL} AS u, CASE page_id % 6 WHEN 0 THEN ' Next ' WHEN 1 THEN '12' ELSE 'Read' END AS label FROM pages), q AS (SELECT *, lower(regexp_extract(u, '^(?:[^:/?#]+:)?(?://[^/?#]*)?([^?#]*)', 1)) AS path FROM p)
SELECT page_id, CASE WHEN contains(lower(trim(label)), 'next') OR regexp_matches(lower(u), '[?&](page|p)=\\d+') OR regexp_matches(path, '/(page|p)/\\d+') OR regexp_matches(trim(label), '^\\d{{1,4}}$') THEN 'pagination'
 WHEN contains(path, 'chapter') OR (regexp_matches(path, '/\\d+/?$') AND starts_with(path, '/x') AND path <> '/x/') THEN 'chapter' ELSE 'other' END AS kind FROM q""")
def link_kinds(spark, sf_dir):
    label = F.when(F.col("page_id") % 6 == 0, " Next ").when(F.col("page_id") % 6 == 1, "12").otherwise("Read")
    return table(spark, sf_dir, "pages").select("page_id", U.link_kind(F.expr(PURL), label, F.lit("/x")).alias("kind"))


@query("page_links", r"""
WITH a AS (SELECT page_id, url, regexp_extract_all(html, '(?is)<a\b[^>]*?\shref="([^"]*)"[^>]*>(.*?)</a>', 1) AS h, regexp_extract_all(html, '(?is)<a\b[^>]*?\shref="([^"]*)"[^>]*>(.*?)</a>', 2) AS l FROM pages),
r AS (SELECT page_id, url, generate_subscripts(h, 1) - 1 AS pos, unnest(h) AS href, trim(unnest(l)) AS label FROM a)
SELECT page_id, CAST(pos AS INTEGER) AS pos, href, label FROM r""")
def page_links(spark, sf_dir):
    return web.anchors(table(spark, sf_dir, "pages"), "page_id")


@query("link_classify", f"""
WITH a AS (SELECT page_id, url, regexp_extract_all(html, '(?is)<a\\b[^>]*?\\shref="([^"]*)"[^>]*>(.*?)</a>', 1) AS h, regexp_extract_all(html, '(?is)<a\\b[^>]*?\\shref="([^"]*)"[^>]*>(.*?)</a>', 2) AS l FROM pages),
r AS (SELECT page_id, url, CAST(generate_subscripts(h, 1) - 1 AS INTEGER) AS pos, replace(trim(unnest(h)), '&amp;', '&') AS href, lower(trim(regexp_replace(unnest(l), '<[^>]*>', '', 'g'))) AS label FROM a),
f AS (SELECT *, regexp_extract(url, '^([^:/?#]+)://([^/?#]*)([^?#]*)', 1) AS sch, regexp_extract(url, '^([^:/?#]+)://([^/?#]*)([^?#]*)', 2) AS host, regexp_extract(url, '^([^:/?#]+)://([^/?#]*)([^?#]*)', 3) AS path FROM r WHERE href <> '' AND NOT starts_with(href, '#') AND NOT starts_with(href, 'javascript:')),
u AS (SELECT *, CASE WHEN starts_with(href, '//') THEN sch || ':' || href WHEN starts_with(href, '/') THEN sch || '://' || host || href WHEN starts_with(href, 'http') THEN href ELSE sch || '://' || host || regexp_replace(path, '[^/]*$', '') || href END AS link FROM f),
k AS (SELECT *, lower(regexp_extract(link, '^(?:[^:/?#]+:)?(?://[^/?#]*)?([^?#]*)', 1)) AS low, regexp_replace(path, '/+$', '') AS idx FROM u WHERE regexp_extract(link, '//([^/?#]*)', 1) = host)
SELECT page_id, pos, link AS url, CASE WHEN regexp_matches(label, 'next|siguiente|suivant|continue|older|more|page|>>|›|»') OR regexp_matches(lower(link), '[?&](page|p)=\\d+') OR regexp_matches(low, '/(page|p)/\\d+') OR regexp_matches(label, '^\\d{{1,4}}$') THEN 'pagination'
 WHEN contains(low, 'chapter') OR regexp_matches(low, '/\\d+/?$') AND starts_with(low, idx) AND low <> idx || '/' THEN 'chapter' ELSE 'other' END AS kind FROM k""")
def link_classify(spark, sf_dir):
    return web.classified_links(table(spark, sf_dir, "pages"))


@query("title_detect", r"""
WITH t AS (SELECT page_id, regexp_replace(regexp_replace(regexp_extract(html, '(?is)<h1\b[^>]*>(.*?)</h1>', 1), '<[^>]*>', '', 'g'), '^\s+|\s+$', '', 'g') AS h1, regexp_replace(regexp_replace(regexp_extract(html, '(?is)<title\b[^>]*>(.*?)</title>', 1), '<[^>]*>', '', 'g'), '^\s+|\s+$', '', 'g') AS t FROM pages)
SELECT page_id, CASE WHEN length(h1) BETWEEN 1 AND 199 THEN h1 WHEN length(t) BETWEEN 1 AND 199 THEN t ELSE 'Chapter' END AS title FROM t""")
def title_detect(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", web.title(F.col("html")).alias("title"))


@query("main_content")
def main_content(spark, sf_dir):
    return web.chapters(table(spark, sf_dir, "pages")).select("url", "title", F.md5("content").alias("digest"), F.length("content").alias("chars"), "error")


@query("challenge_pages", "SELECT page_id, regexp_matches(lower(html), 'challenge|cloudflare|checking your browser|ddos-guard|just a moment|cf-challenge|attention required|ray id|security check') AS challenge FROM pages")
def challenge_pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", U.is_challenge(F.col("html")).alias("challenge"))


@query("chapter_range", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS number FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) BETWEEN 2 AND 5")
def chapter_range(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("number", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")))
    return rows.where(S.in_range(F.col("number"), 2, 5)).select("o_orderkey", F.col("number").cast("long").alias("number"))


@query("file_number", r"""
WITH s AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'chapter_' || p_partkey WHEN 1 THEN 'my Ep-' || p_partkey || 'b' WHEN 2 THEN p_partkey || ' intro' WHEN 3 THEN 'story' || p_partkey ELSE 'none' END AS stem FROM part)
SELECT p_partkey, coalesce(TRY_CAST(nullif(regexp_extract(stem, '(?i)(?:chapter|ch|ep|part)[_\-\s]*(\d+)', 1), '') AS INTEGER), TRY_CAST(nullif(regexp_extract(stem, '^(\d+)', 1), '') AS INTEGER), TRY_CAST(nullif(regexp_extract(stem, '(\d+)$', 1), '') AS INTEGER), 8) AS number FROM s""")
def file_number(spark, sf_dir):
    k = F.col("p_partkey")
    stem = F.when(k % 5 == 0, F.concat(F.lit("chapter_"), k)).when(k % 5 == 1, F.concat(F.lit("my Ep-"), k, F.lit("b"))).when(k % 5 == 2, F.concat(k, F.lit(" intro"))).when(k % 5 == 3, F.concat(F.lit("story"), k)).otherwise("none")
    return table(spark, sf_dir, "part").select("p_partkey", T.file_number(stem, F.lit(7)).alias("number"))


@query("renumbered_chapters", """
WITH f AS (SELECT p_brand, p_partkey, CAST(p_partkey % 40 AS INTEGER) AS number FROM part)
SELECT p_brand, p_partkey, CASE WHEN (SELECT count(DISTINCT g.number) < count(*) FROM f g WHERE g.p_brand = f.p_brand) THEN CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS INTEGER) ELSE number END AS number FROM f""")
def renumbered_chapters(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_brand", "p_partkey", (F.col("p_partkey") % 40).cast("int").alias("number"))
    return S.renumbered(rows, "p_brand", order="p_partkey")


@query("slugs", r"""
WITH p AS (SELECT p_partkey, concat(' ', p_name, ': "<A & B>" ', p_type, '? ') AS n FROM part)
SELECT p_partkey, regexp_replace(regexp_replace(lower(trim(n)), '[^\p{L}\p{N}]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, trim(translate(n, '\/:*?"<>|', '')) AS file, replace(replace(replace(n, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped, replace(replace(replace(replace(replace(n, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS quoted FROM p""")
def slugs(spark, sf_dir):
    n = F.concat(F.lit(" "), "p_name", F.lit(': "<A & B>" '), "p_type", F.lit("? "))
    return table(spark, sf_dir, "part").select("p_partkey", T.slug(n).alias("slug"), T.safe_filename(n).alias("file"), T.escape_markup(n).alias("escaped"), T.escape_markup(n, True).alias("quoted"))


@query("wav_filenames", r"""
WITH p AS (SELECT p_partkey, concat('out/', p_name, CASE p_partkey % 2 WHEN 0 THEN '.WAV' ELSE ' #' END) AS n FROM part), b AS (SELECT p_partkey, regexp_replace(regexp_replace(regexp_extract(n, '([^/\\]*)$', 1), '[^A-Za-z0-9._-]', '_', 'g'), '^[._-]+|[._-]+$', '', 'g') AS b FROM p)
SELECT p_partkey, CASE WHEN ends_with(lower(b), '.wav') THEN b ELSE b || '.wav' END AS file FROM b""")
def wav_filenames(spark, sf_dir):
    n = F.concat(F.lit("out/"), "p_name", F.when(F.col("p_partkey") % 2 == 0, ".WAV").otherwise(" #"))
    return table(spark, sf_dir, "part").select("p_partkey", T.wav_filename(n).alias("file"))


RULES = [{"pattern": "ing", "replacement": "<ING>"}, {"pattern": r"\b(th)(e|at)\b", "replacement": r"\2-\1", "is_regex": True}, {"pattern": "([", "replacement": "x", "is_regex": True}, {"pattern": "of", "replacement": "$5", "is_regex": False}, {"pattern": "zzz", "replacement": "q", "enabled": False}]


@query("override_rules", r"""
SELECT doc_id, md5(replace(replace(replace(regexp_replace(replace(text, 'ing', '<ING>'), '\b(th)(e|at)\b', '\2-\1', 'g'), 'of', '$5'), 'on', 'ON'), 'ON', 'oN')) AS digest FROM documents WHERE lang = 'en'""")
def override_rules(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id", F.md5(T.apply_rules(F.col("text"), RULES, {"on": "ON", "ON": "oN"})).alias("digest"))


@query("pronoun_rules", r"""
SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\bhe\b', 'she', 'gi'), '\bhim\b', 'her', 'gi'), '\bhis\b', 'her', 'gi'), '\bhimself\b', 'herself', 'gi')) AS digest FROM documents WHERE lang = 'en'""")
def pronoun_rules(spark, sf_dir):
    text = T.apply_rules(F.col("text"), C.pronoun_rules("male", "female"), case_sensitive=False)
    return table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id", F.md5(text).alias("digest"))


@query("text_preview", "SELECT doc_id, md5(CASE WHEN length(text) > 500 THEN substring(text, 1, 500) || '…' ELSE text END) AS digest FROM documents")
def text_preview(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.preview(F.col("text"))).alias("digest"))


@query("inventory", """
WITH o AS (SELECT o_custkey, count(*) AS raw, count(*) - 3 * count(*) FILTER (o_orderstatus = 'F') AS valid FROM orders GROUP BY 1)
SELECT o_custkey, CAST(greatest(0, raw) AS BIGINT) AS raw_chapter_count, CAST(greatest(0, valid) AS BIGINT) AS valid_chapter_count, CAST(greatest(0, valid) AS BIGINT) AS last_chapter_count FROM o""")
def inventory(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("raw"), (F.count("*") - 3 * F.count_if(F.col("o_orderstatus") == "F")).alias("valid"))
    return ledger.with_inventory(rows).select("o_custkey", "raw_chapter_count", "valid_chapter_count", "last_chapter_count")


@query("placeholder_urls", """
WITH u AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN url || '/paywalled' ELSE url END AS url FROM pages)
SELECT url, row_number() OVER (PARTITION BY page_id % 10 ORDER BY page_id) AS number, page_id % 10 AS book FROM u WHERE NOT contains(url, 'paywalled')""")
def placeholder_urls(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select((F.col("page_id") % 10).alias("book"), "page_id", F.when(F.col("page_id") % 3 == 0, F.concat("url", F.lit("/paywalled"))).otherwise(F.col("url")).alias("u"))
    lists = rows.groupBy("book").agg(F.transform(F.array_sort(F.collect_list(F.struct("page_id", "u"))), lambda x: x["u"]).alias("urls"))
    lists = lists.withColumn("urls", files.placeholder_free(F.col("urls")))
    return files.url_chapters(lists, keep=("book",)).select(F.col("source").alias("url"), F.col("number").cast("long").alias("number"), "book")


@query("settings_merge", """
SELECT o_orderkey, 'priority' AS k, o_orderpriority AS v FROM orders UNION ALL SELECT o_orderkey, 'theme', 'dark' FROM orders
UNION ALL SELECT o_orderkey, 'status', CASE o_orderstatus WHEN 'F' THEN 'done' ELSE 'open' END FROM orders""")
def settings_merge(spark, sf_dir):
    text = lambda *kv: F.create_map(*(x if isinstance(x, Column) else F.lit(x) for x in kv))
    own = text("priority", F.col("o_orderpriority"), "json_mode", "1")
    stored = F.when(F.col("o_orderstatus") == "F", F.map_concat(own, text("status", "done"))).otherwise(own)
    merged = ledger.merged_settings(text("priority", "none", "theme", "dark", "status", "open"), stored, ("json_mode",))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.explode(merged).alias("k", "v"))


@query("stage_resume", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def stage_resume(spark, sf_dir):
    return sinks.pending(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id").select("doc_id")


@query("stage_priority", """
SELECT doc_id, 'label' AS origin FROM labels UNION ALL SELECT doc_id, 'text' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def stage_priority(spark, sf_dir):
    first = table(spark, sf_dir, "labels").select("doc_id", F.lit("label").alias("origin"))
    return files.by_priority(first, table(spark, sf_dir, "documents").select("doc_id", F.lit("text").alias("origin")), keys=("doc_id",))


@query("character_upsert", """
WITH c AS (SELECT s_suppkey, lower(s_name) AS k, s_name AS name, 'unknown' AS g, 'v' || s_suppkey AS v FROM supplier WHERE s_suppkey % 2 = 0), n AS (SELECT lower(s_name) AS k, upper(s_name) AS name, CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE 'male' END AS g, CASE WHEN s_suppkey % 6 = 0 THEN 'new' ELSE '' END AS v, 'al' || s_suppkey AS a FROM supplier WHERE s_suppkey % 3 = 0)
SELECT coalesce(c.name, n.name) AS name, coalesce(nullif(n.g, ''), c.g) AS gender, coalesce(nullif(n.v, ''), c.v) AS voice, CASE WHEN n.k IS NULL THEN 'old' WHEN c.k IS NULL THEN n.a WHEN 'old' < n.a THEN 'old|' || n.a ELSE n.a || '|old' END AS aliases FROM c FULL JOIN n ON c.k = n.k""")
def character_upsert(spark, sf_dir):
    s, k = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    old = s.where(k % 2 == 0).select(F.col("s_name").alias("name"), F.lit("unknown").alias("gender"), F.concat(F.lit("v"), k).alias("voice"), F.array(F.lit("old")).alias("aliases"))
    new = s.where(k % 3 == 0).select(F.upper("s_name").alias("name"), F.when(k % 4 == 0, "").otherwise("male").alias("gender"), F.when(k % 6 == 0, "new").otherwise("").alias("voice"), F.array(F.concat(F.lit("al"), k)).alias("aliases"))
    return C.upserted(old, new).select("name", "gender", "voice", F.array_join("aliases", "|").alias("aliases"))


@query("character_remove", "SELECT s_suppkey FROM supplier WHERE s_suppkey % 5 <> 0")
def character_remove(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    gone = s.where("s_suppkey % 5 = 0").select(F.concat(F.lit(" "), F.upper("s_name"), F.lit(".")).alias("name"))
    return C.removed(s.select("s_suppkey", F.col("s_name").alias("name")), gone).select("s_suppkey")


def _scripted(answers):
    """A model whose reply to a batch goes by (conversation + batch) % 5: one of `answers` are good, all others broken."""

    def ask(system: str, user: str, name: str) -> str:
        import json

        chapter, batch = name.split("_p2b")[0], name.split("_p2b")[1].split("_")[0]
        kind = (int(chapter) + int(batch)) % 5
        if not (kind, name.rsplit("_", 1)[1]) in answers:
            return "I can't answer that."
        source = user if user.startswith("[") else next(x for x in user.split("\n") if x.startswith("SOURCE_LIST: "))[13:]
        return json.dumps({"segments": [{"id": i["id"], "type": "Dialogue", "speaker": "Ann.", "character_type": "character", "confidence": 0.9, "delimiter_type": "none"} for i in json.loads(source)]})

    return ask


def _judged(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("chapter_id"), F.col("turn").alias("pos"), F.concat_ws("_s", "conv_id", "turn").alias("segment_id"), F.when(F.col("turn") % 3 == 0, F.concat(F.lit('"'), "text", F.lit('"'))).when(F.col("turn") % 7 == 5, "  ").otherwise(F.col("text")).alias("text"), F.lit("").alias("context_before"), F.lit("").alias("context_after"))
    model, second, mender = _scripted({(0, "r0"), (1, "r1")}), _scripted({(2, "f")}), _scripted({(3, "m")})
    return dialogue.ladder(dialogue.batches(rows, 4), model, second, mender)


J_SQL = "SELECT conv_id, turn, turn // 4 AS batch, (conv_id + turn // 4) % 5 AS kind, CASE WHEN turn % 3 = 0 THEN '\"' || text || '\"' WHEN turn % 7 = 5 THEN '  ' ELSE text END AS text FROM conversations"


@query("dialogue_ladder", f"""
SELECT conv_id AS chapter_id, CAST(turn AS BIGINT) AS pos, CASE WHEN kind < 4 THEN 'dialogue' ELSE {HEUR.format(WS.format('text'))} END AS type, CASE WHEN kind < 4 THEN 'Ann' WHEN {HEUR.format(WS.format('text'))} = 'dialogue' THEN 'unknown' ELSE 'narrator' END AS speaker,
 CASE WHEN kind < 4 THEN 0.9 ELSE 0.0 END::DOUBLE AS confidence, CASE WHEN kind < 4 THEN 'ok' ELSE 'fallback' END AS llm_status, CASE WHEN kind < 4 THEN NULL ELSE 'heuristic fallback' END AS notes FROM ({J_SQL}) WHERE trim(text) <> ''""")
def dialogue_ladder(spark, sf_dir):
    return dialogue.resolved(_judged(spark, sf_dir)).select("chapter_id", "pos", "type", "speaker", "confidence", "llm_status", "notes")


@query("dialogue_diagnostics", f"""
WITH b AS (SELECT conv_id, batch, any_value(kind) AS kind, count(*) AS n FROM ({J_SQL}) GROUP BY conv_id, batch)
SELECT conv_id AS chapter_id, count(*) AS batches, CAST(coalesce(sum(n) FILTER (kind = 4), 0) AS BIGINT) AS fallback_count, bool_or(kind = 4) AS malformed_json, bool_or(kind = 4) AS needs_review, NOT bool_or(kind = 4) AS validation_passed,
 bool_or(kind = 2) AS fallback_used, bool_or(kind = 3) AS repair_succeeded, CAST(sum(CASE kind WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 4 ELSE 5 END) AS BIGINT) AS asks, round(avg(CASE kind WHEN 4 THEN 0.0 ELSE 1.0 END), 6) AS id_match_ratio FROM b GROUP BY 1""")
def dialogue_diagnostics(spark, sf_dir):
    return dialogue.diagnostics(_judged(spark, sf_dir)).drop("llm_failures").withColumn("id_match_ratio", F.round("id_match_ratio", 6))


@query("structured_lines", """
WITH s AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, turn, CASE turn % 2 WHEN 0 THEN 'dialogue' ELSE 'narration' END AS segment_type, CASE turn % 3 WHEN 0 THEN CASE turn % 2 WHEN 0 THEN 'Unknown' ELSE 'Narrator' END WHEN 1 THEN 'Bob' ELSE upper(role) END AS speaker FROM conversations WHERE conv_id % 5 <> 4),
k AS (SELECT * FROM s WHERE turn % 4 <> 3), f AS (SELECT conv_id, speaker, min(pos) AS first FROM k GROUP BY ALL), n AS (SELECT *, 'char_' || row_number() OVER (PARTITION BY conv_id ORDER BY first) AS id FROM f)
SELECT k.conv_id, CAST(k.pos AS INTEGER) AS pos, 'l' || k.turn AS line_id, segment_type, k.speaker, n.id AS character_id, 0.5::DOUBLE AS speaker_confidence FROM k JOIN n ON k.conv_id = n.conv_id AND k.speaker = n.speaker""")
def structured_lines(spark, sf_dir):
    turn = F.col("turn")
    line = F.struct(turn, F.to_json(F.struct(F.concat(F.lit("l"), turn).alias("line_id"), F.when(turn % 4 == 3, "  ").otherwise(F.concat(F.lit(" t"), turn)).alias("normalized_text"), F.when(turn % 3 == 1, " Bob ").when(turn % 3 == 2, F.upper("role")).alias("speaker_name"), F.lit("0.5").alias("speaker_confidence"), F.when(turn % 2 == 0, " Dialogue").otherwise("narrator").alias("character_type"))).alias("j"))
    listed = F.array_join(F.array_sort(F.collect_list(line))["j"], ",")
    good, k = F.concat(F.lit("["), listed, F.lit("]")), F.col("conv_id") % 5
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(good.alias("good"))
    reply = F.when(k == 0, F.col("good")).when(k == 1, F.concat(F.lit('Sure:\n{"segments": '), "good", F.lit(",}"))).when(k == 2, F.concat(F.lit("```json\n"), "good", F.lit("\n```"))).when(k == 3, F.concat(F.lit("MEND"), F.translate("good", "[]{}", "()<>"))).otherwise("nothing")
    mend = lambda raw: raw.removeprefix("MEND").translate(str.maketrans("()<>", "[]{}")) if raw.startswith("MEND") else 1 / 0
    return dialogue.lines(dialogue.parsed(rows.select("conv_id", reply.alias("reply")), repair=mend), "conv_id").drop("text", "voice_hint")


@query("canonical_speakers", f"""
WITH c AS (SELECT {NK.format('s_name')} AS k, s_name AS name, CASE s_suppkey % 2 WHEN 0 THEN 'male' ELSE 'female' END AS gender FROM supplier),
s AS (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'Supplier#' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') || ' .!' WHEN 1 THEN ' NARRATOR; ' WHEN 2 THEN '' WHEN 3 THEN 'Unknown' ELSE c_name || ',' END AS speaker FROM customer), b AS (SELECT c_custkey, regexp_replace({WS.format('speaker')}, '(\\s*[.,!?;:])+\\s*$', '') AS bare FROM s)
SELECT c_custkey, CASE WHEN lower(bare) IN ('narrator', 'unknown') THEN lower(bare) ELSE coalesce(c.name, nullif(bare, ''), 'unknown') END AS canonical_name, c.gender AS canonical_gender FROM b LEFT JOIN c ON {NK.format('bare')} = c.k""")
def canonical_speakers(spark, sf_dir):
    people = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("pos"), F.col("s_name").alias("name"), F.lit("").alias("voice"), F.when(F.col("s_suppkey") % 2 == 0, "male").otherwise("female").alias("gender"), F.array().cast("array<string>").alias("aliases"))
    k = F.col("c_custkey")
    who = F.when(k % 5 == 0, F.concat(F.lit("Supplier#"), F.lpad(k.cast("string"), 9, "0"), F.lit(" .!"))).when(k % 5 == 1, " NARRATOR; ").when(k % 5 == 2, "").when(k % 5 == 3, "Unknown").otherwise(F.concat("c_name", F.lit(",")))
    return C.canonical(table(spark, sf_dir, "customer").select("c_custkey", who.alias("speaker")), people, fuzzy_cutoff=None).select("c_custkey", "canonical_name", "canonical_gender")


@query("mention_profiles", f"""
WITH m AS (SELECT doc_id, substring(sentence, 1, 100) AS t, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM ({S_SQL}) WHERE contains(sentence, 'Alice'))
SELECT doc_id, count(*) AS mentions, md5(string_agg(t, '|' ORDER BY n) FILTER (n <= 5)) AS contexts FROM m GROUP BY doc_id""")
def mention_profiles(spark, sf_dir):
    names = table(spark, sf_dir, "documents").select("doc_id", F.lit("Alice").alias("name"))
    return N.mention_profiles(sentences(spark, sf_dir), names).select("doc_id", "mentions", F.md5(F.array_join("contexts", "|")).alias("contexts"))


#: Each text's capitalised words as its names, in the order of the alphabet.
W_SQL = f"SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[A-Z][a-z]+')) AS name FROM ({D_SQL})"


def capitalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = decorated(spark, sf_dir).select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Z][a-z]+"), F.lit(0)))).alias("name"))
    return words.withColumn("ord", F.col("name"))


@query("name_mentions", f"""
SELECT s.doc_id, name, count(*) AS sentences, CAST(sum((length(sentence) - length(replace(sentence, name, ''))) // length(name)) AS BIGINT) AS places,
       CAST(min(pos) AS INTEGER) AS first_pos, CAST(arg_min(instr(sentence, name) - 1, pos) AS INTEGER) AS first_place
FROM ({S_SQL}) s JOIN ({W_SQL}) w ON s.doc_id = w.doc_id AND contains(sentence, name) GROUP BY s.doc_id, name""")
def name_mentions(spark, sf_dir):
    found = N.mentions(sentences(spark, sf_dir), capitalised(spark, sf_dir))
    return found.groupBy("doc_id", "name").agg(F.count("*").alias("sentences"), F.sum(F.size("places")).alias("places"), F.min("pos").alias("first_pos"), F.min_by(F.col("places")[0], "pos").alias("first_place"))


@query("pronoun_usage", f"""
WITH m AS (SELECT s.doc_id, s.pos, w.name FROM ({S_SQL}) s JOIN ({W_SQL}) w ON s.doc_id = w.doc_id AND contains(sentence, name)),
f AS (SELECT doc_id, pos, min(name) AS first FROM m GROUP BY ALL),
p AS (SELECT t.doc_id, t.pos, t.p AS pronoun, count(*) AS n FROM (SELECT doc_id, pos, regexp_replace(unnest(string_split(regexp_replace({WS.format('lower(sentence)')}, '\\s+', ' ', 'g'), ' ')), '[^\\p{{L}}\\p{{N}}_]', '', 'g') AS p FROM ({S_SQL})) t JOIN (VALUES {_DIM}) d(p, c) ON t.p = d.p GROUP BY ALL),
c AS (SELECT p.doc_id, m.name, pronoun, n FROM p JOIN m USING (doc_id, pos) UNION ALL
      SELECT p.doc_id, arg_max(f.first, f.pos), any_value(pronoun), any_value(n) FROM p JOIN f ON f.doc_id = p.doc_id AND f.pos BETWEEN p.pos - 3 AND p.pos - 1
      WHERE NOT EXISTS (SELECT 1 FROM f g WHERE g.doc_id = p.doc_id AND g.pos = p.pos) GROUP BY p.doc_id, p.pos, p.pronoun)
SELECT doc_id, name, pronoun, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY ALL""")
def pronoun_usage(spark, sf_dir):
    spoken = sentences(spark, sf_dir)
    return N.pronoun_usage(spoken, capitalised(spark, sf_dir), C.pronoun_rows(spoken, "doc_id", "pos"))


@query("character_report", """
WITH p AS (SELECT conv_id, role AS name, count(*) AS n FROM conversations GROUP BY ALL), u AS (SELECT conv_id, role AS name, 'p' || turn % 3 AS pronoun, count(*) AS n FROM conversations WHERE role = 'user' GROUP BY ALL),
l AS (SELECT conv_id, name, string_agg('    ' || pronoun || ': ' || n, chr(10) ORDER BY n DESC, pronoun) AS lines FROM u GROUP BY ALL),
b AS (SELECT p.conv_id, p.name, n, 'Character: ' || p.name || chr(10) || '  Mentions: ' || n || chr(10) || '  Gender: ' || CASE p.name WHEN 'user' THEN 'female' ELSE 'Unknown' END || coalesce(chr(10) || '  Pronoun Usage:' || chr(10) || lines, '') AS block FROM p LEFT JOIN l USING (conv_id, name))
SELECT conv_id, string_agg(block, chr(10) || chr(10) ORDER BY n DESC, name) AS report FROM b GROUP BY conv_id""")
def character_report(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumnRenamed("role", "name")
    profiles = rows.groupBy("conv_id", "name").agg(F.count("*").alias("mentions")).withColumn("gender", F.when(F.col("name") == "user", "female"))
    usage = rows.where("name = 'user'").groupBy("conv_id", "name", F.concat(F.lit("p"), F.col("turn") % 3).alias("pronoun")).agg(F.count("*").alias("n"))
    return C.report(profiles, usage, "conv_id")


@query("first_characters", """
WITH r AS (SELECT s_nationkey, s_name, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS n FROM supplier) SELECT s_nationkey, count(*) AS characters, string_agg(s_name, ', ' ORDER BY n) FILTER (n <= 20) AS summary FROM r GROUP BY s_nationkey""")
def first_characters(spark, sf_dir):
    return C.first_characters(table(spark, sf_dir, "supplier").select("s_nationkey", F.col("s_suppkey").alias("pos"), F.col("s_name").alias("name")), "s_nationkey")


@query("merged_characters", """
WITH s AS (SELECT s_suppkey, s_name, 'a' || s_suppkey AS alias, CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE 'v' || s_suppkey END AS voice FROM supplier)
SELECT p.s_name AS name, CASE WHEN q.s_suppkey IS NOT NULL AND p.voice = '' THEN q.voice ELSE p.voice END AS voice, CASE WHEN q.s_suppkey IS NULL THEN p.alias ELSE array_to_string(list_sort([p.alias, q.alias, q.s_name]), '|') END AS aliases
FROM s p LEFT JOIN s q ON p.s_suppkey % 2 = 0 AND q.s_suppkey = p.s_suppkey + 1 WHERE p.s_suppkey % 2 = 0""")
def merged_characters(spark, sf_dir):
    s, k = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    people = s.select(F.col("s_name").alias("name"), F.when(k % 4 == 0, "").otherwise(F.concat(F.lit("v"), k)).alias("voice"), F.array(F.concat(F.lit("a"), k)).alias("aliases"))
    name = lambda n: F.concat(F.lit("supplier#"), F.lpad(n.cast("string"), 9, "0"))
    pairs = s.where(k % 2 == 0).select(name(k).alias("primary"), F.concat(name(k + 1), F.lit(".")).alias("secondary"))
    return C.merged_into(people, pairs.union(s.where("s_suppkey = 1").select("s_name", "s_name"))).select("name", "voice", F.array_join("aliases", "|").alias("aliases"))


@query("chapter_totals", "SELECT lang, count(*) AS discovered, count(*) FILTER (doc_id IN (SELECT doc_id FROM labels)) AS processed FROM documents GROUP BY lang")
def chapter_totals(spark, sf_dir):
    return review.totals(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "lang", chapter="doc_id")


@query("chapter_audio", """
SELECT o_orderkey, o_orderkey % 3 = 0 AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 3) AS has_audio FROM orders""")
def chapter_audio(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    timing = table(spark, sf_dir, "lineitem").where("l_linenumber = 3").select(F.col("l_orderkey").alias("o_orderkey"))
    return review.with_audio(orders, orders.where("o_orderkey % 3 = 0"), timing, "o_orderkey")


@query("timed_paragraphs", """
SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_linenumber AS DOUBLE) END AS clip_begin, l_linenumber % 2 = 0 AS has_audio FROM lineitem""")
def timed_paragraphs(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("p"), "l_linenumber").alias("paragraph_id"))
    timing = rows.where("l_linenumber % 2 = 0").select("l_orderkey", "paragraph_id", F.col("l_linenumber").cast("double").alias("clip_begin"), (F.col("l_linenumber") + 1).cast("double").alias("clip_end")).distinct()
    return review.timed_paragraphs(rows, timing, "l_orderkey").select("l_orderkey", "l_linenumber", "clip_begin", "has_audio")


@query("tidy_segments", f"""
SELECT conv_id, turn, type, CASE WHEN b = '' THEN CASE type WHEN 'narration' THEN 'narrator' ELSE 'unknown' END WHEN lower(b) IN ('narrator', 'unknown') THEN lower(b) ELSE b END AS speaker FROM (
SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'dialogue' ELSE 'narration' END AS type, CASE turn % 4 WHEN 0 THEN '' WHEN 1 THEN 'NARRATOR' ELSE role END AS b FROM conversations WHERE turn % 5 <> 2)""")
def tidy_segments(spark, sf_dir):
    turn = F.col("turn")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(turn % 5 == 2, " \t ").otherwise("x").alias("text"), F.when(turn % 3 == 0, " Dialogue ").when(turn % 3 == 1, "odd").alias("type"), F.when(turn % 4 == 1, " NARRATOR.").when(turn % 4 > 1, F.concat("role", F.lit(" !"))).alias("speaker"))
    return dialogue.tidy(rows).drop("text")


@query("resolved_links", r"""
WITH p AS (SELECT page_id, regexp_extract(url, '^[^:/?#]+://[^/?#]*') AS site, regexp_extract(url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1) AS path FROM pages),
f AS (SELECT *, CASE WHEN path = '' THEN '/' ELSE regexp_replace(path, '[^/]*$', '') END AS folder FROM p)
SELECT page_id, 'sub/' || page_id AS href, site || folder || 'sub/' || page_id AS link FROM f
UNION ALL SELECT page_id, '../up' || page_id, site || CASE WHEN folder = '/' THEN '/' ELSE regexp_replace(folder, '[^/]+/$', '') END || 'up' || page_id FROM f
UNION ALL SELECT page_id, './a/../b?x=../' || page_id, site || folder || 'b?x=../' || page_id FROM f
UNION ALL SELECT page_id, '?p=' || page_id, site || path || '?p=' || page_id FROM f
UNION ALL SELECT page_id, '/top/' || page_id || '#f', site || '/top/' || page_id || '#f' FROM f""")
def resolved_links(spark, sf_dir):
    key = F.col("page_id").cast("string")
    hrefs = F.array(F.concat(F.lit("sub/"), key), F.concat(F.lit("../up"), key), F.concat(F.lit("./a/../b?x=../"), key), F.concat(F.lit("?p="), key), F.concat(F.lit("/top/"), key, F.lit("#f")))
    rows = table(spark, sf_dir, "pages").select("page_id", "url", F.explode(hrefs).alias("href"))
    return rows.select("page_id", "href", U.resolve(F.col("href"), F.col("url")).alias("link"))


@query("inline_pages", """
WITH e AS (SELECT conv_id, turn, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS t FROM conversations)
SELECT conv_id, md5('<?xml version="1.0" encoding="utf-8"?>' || chr(10) || '<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops">' || chr(10) || '<head><title>Book</title></head>' || chr(10) || '<body>' || chr(10) || '<h1>Book</h1>' || chr(10) || string_agg('<p id="p' || turn || '">' || t || '</p>', chr(10) ORDER BY turn) || chr(10) || '</body>' || chr(10) || '</html>') AS digest FROM e GROUP BY 1""")
def inline_pages(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("pos"), "text", F.concat(F.lit("p"), "turn").alias("paragraph_id"), F.lit("Book").alias("title"))
    return sinks.inline_pages(rows, "conv_id").select("conv_id", F.md5("xhtml").alias("digest"))


@query("id_match_ratio", """
WITH b AS (SELECT conv_id, turn // 4 AS batch, count(*) FILTER (role = 'user') / count(*) AS r FROM conversations GROUP BY ALL) SELECT conv_id, round(coalesce(avg(r), 1.0), 6) AS ratio FROM b GROUP BY 1""")
def id_match_ratio(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id", F.expr("turn div 4").alias("batch")).agg((F.count_if(F.col("role") == "user") / F.count("*")).alias("r"))
    return rows.groupBy("conv_id").agg(F.round(dialogue.id_match_ratio(F.col("r")), 6).alias("ratio"))


@query("ordered_texts", "SELECT conv_id, md5(string_agg(text, chr(10) ORDER BY turn)) AS digest FROM conversations GROUP BY 1")
def ordered_texts(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.md5(sinks.ordered_join("turn", F.col("text"))).alias("digest"))


@query("chapter_pages", """
WITH e AS (SELECT conv_id, turn, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS t, role FROM conversations)
SELECT conv_id, md5('<?xml version="1.0" encoding="utf-8"?>' || chr(10) || '<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops">' || chr(10) || '<head><title>Book</title></head>' || chr(10) || '<body>' || chr(10) || '<h1>Book</h1>' || chr(10) || string_agg('<p id="p' || turn || '" class="' || role || '">' || t || '</p>', chr(10) ORDER BY turn) || chr(10) || '</body>' || chr(10) || '</html>') AS digest FROM e GROUP BY 1""")
def chapter_pages(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("pos"), "text", F.col("role").alias("type"), F.concat(F.lit("p"), "turn").alias("paragraph_id"), F.lit("Book").alias("title"))
    return sinks.chapter_pages(rows, "conv_id").select("conv_id", F.md5("xhtml").alias("digest"))


@query("emotion_windows", "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def emotion_windows(spark, sf_dir):
    return E.windowed(table(spark, sf_dir, "events")).withColumn("total", F.round("total", 4))


@query("classified_segments", f"""
WITH p AS (SELECT doc_id, unnest(parts) AS text, CAST(generate_subscripts(parts, 1) - 1 AS INTEGER) AS pos FROM (SELECT doc_id, {PAR.format('text')} AS parts FROM ({D_SQL}))), t AS (SELECT *, {HEUR.format('text')} AS type FROM p)
SELECT doc_id AS chapter_id, pos, type, CASE type WHEN 'narration' THEN 'narrator' ELSE 'unknown' END AS speaker, CAST(pos // 20 AS INTEGER) AS batch, 'ok' AS llm_status FROM t""")
def classified_segments(spark, sf_dir):
    rows = S.extract(decorated(spark, sf_dir).withColumnRenamed("doc_id", "chapter_id"))
    return classify.classified(rows, size=20).select("chapter_id", "pos", "type", "speaker", "batch", "llm_status")


@query("pass_two", f"""
WITH p AS (SELECT doc_id, unnest(parts) AS text, CAST(generate_subscripts(parts, 1) - 1 AS INTEGER) AS pos FROM (SELECT doc_id, {PAR.format('text')} AS parts FROM documents))
SELECT doc_id AS chapter_id, pos, CASE WHEN (doc_id + pos // 20) % 3 = 0 THEN 'dialogue' ELSE {HEUR.format('text')} END AS type, CASE WHEN (doc_id + pos // 20) % 3 = 0 THEN 'ok' ELSE 'fallback' END AS llm_status FROM p""")
def pass_two(spark, sf_dir):
    rows = S.extract(table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "chapter_id").select("chapter_id", "text"))
    asked = classify.prompts(rows, 20).where((F.col("chapter_id") + F.col("batch")) % 3 < 2)
    item = lambda i: F.to_json(F.struct(i.alias("id"), F.lit("dialogue").alias("type"), F.lit("X").alias("speaker"), F.lit("male").alias("gender"), *(F.lit(0.9).alias(k) for k in J.CONFIDENCES)))
    whole = F.concat(F.lit("["), F.array_join(F.transform("ids", item), ","), F.lit("]"))
    replies = asked.select("chapter_id", "batch", F.when((F.col("chapter_id") + F.col("batch")) % 3 == 0, whole).otherwise("broken").alias("reply"))
    return classify.applied(rows, replies, 20).select("chapter_id", "pos", "type", "llm_status")


@query("review_rows", """
SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS row, role AS type, role AS speaker, substring(text, 1, 80) AS preview, CAST(turn * 10 % 101 AS INTEGER) || '%' AS confidence, CASE WHEN turn % 2 = 0 THEN '!' ELSE '' END AS flag FROM conversations""")
def review_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("role").alias("type"), F.col("role").alias("speaker"), "text", (F.col("turn") * 10 % 101 / 100).alias("speaker_confidence"), (F.col("turn") % 2 == 0).alias("needs_review"))
    return review.review_rows(rows, "conv_id", order="turn")


@query("positional_zip", """
WITH a AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations), b AS (SELECT conv_id, length(text) AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE turn % 2 = 0)
SELECT a.conv_id, a.turn, CAST(b.size AS INTEGER) AS size FROM a JOIN b ON a.conv_id = b.conv_id AND a.n = b.n""")
def positional_zip(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    return review.zipped(rows.select("conv_id", "turn"), rows.where("turn % 2 = 0").select("conv_id", "turn", F.length("text").alias("size")), "conv_id", order="turn")


@query("selected_chapters", "SELECT page_id FROM pages WHERE page_id IN (SELECT doc_id FROM labels WHERE toxic = 0)")
def selected_chapters(spark, sf_dir):
    chosen = table(spark, sf_dir, "labels").where("toxic = 0").select(F.col("doc_id").alias("page_id"))
    return review.selected(table(spark, sf_dir, "pages").select("page_id"), chosen, "page_id")


@query("model_requests", """
WITH b AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'http://127.0.0.1:11434/' WHEN 1 THEN 'http://m/api/chat' WHEN 2 THEN 'http://m/api/generate' ELSE 'https://cloud/v1//' END AS base, CASE page_id % 4 WHEN 3 THEN ' OpenAI' ELSE 'own' END AS provider FROM pages)
SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'http://127.0.0.1:11434/api/chat' WHEN 3 THEN 'https://cloud/v1' ELSE base END AS url, CASE page_id % 4 WHEN 3 THEN 'cloud' WHEN 2 THEN 'prompt' ELSE 'chat' END AS style FROM b""")
def model_requests(spark, sf_dir):
    k = F.col("page_id") % 4
    base = F.when(k == 0, "http://127.0.0.1:11434/").when(k == 1, "http://m/api/chat").when(k == 2, "http://m/api/generate").otherwise("https://cloud/v1//")
    return table(spark, sf_dir, "pages").select("page_id", requests.endpoint(base, F.when(k == 3, " OpenAI").otherwise("own")).alias("e")).select("page_id", "e.url", "e.style")


@query("translation_prompts", """
SELECT doc_id, md5('Translate from ' || lang || ' to en.' || chr(10) || chr(10) || CASE WHEN lang = 'fr' THEN 'Use this glossary:' || chr(10) || 'de = of' || chr(10) || 'la = the' || chr(10) || chr(10) ELSE '' END || 'Text:' || chr(10) || text || chr(10) || chr(10) || 'Reply with JSON: {"translation": "..."}') AS digest FROM documents WHERE lang <> 'en'""")
def translation_prompts(spark, sf_dir):
    m = F.create_map(F.lit("la"), F.lit("the"), F.lit("de"), F.lit("of"))
    glossary = F.when(F.col("lang") == "fr", m).otherwise(F.create_map().cast("map<string,string>"))
    return table(spark, sf_dir, "documents").where("lang <> 'en'").select("doc_id", F.md5(requests.translation_prompt(F.col("text"), F.col("lang"), F.lit("en"), glossary)).alias("digest"))


@query("speaker_search", "SELECT s_suppkey FROM supplier WHERE contains(lower(s_name || ' al' || s_suppkey), '#00000001') OR contains(lower(s_name || ' al' || s_suppkey), 'al7') ")
def speaker_search(spark, sf_dir):
    people = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_name").alias("name"), F.array(F.concat(F.lit("al"), "s_suppkey")).alias("aliases"))
    return C.search(people, "#00000001").union(C.search(people, "AL7")).select("s_suppkey").distinct()


@query("character_context", """
SELECT s_nationkey, md5(string_agg(s_name || ' | aliases=' || CASE WHEN s_suppkey % 2 = 0 THEN 'a, b' ELSE '-' END || ' | gender=unknown | description=', chr(10) ORDER BY s_suppkey)) AS digest FROM supplier GROUP BY 1""")
def character_context(spark, sf_dir):
    none = F.array().cast("array<string>")
    rows = table(spark, sf_dir, "supplier").select("s_nationkey", F.col("s_suppkey").alias("pos"), F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(none).alias("aliases"), F.lit(None).cast("string").alias("gender"), F.lit(None).cast("string").alias("description"))
    return C.context_lines(rows, "s_nationkey").select("s_nationkey", F.md5("context").alias("digest"))


@query("alias_tidy", "SELECT s_suppkey, array_to_string(list_sort([s_name, lower(s_name), CAST(s_nationkey AS VARCHAR)]), '|') AS aliases FROM supplier")
def alias_tidy(spark, sf_dir):
    given = F.array(F.concat(F.lit(" "), "s_name", F.lit("\t")), F.lit(""), F.lower("s_name"), F.lit("  "), F.col("s_nationkey").cast("string"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.array_join(C.tidy_aliases(given), "|").alias("aliases"))


@query("overlays", """
WITH s AS (SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b, length(text) AS d FROM conversations)
SELECT conv_id, md5('<?xml version="1.0" encoding="utf-8"?>' || chr(10) || '<smil xmlns="http://www.w3.org/ns/SMIL" version="3.0">' || chr(10) || '<body><seq>' || chr(10) || string_agg('<par id="par_p' || turn || '"><text src="c.xhtml#p' || turn || '"/><audio src="c.wav" clipBegin="' || CAST(coalesce(b, 0) AS BIGINT) || '.000s" clipEnd="' || CAST(coalesce(b, 0) + d AS BIGINT) || '.000s"/></par>', chr(10) ORDER BY turn) || chr(10) || '</seq></body>' || chr(10) || '</smil>') AS digest FROM s GROUP BY 1""")
def overlays(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("pos"), F.concat(F.lit("p"), "turn").alias("paragraph_id"), F.length("text").cast("double").alias("seconds"), F.lit("c.xhtml").alias("page"), F.lit("c.wav").alias("audio"))
    return sinks.overlays(S.timed(rows, "conv_id"), "conv_id").select("conv_id", F.md5("smil").alias("digest"))


@query("flattened_audio", "SELECT name, max(path) AS path FROM (SELECT 'c' || (page_id % 7) || '.wav' AS name, page_id || '/c' || (page_id % 7) || '.wav' AS path FROM pages) GROUP BY 1")
def flattened_audio(spark, sf_dir):
    k = F.col("page_id")
    return review.flattened(table(spark, sf_dir, "pages").select(F.concat(k.cast("string"), F.lit("/c"), (k % 7).cast("string"), F.lit(".wav")).alias("path")))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment_counts(spark, sf_dir)
