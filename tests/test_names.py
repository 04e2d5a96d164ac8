import random
import re
from collections import Counter

from pyspark.sql import functions as F

from inkwell.operators import characters as C
from inkwell.operators import names as N


def _all(text, name):
    return [m.start() for m in re.finditer(f"(?={re.escape(name)})", text)]


def test_mentions_equal_a_loop_over_names(spark):
    """Names within names, beside and over each other, in blocks and shards smaller than the books."""
    rng = random.Random(2)
    bits = ["Ann", "Anna", "Annabel", "nab", "bel", " ", "Bo", "é", "🙂", "AnnAnn", "x"]
    rows = [(d, p, "".join(rng.choices(bits, k=rng.randint(0, 12))) or None, "z") for d in (1, 2, None) for p in range(40)]
    names = [(d, n, 0) for d in (1, 2, 3) for n in bits[: 9 if d == 1 else 4]] + [(1, "", 0), (1, None, 0), (1, "Ann", 1), (None, "Ann", 0)]
    df, dim = spark.createDataFrame(rows, "doc_id int, pos int, sentence string, name2 string"), spark.createDataFrame(names, "doc_id int, name string, pos int")
    got = Counter((r.doc_id, r.pos, r.sentence, r.name2, r.name, tuple(sorted(r.places))) for r in N.mentions(df, dim, block=7, shard=2).collect())
    own = {(d, n) for d, n, _ in names if n and d is not None}
    assert got == Counter((*row, n, tuple(_all(row[2], n))) for row in rows for d, n in own if d == row[0] and row[2] and n in row[2])


def test_a_book_with_thousands_of_names_is_scanned_once(spark):
    rng = random.Random(5)
    names = list({"".join(rng.choices("abcdefgh", k=6)).capitalize() for _ in range(4000)})
    rows = [(1, p, " ".join(rng.choices(names, k=12))) for p in range(2000)]
    df = spark.createDataFrame(rows, "doc_id int, pos int, sentence string")
    got = {r.name: r.n for r in N.mentions(df, spark.createDataFrame([(1, n) for n in names], "doc_id int, name string"), shard=1500).groupBy("name").agg(F.sum(F.size("places")).alias("n")).collect()}
    assert got == Counter(n for _, _, s in rows for n in s.split(" "))


def test_profiles_keep_the_first_contexts(spark):
    rows = [(1, p, f"{p} Ann" + (" Bob" if p % 700 == 0 else "") + "x" * 200) for p in range(1500)]
    got = {r.name: (r.mentions, r.contexts) for r in N.mention_profiles(spark.createDataFrame(rows, "doc_id int, pos int, sentence string"), spark.createDataFrame([(1, "Ann"), (1, "Bob"), (1, "Cid")], "doc_id int, name string")).collect()}
    assert got == {"Ann": (1500, [rows[p][2][:100] for p in range(5)]), "Bob": (3, [rows[p][2][:100] for p in (0, 700, 1400)])}


def test_pronouns_are_credited_as_by_a_walk(spark):
    rng = random.Random(8)
    names = ["Zoe", "Ann", "Bob"]
    rows = [(d, p, " ".join(rng.choices(["Zoe", "Ann", "Bobby", "he", "Her!", "they", "and", "it"] + ["so"] * 12, k=4))) for d in (1, 2) for p in range(60)]
    every = [(p, c) for c, ps in C.PRONOUNS.items() for p in ps]
    want = Counter()
    for d in (1, 2):
        said = [s for x, _, s in rows if x == d]
        for i, sentence in enumerate(said):
            used = [p for w in sentence.lower().split() for p, _ in every if re.sub(r"\W", "", w) == p]
            whom = [n for n in names if n in sentence]
            for back in range(i - 1, max(-1, i - 4), -1):
                whom = whom or [n for n in names if n in said[back]][:1]
            want.update((d, n, p) for n in whom for p in used)
    df = spark.createDataFrame(rows, "doc_id int, pos int, sentence string")
    dim = spark.createDataFrame([(d, n, i) for d in (1, 2) for i, n in enumerate(names)], "doc_id int, name string, ord int")
    got = N.pronoun_usage(df, dim, C.pronoun_rows(df, "doc_id", "pos")).collect()
    assert {(r.doc_id, r.name, r.pronoun): r.n for r in got} == want


def test_candidates(spark):
    texts = [(1, None), (2, ""), (3, "Ann Ann Ann met Ann. The Saint. in Rome. Ann Knight"), (3, "MR. Fox and mrs Hare"), (4, "Éa Bob-Cid é Don Eve")]
    got = [(r.doc_id, r.name, r.n, r["rank"]) for r in N.name_candidates(spark.createDataFrame(texts, "doc_id int, text string")).collect()]
    assert sorted(got) == [(3, "Ann", 5, 1), (3, "Ann Ann Ann", 1, 2), (3, "Ann Knight", 1, 3), (3, "Fox", 1, 1), (3, "Hare", 1, 2), (3, "The Saint", 1, 4), (4, "Bob", 1, 1), (4, "Cid", 1, 2), (4, "Don", 1, 3), (4, "Eve", 1, 4)]


def test_hits_come_back_as_flat_arrays(spark):
    """Hits were Python objects of a whole batch, which pandas held beside its texts."""
    from pyspark.util import PythonEvalType

    spoken = spark.createDataFrame([(d, p, f"Ann {p} Bob") for d in range(20) for p in range(5)], "doc_id int, pos int, sentence string")
    dim = spark.createDataFrame([(d, n) for d in range(20) for n in ("Ann", "Bob", "Cid")], "doc_id int, name string")
    found = N.mentions(spoken, dim)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(rf"ArrowEvalPython \[scan\(.*, {PythonEvalType.SQL_SCALAR_ARROW_UDF}\n", plan)
    assert sorted((r.doc_id, r.name, r["count"]) for r in found.groupBy("doc_id", "name").count().collect()) == [(d, n, 5) for d in range(20) for n in ("Ann", "Bob")]


def test_pronoun_usage_scans_texts_once(spark):
    spoken = spark.createDataFrame([(1, 0, "Ann he"), (1, 1, "she")], "doc_id int, pos int, sentence string")
    usage = N.pronoun_usage(spoken, spark.createDataFrame([(1, "Ann", 0)], "doc_id int, name string, ord int"), C.pronoun_rows(spoken, "doc_id", "pos"))
    assert "scan(" not in usage._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.name, r.pronoun, r.n) for r in usage.collect()) == [("Ann", "he", 1), ("Ann", "she", 1)]
