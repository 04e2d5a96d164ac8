import re
from collections import Counter
from itertools import permutations

from inkwell.llm import audit


def _fails(rows, i):
    key, text, _ = rows[i]
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    copy = key is not None and any(k is not None and k < key and (t or "") == text for k, t, _ in rows)
    return {
        "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text),
        "D": any(c in "#$%&*|" for c in text), "E": copy,
    }


def _brute(rows, labels):
    """Applies every order to every document, one after another."""
    out = Counter()
    for part in {p or "" for _, _, p in rows}:
        for order in permutations("ABCDE"):
            for step, name in enumerate(order, 1):
                for column in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"):
                    out[part, "".join(order), step, column] += 0
    shapley = Counter()
    for i, (key, _, part) in enumerate(rows):
        part, fails = part or "", _fails(rows, i)
        good, toxic = (key is not None and any(k == key and row[at] == 1 for k, *row in labels) for at in (0, 1))
        for order in permutations("ABCDE"):
            gone = False
            for step, name in enumerate(order, 1):
                at = (part, "".join(order), step)
                if fails[name] and not gone:
                    out[*at, "removed"] += 1
                    out[*at, "good_lost"] += good
                    out[*at, "toxic_lost"] += toxic
                    shapley[part, name] += 1
                out[*at, "redundant"] += fails[name] and gone
                out[*at, "unique_fails"] += fails[name] and sum(fails.values()) == 1
                gone |= fails[name]
                out[*at, "kept"] += not gone
    return out, shapley


LONG = " ".join(f"word{i}" for i in range(250))
ROWS = [
    (1, LONG, "a"), (2, LONG, "b"), (3, LONG + " # x", "a"), (4, "one one one one", "a"), (5, "UPPER one", None), (6, None, ""), (7, "", "b"), (8, " \t\n\x0b\x0c\r ", "b"),
    (None, LONG, "a"), (None, None, "a"), (2, LONG, "b"), (2, "SHOUT $", "b"), (9, "é" * 97 + "ABC", "c"), (10, "é" * 98 + "AB", "c"), (11, "a\x85b c x", "c"),
    (12, " ".join(["w"] * 101 + [f"v{i}" for i in range(99)]), "c"), (13, " ".join(["w"] * 102 + [f"v{i}" for i in range(99)]), "c"), (0, "é" * 98 + "AB", "d"), (14, LONG * 60, "d"),
]
LABELS = [(1, 1, 0), (2, 0, 1), (2, 1, None), (3, 1, 1), (5, 0, 1), (9, 1, 1), (None, 1, 1), (99, 1, 1), (10, None, None)]


def test_equals_every_order_applied_to_every_document(spark):
    docs = spark.createDataFrame([(*r, 7, 1, True) for r in ROWS], "doc_id long, text string, source string, mask int, n int, good boolean")
    labels = spark.createDataFrame([(*r, "x") for r in LABELS], "doc_id long, quality int, toxic int, part string")
    got = audit.audit(docs, labels).collect()
    want, shapley = _brute(ROWS, LABELS)
    assert len(got) == 600 * len({p or "" for _, _, p in ROWS}) == len({r[:3] for r in got})
    for r in got:
        for column in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"):
            assert r[column] == want[r.part, r.filter_order, r.step, column], (r, column)
        assert r.shapley == shapley[r.part, r.filter_order[r.step - 1]]


def test_cells_are_the_counts_of_masks(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    for r in audit.cells(docs, spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")).collect():
        own = [_fails(ROWS, i) for i in range(len(ROWS)) if (ROWS[i][2] or "") == r.part]
        want = Counter(sum(f[x] << i for i, x in enumerate("ABCDE")) for f in own)
        assert r["all"] == [want[m] for m in range(32)]


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audit(docs, labels).collect() == []
    one = spark.createDataFrame([(1, "x", "s")], docs.schema)
    got = audit.audit(one, labels).collect()
    assert len(got) == 600 and all(r.shapley == (120 if r.filter_order[r.step - 1] == "A" else 0) for r in got)
