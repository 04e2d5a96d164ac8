import numpy as np

from inkwell.llm import toxicity


def _rows(n=120):
    words = ["meadow", "river", "lantern", "quiet", "garden", "winter", "stone", "market"]
    out = []
    for i in range(n):
        text = " ".join(words[(i * 7 + j * j) % 8] for j in range(30))
        out.append((i, text + (" you gnarfblat" if i % 3 == 0 else ""), int(i % 3 == 0)))
    return out


def test_learns_from_rows_that_are_not_held_out_and_scores_all(spark):
    rows = _rows()
    docs = spark.createDataFrame([(i, t, "x", 0.5) for i, t, _ in rows] + [(1000, None, "x", 0.1), (1001, "", "x", 0.1), (1001, "", "x", 0.1), (None, "river gnarfblats " * 3000, "y", None)], "doc_id long, text string, score string, held_out double")
    labels = spark.createDataFrame([(i, y, "z") for i, _, y in rows] + [(None, 1, ""), (5000, 1, ""), (3, None, "")], "doc_id long, toxic int, text string")
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert all((got[i] >= 0.5) == bool(y) for i, _, y in rows)
    assert got[None] >= 0.5 and got[1000] == got[1001] < 0.5
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_score_is_a_sum_over_distinct_features():
    texts, label = [t for _, t, _ in _rows()], np.array([y for *_, y in _rows()])
    model = toxicity.fit(texts, label)
    for text in [*texts[:5], "", "a", texts[0] * 400]:
        low, seen = [ord(c) for c in text.lower()], set()
        for n in toxicity.LENGTHS:
            for i in range(len(low) - n + 1):
                h = 0
                for c in low[i : i + n]:
                    h = (h * 0x100000001B3 + c) % 2**64
                seen.add(((h + n) * 0x9E3779B97F4A7C15 % 2**64) >> 64 - toxicity.BITS)
        want = 1 / (1 + np.exp(-(model.bias + sum(float(model.table[h]) for h in seen))))
        assert abs(toxicity.score_texts(model, [text])[0] - want) < 1e-9


def test_without_labels_or_with_one_class():
    assert toxicity.score_texts(toxicity.fit([], np.array([])), ["x"])[0] == 0.5
    assert toxicity.score_texts(toxicity.fit(["a"], np.array([0])), ["x"])[0] < 0.01


def test_held_out_is_a_remainder_of_crc32(spark):
    import zlib

    rows = spark.range(200).select("id", toxicity.held_out("id").alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in rows)


def test_sample_passes_over_what_does_not_fit_and_takes_each_id_once(spark):
    rows = _rows(60)
    limit = 2 * sum(len(t) for _, t, _ in rows)
    docs = [(i, t) for i, t, _ in rows] + [(i, "x" * limit + "y") for i in range(60, 70)] + [(61, "x" * limit)] + [(7, rows[7][1])] * 500
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(i, 1) for i in range(60, 70)], "doc_id long, toxic int")
    texts, marks = toxicity.labelled_sample(spark.createDataFrame(docs, "doc_id long, text string"), labels, "toxic", {1: 60, 0: 60}, limit)
    import zlib

    want = sorted((t, y) for i, t, y in rows if zlib.crc32(str(i).encode()) % 5)
    assert sorted((t, y) for t, y in zip(texts, marks.tolist()) if len(t) < limit) == want


def test_a_feature_needs_evidence_only():
    texts, label = [t for _, t, _ in _rows(300)], np.array([y for *_, y in _rows(300)])
    assert np.count_nonzero(toxicity.fit(texts, label).table) >= len({"gnarfblat"[i : i + n] for n in toxicity.LENGTHS for i in range(10 - n)})
