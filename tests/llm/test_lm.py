import math
import zlib
from collections import Counter
from dataclasses import replace

import numpy as np
import pytest

from inkwell.llm import lm


def _rows(n=150):
    rng = np.random.default_rng(8)
    return [(i, " ".join(["the cat sat on the mat", "a dog ran off with it", "Words like these follow each other"][rng.integers(3)] for _ in range(8)) + f" rare{i % 40} one{i}") for i in range(n)]


@pytest.mark.parametrize("head", [1 << 17, 600])
def test_counts_and_base_are_exact_whatever_travels(spark, monkeypatch, head):
    monkeypatch.setattr(lm, "HEAD_WORDS", head)
    rows = _rows() + [(900, None), (901, ""), (901, ""), (902, "The\x0bCAT ünï zz zz"), (None, "cat " * 9000)]
    df = spark.createDataFrame([(*r, 1, "w") for r in rows], "doc_id long, text string, n_tokens int, word string").repartition(3)
    out = lm.fit_and_score(df).collect()
    assert len(out) == len(rows)
    words = lambda t: (t or "").encode().lower().split() + [b""]
    learnt = lambda d: d is None or zlib.crc32(str(d).encode()) % 5 != 1
    counts = Counter(w for d, t in rows if learnt(d) for w in words(t))
    total, distinct, text = sum(counts.values()), len(counts), dict(rows)
    for r in out:
        w = words(text[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(x in counts for x in w), total)
        assert abs(r.base_score - sum(math.log10((counts[x] + 0.5) / (total + 0.5 * (distinct + 1))) for x in w)) < 1e-6 * len(w)
    held = [r for r in out if not learnt(r.doc_id)]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_probabilities_sum_to_one(spark):
    df = spark.createDataFrame(_rows(60), "doc_id long, text string")
    counts = lm.word_counts(df).cache()
    model = lm.train(df, lm.start(counts))
    for context in (0, 5, 7 * lm.OUTCOMES + 3):
        keys = context * lm.OUTCOMES + np.arange(lm.OUTCOMES)
        assert abs((10 ** lm.log10_probability(model, keys)).sum() - 1) < 1e-4


def test_events_look_back_within_a_text_only():
    numbers = np.array([0, 1, 2, 3, 4, -1, 5])
    keys = lm.events(numbers, np.array([0, 3, 4]))
    o = lm.OUTCOMES
    assert [(int(k) // o // o, int(k) // o % o, int(k) % o) for k in keys] == [(0, 0, 1), (0, 1, 2), (1, 2, 3), (0, 0, 4), (0, 0, 5), (0, 5, 0), (5, 0, 6)]


def test_an_update_raises_the_probability_of_what_it_saw(spark):
    counts = lm.word_counts(spark.createDataFrame(_rows(20), "doc_id long, text string"))
    model = lm.start(counts)
    keys = np.array([(3 * lm.OUTCOMES + 2) * lm.OUTCOMES + 9] * 50 + [(1 * lm.OUTCOMES + 2) * lm.OUTCOMES + 40] * 10)
    sums = lm.Gradients(model)
    sums.add(keys)
    after = replace(model, weights=model.weights + lm.steps(sums.tables()), blank=False)
    assert (lm.log10_probability(after, keys) > lm.log10_probability(model, keys)).all()


def test_gradients_equal_plain_sums(spark):
    rng = np.random.default_rng(2)
    model = lm.start(lm.word_counts(spark.createDataFrame(_rows(40), "doc_id long, text string")))
    model = replace(model, weights=rng.integers(-900, 900, len(model.weights)).astype(np.int16), blank=False)
    keys = (rng.integers(0, 5, 300) * lm.OUTCOMES + rng.integers(0, 5, 300)) * lm.OUTCOMES + rng.integers(1, 30, 300)
    gradient, curvature, logs = Counter(), Counter(), []
    for key in keys.tolist():
        total, own, context = 0.0, key % lm.OUTCOMES, key // lm.OUTCOMES
        bits = f"{int(model.tree.code[own]):0{int(model.tree.length[own])}b}"
        for (n, way, logit, places), bit, depth in zip(lm.Paths(model, np.array([key])), bits, range(99), strict=False):
            plain = float(model.odds[model.tree.base[depth] + int(bits[:depth] or "0", 2)]) + sum(int(model.weights[at[0]]) for at in places) / lm.UNIT
            assert n == 1 and way[0] == int(bit) and abs(plain - logit[0]) < 1e-4
            chance = 1 / (1 + math.exp(-plain))
            total += math.log10(chance if way[0] else 1 - chance)
            for at in places:
                gradient[int(at[0])] += int(bit) - chance
                curvature[int(at[0])] += chance * (1 - chance)
        logs.append(total)
    sums = lm.Gradients(model)
    sums.add(keys[:120])
    sums.add(keys[120:])
    for row, want in zip(sums.tables(), (gradient, curvature)):
        assert np.allclose(row[list(want)], list(want.values()), atol=1e-3) and np.count_nonzero(row) <= len(want)
    assert np.allclose(lm.log10_probability(model, keys), logs, atol=1e-4)


def test_the_model_does_not_depend_on_the_split(spark, monkeypatch):
    monkeypatch.setattr(lm, "ADDED", 2)  # tables are added up in several levels
    rows = spark.createDataFrame(_rows(80), "doc_id long, text string")
    model = lm.start(lm.word_counts(rows))
    one, many = (lm.train(rows.repartition(n), replace(model, total=99 << 30)).weights for n in (1, 7))
    assert np.abs(one).max() > lm.UNIT and np.abs(one.astype(int) - many).max() < 0.03 * lm.UNIT


def test_empty_table(spark):
    assert lm.fit_and_score(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_every_word_is_a_context_and_an_outcome_of_its_own(spark):
    rng = np.random.default_rng(3)
    follow = rng.permutation(3000)
    rows = [(i, " ".join(f"a{k} b{follow[k]}" for k in rng.integers(0, 3000, 100))) for i in range(400)]
    out = lm.fit_and_score(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()
    held = [r for r in out if zlib.crc32(str(r.doc_id).encode()) % 5 == 1]
    # Half of the words follow from the word before them, which none of 3000 pairs of rare words hides.
    assert sum(r.score - r.base_score for r in held) / sum(r.n_tokens for r in held) > 0.3


def test_outcomes_grow_with_the_words_and_probabilities_of_all_sum_to_one(spark, monkeypatch):
    monkeypatch.setattr(lm, "HEAD_WORDS", 20)
    counts = lm.word_counts(spark.createDataFrame([(i, f"the cat sat w{i} v{i} v{i} the") for i in range(300)], "doc_id long, text string")).cache()
    model = lm.start(counts)
    assert model.buckets > 20
    words = {bytes(r.word): r.c for r in counts.collect()}
    number = {w: int(lm.outcomes(model, [w])[0]) for w in words}
    of = lambda w: len(model.head) + (zlib.crc32(w) & (model.buckets - 1)) if w not in model.head else model.head[w]
    assert all(number[w] == of(w) for w in words)
    chance = 10 ** lm.log10_probability(model, np.array([number[w] + 1 for w in words]))
    share = [1 if w in model.head else (c + 0.5) / 10 ** model.bucket_log[number[w] - len(model.head)] for w, c in words.items()]
    unseen = 10 ** lm.log10_probability(model, len(model.head) + 1 + np.arange(model.buckets)) * 0.5 / 10**model.bucket_log
    assert abs((chance * share).sum() + unseen.sum() - 1) < 1e-5
