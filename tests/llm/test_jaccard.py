import random
from itertools import combinations

import numpy as np
import pytest

from inkwell.llm import common, jaccard


def _set(text):
    words = common.ascii_words((text or "").encode())
    if not words:
        return frozenset()
    if len(words) < 5:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def _brute(rows):
    forest, sets = common.Forest(), [(d, _set(t)) for d, t in rows]
    for (d, a), (e, b) in combinations(sets, 2):
        if a and b and 100 * len(a & b) >= 80 * len(a | b) and None not in (d, e):
            forest.join(d, e)
    return sorted((d, len(s), forest.find(d) if d is not None else None) for d, s in sets if d is not None)


def _rows(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    base = [[rng.choice(vocabulary) for _ in range(rng.choice([3, 12, 40, 80]))] for _ in range(25)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    texts = []
    for _ in range(160):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        texts.append(" ".join(words + (passage if rng.random() < 0.3 else [])))
    hub = [rng.choice(vocabulary) + str(i) for i in range(150)]
    for _ in range(90):
        words = list(hub)
        for _ in range(rng.choice([1, 2, 3, 5, 7])):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        texts.append(" ".join(words))
    texts += [None, "", "  \t ", "ONE two", "one TWO", "one two three four five", "é é é é é", "É é é é é", "a\x0bb", "a b"] + ["same text here for all of them"] * 12
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("seed,docs", [(1, 64), (2, 7)])
def test_equals_brute_force(spark, monkeypatch, seed, docs):
    monkeypatch.setattr(jaccard, "BLOCK_DOCS", docs)
    monkeypatch.setattr(jaccard, "HOT_ROWS", 10 if seed == 2 else 1000)
    rows = _rows(seed)
    df = spark.createDataFrame([(d, t, 1, "g", 2) for d, t in rows], "doc_id long, text string, n int, g string, component_id int").repartition(5)
    out = jaccard.components(df).collect()
    assert sorted(tuple(r) for r in out) == _brute(rows)


def test_nulls_repeated_rows_and_an_empty_table(spark):
    text = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(None, text), (5, text), (5, text), (5, "other words"), (3, text), (9, None)], "doc_id long, text string")
    out = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.components(df).collect()), key=str)
    assert out == sorted([(None, 26, None), (5, 26, 3), (5, 26, 3), (5, 1, 3), (3, 26, 3), (9, 0, 9)], key=str)
    assert jaccard.components(df.limit(0)).collect() == []


def test_tree_prunes_but_loses_nothing():
    rng = np.random.default_rng(5)
    sets = []
    for _ in range(60):
        base = np.unique(rng.integers(0, 400, rng.integers(1, 90)))
        sets += [base, np.unique(np.concatenate([base[rng.random(len(base)) > 0.08], rng.integers(0, 400, 3)]))]
    sets = [s.astype(np.int32) for s in sets]
    tree = jaccard.PrefixTree(sets)
    for x in sets:
        inside = np.zeros(400, bool)
        inside[x] = True
        want = {j for j, y in enumerate(sets) if 100 * len(np.intersect1d(x, y)) >= 80 * len(np.union1d(x, y))}
        assert set(tree.probe(x, inside, lambda ids: False)) == want


def test_distinct_documents_keep_one_of_each_class(spark):
    text = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(4, text, "x"), (2, text + " end", "y"), (7, "alone", "z"), (7, "alone", "z"), (None, text, "n"), (4, "other", "o")], "doc_id long, text string, lang string")
    assert sorted((str(r.doc_id), r.lang) for r in jaccard.distinct_documents(df).collect()) == [("2", "y"), ("7", "z"), ("None", "n")]


def test_components_of_links(spark):
    rng = random.Random(4)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1100)]
    forest = common.Forest()
    for a, b in links:
        forest.join(a, b)
    got = {r.id: r.component for r in common.connected_components(spark.createDataFrame(links, "a long, b long").repartition(9)).collect()}
    assert got == {x: forest.find(x) for x in forest.parent if any(x in l and l[0] != l[1] for l in links)}
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_a_shingle_set_costs_little_more_than_its_digests():
    import time

    from xxhash import xxh3_64_intdigest

    words = [b"w%d" % (i % 250_000) for i in range(500_000)]
    plain = [xxh3_64_intdigest(w) for w in words]
    hashes = common.word_hashes(words)
    assert hashes.tolist() == plain and common.word_hashes([]).tolist() == []
    factors = common._odd(5)
    runs = sum(hashes[i : len(hashes) - 4 + i] * factors[i] for i in range(5))
    assert np.array_equal(common.shingle_set(hashes), np.unique(common.mix(runs + np.uint64(5))))

    def least(work):
        times = []
        for _ in range(3):
            begin = time.process_time()
            work()
            times.append(time.process_time() - begin)
        return min(times)

    assert least(lambda: common.shingle_set(common.word_hashes(words))) < 3 * least(lambda: [xxh3_64_intdigest(w) for w in words])
