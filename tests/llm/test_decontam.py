import random

import numpy as np

from inkwell.llm import decontam


def _plain(item, doc, shortest):
    """Greedy string tiling without hashes: again and again the longest match of free words."""
    free_i, free_d, out = [True] * len(item), [d >= 0 for d in doc], []
    while True:
        best = (shortest - 1, 0, 0)
        for i in range(len(item)):
            for j in range(len(doc)):
                n = 0
                while i + n < len(item) and j + n < len(doc) and free_i[i + n] and free_d[j + n] and item[i + n] == doc[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < shortest:
            return sorted(out)
        out.append((i, j, n))
        for k in range(n):
            free_i[i + k] = free_d[j + k] = False


def test_tiles_equal_plain_greedy_tiling():
    rng = random.Random(3)
    for _ in range(60):
        item = [rng.randrange(12) for _ in range(rng.randrange(1, 60))]
        doc = [rng.choice([-1, *range(12)]) for _ in range(rng.randrange(0, 60))]
        for _ in range(3):
            a, n = rng.randrange(len(item)), rng.randrange(3, 30)
            at = rng.randrange(len(doc) + 1)
            doc[at:at] = item[a : a + n]
        got = decontam.tiles(np.array(item), np.array(doc, np.int64), 4)
        want = _plain(item, doc, 4)
        assert sum(t[2] for t in got) == sum(t[2] for t in want), (item, doc)
        used_i, used_d = set(), set()
        for i, j, n in got:
            assert item[i : i + n] == doc[j : j + n] and n >= 4
            assert not used_i & {*range(i, i + n)} and not used_d & {*range(j, j + n)}
            used_i |= {*range(i, i + n)}
            used_d |= {*range(j, j + n)}


ITEM = " ".join(f"alpha{i}" for i in range(30))


def test_whole_reordered_and_partial_passages(spark):
    w = ITEM.split()
    reordered = " x y ".join([" ".join(w[20:]), " ".join(w[:10]), " ".join(w[10:20])])
    docs = [(1, f"before {ITEM.upper()} after"), (2, reordered), (3, " ".join(w[:8])), (4, "nothing of it"), (5, None), (6, ""), (7, " ".join(w[::2])), (8, "say to be or now"), (8, "say to be or now"), (None, ITEM), (9, "pad " * 30000 + ITEM)]
    df = spark.createDataFrame([(*d, 1, "m") for d in docs], "doc_id long, text string, item_id int, __matches string")
    bench = spark.createDataFrame([(10, ITEM, 2), (11, "to be or", 2), (12, None, 2), (13, "", 2), (None, ITEM, 3)], "item_id long, text string, doc_id int")
    for size in (1 << 20, 40):
        got = {}
        for row in decontam.matches(df, bench, block_bytes=size).collect():
            got.setdefault(row.doc_id, []).append(sorted(str(m.item_id) for m in row["__matches"]))
        both = [["10", "None"]]
        assert got == {1: both, 2: both, 3: [[]], 4: [[]], 5: [[]], 6: [[]], 7: [[]], 8: [["11"], ["11"]], None: both, 9: both}
    clean = decontam.decontaminate(df, bench)
    assert clean.columns == df.columns and sorted(r.doc_id for r in clean.collect()) == [3, 4, 5, 6, 7]
    assert decontam.decontaminate(df, bench.limit(0)).count() == len(docs)
    assert decontam.decontaminate(df.limit(0), bench).count() == 0


def test_whole_operator_equals_plain_tiling(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(14)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([1, 3, 5, 8, 20, 40])))) for i in range(12)]
    docs = []
    for i in range(60):
        tokens = [rng.choice(words + [f"x{k}" for k in range(30)]) for _ in range(rng.randrange(0, 40))]
        for _ in range(rng.randrange(0, 4)):
            source = rng.choice(items)[1].split()
            a, n = rng.randrange(len(source)), rng.randrange(1, 25)
            at = rng.randrange(len(tokens) + 1)
            tokens[at:at] = source[a : a + n]
        docs.append((i, " ".join(tokens)))
    items += items[:2]
    want = set()
    for d, text in docs:
        for k, item in items:
            a, b = item.split(), text.split()
            number = {w: i for i, w in enumerate(a)}
            covered = sum(t[2] for t in _plain([number[w] for w in a], [number.get(w, -1) for w in b], min(len(a), decontam.TILE_WORDS)))
            if covered >= decontam.COVERAGE * len(a):
                want.add((d, k, len(a), covered))
    bench = spark.createDataFrame(items, "item_id long, text string")
    for size in (1 << 20, 300):
        out = decontam.matches(spark.createDataFrame(docs, "doc_id long, text string"), bench, block_bytes=size).collect()
        got = [(r.doc_id, m.item_id, m.item_words, m.covered_words) for r in out for m in r["__matches"]]
        assert set(got) == want and len(got) == len(want) + sum(k in (0, 1) for _, k, *_ in want)


def test_repeated_words_stay_cheap():
    import time
    import tracemalloc

    began = time.perf_counter()
    tracemalloc.start()
    for item, text in ((b"a " * 1000, b"a " * 20000), (b"a b " * 200, b"b a " * 8000 + b"c "), (b"a b c " * 100, b"a b c " * 5000)):
        block = decontam.Block.of([("x", item)])
        (found,) = block.matches(text, 0.4)
        assert found[2] >= found[1] - 1
    assert tracemalloc.get_traced_memory()[1] < 300 << 20 and time.perf_counter() - began < 30
    tracemalloc.stop()
