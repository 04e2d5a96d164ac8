import numpy as np

from inkwell.llm import quality


def _rows(n=300):
    out = []
    for i in range(n):
        words = [f"w{(i * 31 + j * 17) % 97}" for j in range(40)]
        bad = i % 3 == 0
        out.append((i, " ".join(w + ("%%%" if bad else "") for w in words), int(not bad)))
    return out


def test_rules_separate_and_the_column_equals_numpy(spark):
    rows = _rows()
    docs = spark.createDataFrame([(i, t, 7.0) for i, t, _ in rows] + [(900, None, 1.0), (901, "", 1.0), (901, "", 1.0), (None, "a%%% " * 50000, None)], "doc_id long, text string, s_log_bytes double")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (3, None)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    assert 0 < len(model.rules) < 80
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    assert all((got[i] >= 0.3) == bool(y) for i, _, y in rows)
    assert got[None] < 0.3 and got[900] == got[901]
    table = np.array([quality.statistics(t.encode()) for _, t, _ in rows])
    assert np.allclose(model.scores(table), [got[i] for i, *_ in rows])
    assert quality.score(docs.limit(0), model).count() == 0


def test_a_rule_is_the_conjunction_of_its_path():
    rng = np.random.default_rng(3)
    table = np.zeros((2000, len(quality.STATISTICS)))
    table[:, :3] = rng.random((2000, 3))
    label = ((table[:, 0] > 0.5) & (table[:, 1] <= 0.5)).astype(float)
    model = quality.fit(table, label)
    assert ((model.scores(table) > 0.5) == label).mean() > 0.97
    assert any(len(r.terms) > 1 for r, _ in model.rules)


def test_columns_of_any_name_are_kept(spark):
    rows = _rows(120)
    docs = spark.createDataFrame([(i, t, 1.0, "x") for i, t, _ in rows], "doc_id long, text string, s_log_bytes double, S_x string")
    model = quality.train(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int"))
    out = quality.score(docs, model, tuple(docs.columns), "__score")
    assert out.columns == [*docs.columns, "__score"] and {r.s_log_bytes for r in out.collect()} == {1.0}


def _plain_statistics(text):
    data = text.encode()
    words, lines = text.split(), text.split("\n")
    letters = [c for c in text if c.isascii() and c.isalpha()]
    n, size = max(1, len(words)), max(1, len(data))
    marks = [w for w in words if len(w) > 1 and w[-2:].isascii() and not w[-2].isalnum()]
    return [np.log1p(len(data)), np.log1p(len(words)), sum(len(w.encode()) for w in words) / n, len(set(words)) / n, max((words.count(w) for w in words), default=0) / n, sum(a == b for a, b in zip(words, words[1:])) / n, sum(c.isupper() for c in letters) / max(1, len(letters)), sum(c in "0123456789" for c in text) / size, sum(c in "#$%&*+/<=>@\\^_`{|}~" for c in text) / size, text.count("|") / size, text.count("!") / size, len(marks) / n, np.log1p(len(lines)), 1 - len(set(lines)) / len(lines), len(letters) / size, sum(b >= 128 for b in data) / size]


def test_statistics_equal_plain_ones():
    rng = np.random.default_rng(4)
    signs = list("abcXYZ019 .,!|#%&\n\t-") + ["é", "ß", "!!", "the ", "the "]
    for _ in range(300):
        text = "".join(rng.choice(signs, rng.integers(0, 80)))
        assert np.allclose(quality.statistics(text.encode()), _plain_statistics(text)), repr(text)


def test_paths_of_a_tree_split_where_the_squared_error_falls_most():
    rng = np.random.default_rng(9)
    table = rng.random((200, 3)).round(2)
    label = (table[:, 1] > 0.4) * 1.0 + rng.normal(0, 0.1, 200)
    edges = [np.unique(np.quantile(table[:, i], np.linspace(0.02, 0.98, 49))) for i in range(3)]
    bins = np.stack([np.searchsorted(e, table[:, i], "left") for i, e in enumerate(edges)], 1)
    found, leaves = [], []
    quality._grow(table, edges, bins, label, np.arange(200), 1, [], found, leaves)
    best = min(((sum(((p - p.mean()) ** 2).sum() for p in (label[table[:, i] <= e], label[table[:, i] > e])), i, e) for i in range(3) for e in edges[i] if min((table[:, i] <= e).sum(), (table[:, i] > e).sum()) >= 10))
    assert {r.terms for r in found} == {((best[1], above, float(best[2])),) for above in (False, True)}
    assert sorted(np.concatenate([rows for rows, _ in leaves]).tolist()) == list(range(200))


def test_lasso_zeroes_a_useless_feature():
    rng = np.random.default_rng(1)
    x = (rng.random((800, 2)) > 0.5).astype(float)
    weight, _ = quality.lasso(x, x[:, 0], 0.02)
    assert weight[0] > 1 and weight[1] == 0


def test_without_labels_or_with_one_class():
    empty = np.zeros((0, len(quality.STATISTICS)))
    assert quality.fit(empty, []).scores(np.zeros((1, len(quality.STATISTICS))))[0] == 0.5
    assert quality.fit(np.zeros((50, len(quality.STATISTICS))), np.ones(50)).scores(np.zeros((1, len(quality.STATISTICS))))[0] > 0.9


def test_statistics_of_small_texts():
    assert len(quality.statistics(b"")) == len(quality.STATISTICS)
    s = dict(zip(quality.STATISTICS, quality.statistics(b"AB ab ab 12!")))
    assert s["repeat_share"] == 0.25 and s["upper_share"] == 2 / 6 and s["bang_share"] == 1 / 12


def test_the_bias_is_that_of_all_labels_whatever_the_sample(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(["word%d" % k for k in rng.integers(0, 50, 30)] + ["!!!"] * int(rng.random() < (0.3 if i % 10 else 0.7))), int(i % 10 != 0)) for i in range(3000)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    monkeypatch.setattr(quality, "ROWS_GOOD", 200)
    monkeypatch.setattr(quality, "ROWS_BAD", 200)
    model = quality.train(docs, labels)
    table = np.array([quality.statistics(t.encode()) for _, t, _ in rows])
    assert model.rules and abs(model.scores(table).mean() - 0.9) < 0.06
