import corpus_pipeline
from inkwell.llm.queries import ORACLE_SQL, QUERIES


def _write(spark, path, docs, labels, bench):
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")


def test_each_decision_takes_effect(spark, tmp_path):
    item = " ".join(f"bench{i}" for i in range(20))
    docs, labels = [], []
    for i in range(200):
        kind = i % 10
        text = " ".join(f"w{(i * 31 + j * j * 7) % 211}" for j in range(40)) + f" id{i}"
        text += {1: " gnarfblat you", 2: " " + "@@@### " * 30, 3: " " + item}.get(kind, "")
        docs.append((i, text, "en", "s", len(text)))
        labels.append((i, int(kind != 2), int(kind == 1)))
    docs += [(1000 + i, docs[0][1], "en", "s", 9) for i in range(5)] + [(2000, None, None, None, None), (2001, "", "en", "s", 0), (None, "odd row", "en", "s", 1)]
    path = f"file://{tmp_path}/t"
    _write(spark, path, docs, labels, [(1, item)])
    table = spark.read.parquet(f"{path}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        table = stage(spark, table, path).cache()
        kept[name] = {r.doc_id for r in table.select("doc_id").collect()}
        if name != "byte_bpe":
            assert table.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    every = {d[0] for d in docs}
    assert every - kept["toxicity"] == {i for i in range(200) if i % 10 == 1}
    poor = {i for i in range(200) if i % 10 == 2}
    assert poor <= kept["toxicity"] - kept["quality"] <= poor | {2000, 2001, None}
    assert kept["quality"] - kept["ngram_jaccard"] == {1000 + i for i in range(5)}
    assert kept["ngram_jaccard"] - kept["decontamination"] == {i for i in range(200) if i % 10 == 3}
    assert kept["byte_bpe"] == kept["decontamination"]
    out = corpus_pipeline.run(spark, path)
    assert {r.doc_id for r in out.collect()} == kept["byte_bpe"]


def test_empty_tables(spark, tmp_path):
    path = f"file://{tmp_path}/e"
    _write(spark, path, [], [], [])
    assert corpus_pipeline.run(spark, path).collect() == []


def test_one_query_for_each_operator():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
    assert set(ORACLE_SQL) <= set(QUERIES)


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    """Helper columns of the operators give way to the documents' own."""
    from pyspark.sql import functions as F

    extra = ("__own", "__n", "__key", "__h", "__text", "__score", "__id", "matches")
    long = " ".join(f"word{i}" for i in range(60))
    rows = [(i, f"{long} number{i // 2}" + (" awful" if i % 5 == 0 else ""), "en", "s", 9) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.select("*", *(F.lit(f"v{i}").alias(name) for i, name in enumerate(extra)))
    spark.createDataFrame([(i, int(i % 4 > 0), int(i % 5 == 0)) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "no such passage stands in any of these texts at all")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        assert all(tuple(r[c] for c in extra) == tuple(f"v{i}" for i in range(len(extra))) for r in out.collect())
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == 40
