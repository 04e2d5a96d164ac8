import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from inkwell.llm import align

A, B = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
TEXTS = [
    None, "", " ", "Hello world", "  two  spaces\n\n\ttabs ", "naïve café 漢字 🙂 ünïcödé", "a▁b", "<s> </s> <|endoftext|> <unk> <0x41>", "x" * 300, "repeat after me " * 40,
    "\x00\x01 control", "é combining", "ﬁ ligature 　 wide", "Hello world", "der die das und größer 12345 67.89", "'s 't don't", " nbsp line",
]


def _plain():
    """Ids and bytes by the libraries' own interfaces, text by text."""
    import sentencepiece
    from tokenizers import Tokenizer

    one = Tokenizer.from_file(A)
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=B)
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter, n = {chr(b): b for b in keep}, 0
    for b in range(256):
        if b not in keep:
            letter[chr(256 + n)] = b
            n += 1

    def tokens(text):
        a = one.encode(" " + text, add_special_tokens=False).ids
        b = two.encode(text)
        a_bytes = [bytes(letter[c] for c in one.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(two.id_to_piece(i)[3:5], 16)]) if two.is_byte(i) else two.id_to_piece(i).replace("▁", " ").encode() for i in b]
        whole = (" " + text).encode()
        return (a, a_bytes, b, b_bytes) if text and b"".join(a_bytes) == whole == b"".join(b_bytes) else ([], [], [], [])

    return tokens


def _spans(parts):
    out, at = [], 0
    for p in parts:
        out.append((at, at + len(p)))
        at += len(p)
    return out


def _brute(texts):
    tokens, rows, counts = _plain(), [], Counter()
    for text in texts:
        a, a_bytes, b, b_bytes = tokens(text or "")
        x, y = _spans(a_bytes), _spans(b_bytes)
        links = [(i, j) for i, (f, t) in enumerate(x) for j, (g, u) in enumerate(y) if f < u and g < t]
        counts.update((a[i], b[j]) for i, j in links)
        ends, groups, f, g = sorted({t for _, t in x} & {u for _, u in y}), [], 0, 0
        for end in ends:
            own = [i for (s, t), i in zip(x, a) if f < t <= end], [j for (s, t), j in zip(y, b) if f < t <= end]
            groups.append(",".join(map(str, own[0])) + "|" + ",".join(map(str, own[1])))
            f = end
        rows.append((a, b, links, ";".join(groups), len(ends)))
    best = Counter()
    for (_, j), n in counts.items():
        best[j] = max(best[j], n)
    return [(len(a), len(b), n, len(links), sum(counts[a[i], b[j]] == best[b[j]] for i, j in links), sum(counts[a[i], b[j]] for i, j in links), groups) for a, b, links, groups, n in rows]


@pytest.mark.parametrize("frequent", [align.FREQUENT_PAIRS, 20, 0])
def test_equals_a_loop_over_tokens(spark, frequent):
    docs = spark.createDataFrame([(i, t, 5, "x", 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, __row int, n_a string, pair int").repartition(3)
    got = {r.doc_id: r for r in align.align(docs, A, B, keep=("doc_id", "__row", "pair"), frequent_pairs=frequent).collect()}
    assert len(got) == len(TEXTS)
    for i, want in enumerate(_brute(TEXTS)):
        assert tuple(got[i][3:]) == want, TEXTS[i]
        assert got[i][1:3] == (5, 1)


def test_query_over_documents(spark, tmp_path):
    from inkwell.llm.q_align import op13_tokenizer_alignment

    rows = [(i % 14 if i != 4 else None, t, "s") for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = Counter(map(tuple, op13_tokenizer_alignment(spark, str(tmp_path)).collect()))
    sha = lambda g: hashlib.sha256(g.encode()).hexdigest() if g else ""
    assert got == Counter((r[0], *w[:-1], sha(w[-1])) for r, w in zip(rows, _brute(TEXTS)))


def test_units_are_cut_where_no_token_goes_across(monkeypatch):
    texts = [(t or "").encode() for t in TEXTS] + [b"word  gap \n mixed  space don't stop 1 2 3 's x " * 30, "a\u2003b c d \u00a0 e \x1c f".encode()]
    whole, units, small = (align.Pair(A, B) for _ in range(3))
    whole.cut = lambda text: [text]
    monkeypatch.setattr(align, "MOST_CALL", 3)
    want = whole.encode(texts)
    assert all((x[0].tolist(), x[1].tolist()) == (y[0].tolist(), y[1].tolist()) for x, y in zip(want, units.encode(texts)))
    monkeypatch.setattr(align, "MOST_UNITS", 5)
    got = [small.encode([t])[0] for t in texts + texts]
    assert all((x[0].tolist(), x[1].tolist()) == (y[0].tolist(), y[1].tolist()) for x, y in zip(want + want, got))


def test_invalid_bytes_have_no_tokens():
    assert [len(x) for x in align.Pair(A, B).encode([b"ok", b"bad \xff"])[1]] == [0, 0]


def test_empty_table_and_clashing_names(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert align.align(none, A, B).collect() == []
    with pytest.raises(ValueError):
        align.align(none.withColumn("n_a", none.doc_id), A, B, keep=("doc_id", "n_a"))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 90), min_size=1, max_size=60), st.randoms())
def test_rank_select_and_links(sizes, random):
    total = sum(sizes)
    ends = sorted({*random.sample(range(1, total + 1), random.randint(0, min(total, 40))), total})
    other = np.diff([0, *ends])
    both = align.Alignment(np.array(sizes), other)
    x, y = _spans([b"." * n for n in sizes]), _spans([b"." * int(n) for n in other])
    assert sorted(zip(*map(np.ndarray.tolist, both.links()))) == [(i, j) for i, (f, t) in enumerate(x) for j, (g, u) in enumerate(y) if f < u and g < t]
    cuts = sorted({t for _, t in x} & {u for _, u in y})
    assert [r.tolist() for r in both.ranges()] == [[sum(t <= c for _, t in side) for c in cuts] for side in (x, y)]
