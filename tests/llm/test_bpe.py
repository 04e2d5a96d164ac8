import base64
import hashlib

import public_tokenizers as P
import pytest

from inkwell.llm import bpe
from inkwell.llm.q_bpe import digests

TOKENS = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(TOKENS), special_tokens={})


TEXTS = [None, "", " ", "\n\n  \t", "Hello, world! it's 2024", "aaaaaaa aaaa aaaaaaaaaaaaaaaaaaaaaaa", "日本語 テキスト — ünïcödé 😀😀😀", "x\x1cy\x85z 　 q", "<|endoftext|> plain", "a" * 5000 + " " * 300, "word " * 20000, "½ ² Ⅷ ٣ ੩", "￾​́e"]


def test_ids_are_those_of_the_library(spark, library):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(4, TEXTS[4])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = digests(df).collect()
    assert len(out) == len(rows)
    for row in out:
        text = TEXTS[row.doc_id] or ""
        ids = library.encode_ordinary(text)
        assert row.n_tokens == len(ids), text[:50]
        assert row.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_empty_table_and_clashing_columns(spark):
    assert digests(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    df = spark.createDataFrame([(1, "a b", "x", 5)], "doc_id long, text string, ids string, n_tokens int")
    assert [r.n_tokens for r in digests(df).collect()] == [2]


def test_replay_equals_plain_loop_also_where_a_merge_makes_a_lower_rank():
    ranks = {bytes([i]): i for i in range(256)}
    for word in (b"ab", b"xab", b"abc", b"cab", b"aa", b"aaa", b"aab", b"bc", b"xabc"):
        ranks[word] = len(ranks)
    ranks[b"abc"], ranks[b"ab"] = ranks[b"ab"], ranks[b"abc"]  # ab + c now has a lower rank than ab
    replay = bpe.MergeReplay(ranks)
    words = [b"abc", b"xabc", b"aaaaab", b"aabcaabc", b"", b"z", b"abcabcaaaabcab", b"cabxabcaa"]
    ids, counts = replay.encode(words)
    at = 0
    for word, n in zip(words, counts):
        assert ids[at : at + n].tolist() == replay.one(word), word
        at += n


def test_blocks_do_not_change_the_ids(library):
    encoder = bpe.Encoder(bpe.load_ranks(TOKENS), P.PATTERN, cache_words=3)
    for text in ("one two three four", "two three five", "six seven", "one"):
        assert encoder.block([text])[0].tolist() == library.encode_ordinary(text)
    assert base64.b64decode(b"YQ==") == b"a"


def test_decode_is_the_way_back(spark):
    df = spark.createDataFrame([(1, "Hello, wörld"), (2, None), (3, "")], "doc_id long, text string")
    back = bpe.decode(bpe.encode(df, TOKENS, P.PATTERN), TOKENS)
    assert {r.doc_id: bytes(r.decoded).decode() for r in back.collect()} == {1: "Hello, wörld", 2: "", 3: ""}
