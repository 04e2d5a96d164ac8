import hashlib
from collections import Counter

import pytest

from inkwell.llm import sharding


def _brute(rows, limit):
    """Splits an oversized bucket by its next bit, again and again."""
    def h(key, text):
        inner = hashlib.md5((text or "").encode()).hexdigest()
        return bin(int("1" + hashlib.md5(f"{'' if key is None else key}|{inner}".encode()).hexdigest()[:15], 16))[3:]

    def split(bucket, depth):
        total = sum(len((t or "").encode()) for _, _, t in bucket)
        if total <= limit or depth == 60:
            return [(k, b[:depth], total) for k, b, _ in bucket]
        return [x for bit in "01" if (part := [r for r in bucket if r[1][depth] == bit]) for x in split(part, depth + 1)]

    return Counter(split([(k, h(k, t), t) for k, t in rows], 0)) if rows else Counter()


ROWS = [(i, "x" * (i * 37 % 91)) for i in range(400)] + [(None, None), (None, ""), (None, "n" * 50), (7, "dup" * 30)] + [(8, "same" * 20)] * 5 + [(9, "é" * 900)]


@pytest.mark.parametrize("limit,bits", [(300, 12), (300, 3), (10**6, 12), (50, 7)])
def test_equals_recursive_splitting(spark, limit, bits):
    df = spark.createDataFrame([(*r, 1, "q") for r in ROWS], "doc_id long, text string, bytes int, cell string")
    out = sharding.shards(df, limit, round_bits=bits).collect()
    assert Counter((r.doc_id, r.shard, r.shard_bytes) for r in out) == _brute(ROWS, limit)
    assert all(r.fits == (r.shard_bytes <= limit) and r.depth == len(r.shard) for r in out)


def test_empty_table(spark):
    assert sharding.shards(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_shards_are_written_whole(spark, tmp_path):
    df = spark.createDataFrame([(*r, i % 3, "c") for i, r in enumerate(ROWS)], "doc_id long, text string, bytes int, cell string")
    sharding.write_shards(df, f"file://{tmp_path}/s", 3000)
    back = spark.read.option("basePath", f"file://{tmp_path}/s").schema("doc_id long, text string, bytes int, cell string, shard string").parquet(f"file://{tmp_path}/s").collect()
    assert Counter((r.doc_id, r.text, r.bytes, r.cell) for r in back) == Counter(tuple(r) for r in df.collect())
    shards = sharding.shards(df, 3000).collect()
    assert Counter((r.doc_id, r.shard) for r in back) == Counter((r.doc_id, "s" + r.shard) for r in shards)
    sizes = Counter()
    for r in back:
        sizes[r.shard] += len((r.text or "").encode())
    assert sizes == {"s" + r.shard: r.shard_bytes for r in shards} and len(sizes) > 5
