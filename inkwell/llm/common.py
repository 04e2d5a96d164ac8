"""What several training-data operators share: scratch tables, byte words, shingles and connected components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.sources import scratch

#: Words of a shingle and the smallest similarity of near copies, in hundredths.
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80


def materialize(df: DataFrame, partition_by: str | None = None) -> DataFrame:
    """Writes df once to the scratch folder and reads it back: cuts the lineage, survives lost executors."""
    return df.sparkSession.read.parquet(scratch_write(df, partition_by))


def scratch_write(df: DataFrame, partition_by: str | None = None) -> str:
    path = f"{scratch.root(df.sparkSession)}/inkwell-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return path


def discard(spark: SparkSession, *paths: str) -> None:
    """Deletes scratch tables that no later plan reads."""
    for path in paths:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def unused(stem: str, columns) -> str:
    """A column name that begins with stem and that none of columns begins with, whatever their case."""
    taken = {c.lower() for c in columns}
    while any(c.startswith(stem.lower()) for c in taken):
        stem = "_" + stem
    return stem


def text_bytes(text: str | Column = "text") -> Column:
    """A text's UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).cast("binary")


def text_name(keep: tuple[str, ...], text: str) -> str:
    """What with_text calls the text: its own name if it is kept, else one that no kept column has."""
    return text if text in keep else unused("__text", keep)


def with_text(documents: DataFrame, keep: tuple[str, ...], text: str) -> DataFrame:
    """Columns keep, and the text under text_name unless it is among them: a text travels to Python once."""
    return documents.select(*keep) if text in keep else documents.select(*keep, F.col(text).alias(text_name(keep, text)))


def parts(batches: Iterator, rows: int = 500) -> Iterator:
    """Short slices of Arrow batches, so that what is worked on and sent back at once stays small."""
    for batch in batches:
        for begin in range(0, batch.num_rows, rows):
            yield batch.slice(begin, rows)


def texts_of(batch, keep: tuple[str, ...], text: str) -> list[str]:
    """A slice's texts; null counts as empty."""
    return [t or "" for t in batch.column(text_name(keep, text)).to_pylist()]


def ascii_words(data: bytes) -> list[bytes]:
    """Words between ASCII white space (0x20, 0x09-0x0D), with A-Z lower-cased: bytes methods touch ASCII only."""
    return data.lower().split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes (XXH3) of words. A digest costs less than looking a word up in a table of those seen before."""
    from xxhash import xxh3_64_digest

    return np.frombuffer(b"".join(map(xxh3_64_digest, words)), ">u8").astype(np.uint64)


def _odd(n: int) -> np.ndarray:
    """n odd multipliers of a fixed sequence (SplitMix64's finaliser over 1..n)."""
    return mix(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)


@cache
def _factors(words: int) -> np.ndarray:
    return _odd(words)


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser, a bijection of 64-bit integers."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(hashes: np.ndarray, words: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of all runs of `words` words; fewer words make one shingle, none an empty set."""
    n = len(hashes)
    if not n:
        return hashes
    size = min(n, words)
    factors = _factors(words)
    total = hashes[: n - size + 1] * factors[0]
    for i in range(1, size):
        total += hashes[i : n - size + 1 + i] * factors[i]
    total = mix(total + np.uint64(size))
    total.sort()  # np.unique takes several times as long
    first = np.ones(len(total), bool)
    np.not_equal(total[1:], total[:-1], out=first[1:])
    return total[first]


def arrow_rows(batches: Iterator, *names: str) -> Iterator[tuple]:
    """Each row's values of the named columns, batch by batch."""
    for batch in batches:
        yield from zip(*(batch.column(name).to_pylist() for name in names))


class Forest:
    """Union-find over any hashable ids; the smallest id is the root."""

    def __init__(self):
        self.parent: dict = {}

    def find(self, x):
        parent = self.parent
        root = x
        while parent.setdefault(root, root) != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    def join(self, a, b) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


def _contract(batches):
    """Replaces each batch of links by a star forest with the same components."""
    import pyarrow as pa

    for batch in batches:
        forest = Forest()
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            forest.join(a, b)
        pairs = [(x, forest.find(x)) for x in forest.parent]
        pairs = [p for p in pairs if p[0] != p[1]]
        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["a", "b"])


def connected_components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component) for every id in links(a, b); component is the smallest id reachable.

    Batches of links are first contracted to star forests, then large-star and small-star steps
    alternate until nothing changes. Each step reads the table that the one before wrote, so a lost
    executor costs one step. Least neighbours are aggregated before they are shuffled.
    """
    spark = links.sparkSession
    edges = links.select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")).where("a <> b")
    path = scratch_write(edges.mapInArrow(_contract, "a long, b long").distinct())
    seen = None
    for _ in range(rounds):
        edges = spark.read.parquet(path)
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == seen or not state["n"]:
            break
        seen = state
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        middle = scratch_write(large)
        down = spark.read.parquet(middle)
        small = down.join(down.groupBy("a").agg(F.min("b").alias("m")), "a").select("b", "m", "a")
        small = small.select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        after = scratch_write(small)
        discard(spark, path, middle)
        path = after
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    edges = spark.read.parquet(path)
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).union(edges.select(F.col("b"), F.col("b")).distinct())
