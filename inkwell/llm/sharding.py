"""Sharding by extendible hashing, in DataFrame operations only.

A directory is indexed by the leading bits of each row's hash. Rounds of a few bits sum the bytes under every
prefix of the buckets that are still too large; a bucket is closed at the first depth where it fits its byte
limit, and only oversized buckets get further bits. The slim table (key, hash, bytes) is written once, so texts
are read a single time, and directories are ordinary tables: nothing is collected or broadcast by hand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import materialize, unused

#: Bits of a row's hash, bits that one round adds, and a shard's bytes.
HASH_BITS, ROUND_BITS, LIMIT_BYTES = 60, 12, 1 << 20


def row_hash(key: str = "doc_id", text: str = "text") -> Column:
    """The leading 60 bits of the md5 of key and text: rows that differ in either can be told apart."""
    whole = F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit("|"), F.md5(F.coalesce(F.col(text), F.lit("")))).cast("binary"))
    return F.conv(F.substring(whole, 1, HASH_BITS // 4), 16, 10).cast("long")


def _prefix(bits: int) -> Column:
    return F.shiftright("h", HASH_BITS - bits)


def directory(slim: DataFrame, limit_bytes: int = LIMIT_BYTES, round_bits: int = ROUND_BITS) -> list[tuple[int, DataFrame]]:
    """For each round, its last depth and a table (cell, depth, shard_bytes) of the cells that it closed.

    A cell is a prefix of that last depth; depth is where its bucket was closed. Buckets that do not fit even
    with all bits (one huge row, or repeated rows) are closed at the full depth.
    """
    rounds, rows, bits = [], slim, 0
    while bits < HASH_BITS:
        first, bits = bits, min(HASH_BITS, bits + round_bits)
        cells = rows.groupBy(_prefix(bits).alias("cell")).agg(F.sum("bytes").alias("bytes"))
        depths = F.explode(F.sequence(F.lit(first), F.lit(bits))).alias("depth")
        paths = materialize(cells).select("cell", "bytes", depths).withColumn("prefix", F.shiftright("cell", 0))
        paths = paths.withColumn("prefix", F.expr(f"shiftright(cell, {bits} - depth)"))
        sums = paths.groupBy("depth", "prefix").agg(F.sum("bytes").alias("shard_bytes")).where(F.col("shard_bytes") <= limit_bytes)
        fitting = paths.join(sums, ["depth", "prefix"]).groupBy("cell").agg(F.min(F.struct("depth", "shard_bytes")).alias("best"))
        closed = materialize(paths.select("cell", "bytes").distinct().join(fitting, "cell", "left").select("cell", "bytes", F.col("best.depth").alias("depth"), F.col("best.shard_bytes").alias("shard_bytes")))
        if bits >= HASH_BITS:
            closed = closed.select("cell", "bytes", F.coalesce("depth", F.lit(bits)).alias("depth"), F.coalesce("shard_bytes", "bytes").alias("shard_bytes"))
        rounds.append((bits, closed.where("depth is not null").select("cell", "depth", "shard_bytes")))
        still = closed.where("depth is null").select("cell")
        if still.isEmpty():
            break
        rows = materialize(rows.withColumn("cell", _prefix(bits)).join(still, "cell", "left_semi").drop("cell"))
    return rounds


def shards(documents: DataFrame, limit_bytes: int = LIMIT_BYTES, key: str = "doc_id", text: str = "text", round_bits: int = ROUND_BITS) -> DataFrame:
    """One row for each row of documents: key, bytes, shard (its bits as text, "" for the root), depth, shard_bytes and fits.

    A null or empty text has 0 bytes; a null key is a key. Rows alike in key and text cannot be told apart by a
    hash and stay together; where they, or one row alone, exceed the limit, fits is false. An empty table gives
    an empty result, and other columns, whatever their names, are not read.
    """
    slim = materialize(_slim(documents, key, text))
    out = _placed(slim, directory(slim, limit_bytes, round_bits), "h")
    return out.select(F.col("key").alias(key), "bytes", "shard", F.col("depth").cast("int").alias("depth"), "shard_bytes", (F.col("shard_bytes") <= limit_bytes).alias("fits"))


def _slim(documents: DataFrame, key: str, text: str) -> DataFrame:
    return documents.select(F.col(key).alias("key"), F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("bytes"), row_hash(key, text).alias("h"))


def _placed(rows: DataFrame, rounds: list[tuple[int, DataFrame]], own: str, prefix: str = "") -> DataFrame:
    """Rows whose hash is the column `own`, with <prefix>shard, depth and shard_bytes: each lies in one closed cell of one round."""
    out = None
    for bits, closed in rounds:
        shard = F.when(F.col("depth") == 0, "").otherwise(F.expr(f"lpad(bin(shiftright(cell, {bits} - depth)), depth, '0')"))
        cells = closed.select(*(value.alias(prefix + name) for name, value in (("cell", F.col("cell")), ("shard", shard), ("depth", F.col("depth")), ("shard_bytes", F.col("shard_bytes")))))
        part = rows.withColumn(f"{prefix}cell", F.shiftright(own, HASH_BITS - bits)).join(cells, f"{prefix}cell").drop(f"{prefix}cell")
        out = part if out is None else out.union(part)
    return out


def write_shards(documents: DataFrame, path: str, limit_bytes: int = LIMIT_BYTES, key: str = "doc_id", text: str = "text", folder: str = "shard") -> None:
    """Writes all rows and columns of documents to one folder <folder>=s<bits> for each shard.

    Each row carries its own hash to its shard, so rows without a key stay and repeated rows stay as often as they
    are. A folder is written by one task: a shard is within the limit or cannot be split. `folder` must not be a column.
    """
    if folder.lower() in (c.lower() for c in documents.columns):
        raise ValueError(f"{folder} is a column of the documents")
    slim = materialize(_slim(documents, key, text))
    prefix = unused("__shard", documents.columns)
    rows = _placed(documents.withColumn(f"{prefix}h", row_hash(key, text)), directory(slim, limit_bytes), f"{prefix}h", prefix)
    rows = rows.select(*documents.columns, F.concat(F.lit("s"), F.col(f"{prefix}shard")).alias(folder))
    rows.repartition(folder).write.partitionBy(folder).parquet(path)
