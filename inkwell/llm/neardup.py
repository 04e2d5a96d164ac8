"""Embedding near-duplicates by an epsilon grid order join.

Unit vectors have a cosine of c or more exactly if their distance is at most epsilon = sqrt(2 - 2c), and no
orthonormal projection enlarges a distance. Vectors are sorted by the cells of side epsilon of their leading
principal components (epsilon grid order) and cut into blocks. Intervals of the sorted sequence are joined
recursively: a pair of intervals whose boxes are over epsilon apart is skipped as a whole, others are halved, down to
pairs of blocks. No group is gathered in one task, and no pair of blocks is stored: tasks read the blocks of two pieces of the
sequence where they lie, so disk grows with the vectors, not with the pairs. Equal vectors are one row
with a count, and a pair of blocks returns counts of links and a spanning forest, never all links.

The principal axes come from a bounded sample: any axes give the same links, good ones skip more.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import connected_components, discard, materialize, scratch_write

#: Vectors that the axes are fitted on, axes that order and skip, vectors of a block.
FIT_ROWS, AXES, BLOCK_ROWS = 4096, 6, 1024
#: Parts of the sequence that one task joins to all that follow.
SPAN = 8


def _matrix(blobs: list[bytes], dtype: str, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors in double precision, padded with zeros to width, and their own lengths."""
    out, sizes = np.zeros((len(blobs), width)), np.zeros(len(blobs), int)
    for i, blob in enumerate(blobs):
        vector = np.frombuffer(blob, dtype)
        sizes[i] = len(vector)
        out[i, : len(vector)] = vector
    scale = np.abs(out).max(1, initial=0)
    out /= np.where(scale > 0, scale, 1)[:, None]
    return out / np.maximum(np.linalg.norm(out, axis=1), 1e-300)[:, None], sizes


def _prepare(embeddings: DataFrame, key: str, vector: str, dtype: str) -> DataFrame:
    """(id, p, q, blob): p and q identify a valid vector's values, all three are null for vectors that link with nothing.

    It is computed where it is read: stored, the values would lie on disk once more.
    """

    def run(batches: Iterator):
        import pyarrow as pa

        for batch in batches:
            ids, prints, blobs = batch.column(0), [], []
            for i, values in enumerate(batch.column(1)):
                row = values.values
                blob = None
                if row is not None and len(row) and not row.null_count and ids[i].is_valid:
                    array = row.to_numpy().astype(dtype) + 0.0
                    if np.isfinite(array).all() and array.any():
                        blob = array.tobytes()
                blobs.append(blob)
                prints.append((None, None) if blob is None else np.frombuffer(hashlib.blake2b(blob, digest_size=16).digest(), np.int64).tolist())
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array([p[0] for p in prints], pa.int64()), pa.array([p[1] for p in prints], pa.int64()), pa.array(blobs, pa.binary())], ["id", "p", "q", "blob"])

    return embeddings.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("vector")).mapInArrow(run, "id long, p long, q long, blob binary")


def _axes(classes: DataFrame, dtype: str, width: int) -> np.ndarray:
    sample = classes.orderBy(F.xxhash64("id"), "id").limit(FIT_ROWS).select("blob").collect()
    table, _ = _matrix([bytes(r.blob) for r in sample], dtype, width)
    _, vectors = np.linalg.eigh(table.T @ table - len(table) * np.outer(table.mean(0), table.mean(0)))
    return vectors[:, ::-1][:, :AXES]


def _projected(classes: DataFrame, axes: np.ndarray, epsilon: float, dtype: str) -> DataFrame:
    k = axes.shape[1]
    schema = "id long, n long, blob binary, " + ", ".join(f"c{i} int, x{i} double" for i in range(k))

    def run(batches: Iterator):
        import pyarrow as pa

        for batch in batches:
            table, _ = _matrix(batch.column("blob").to_pylist(), dtype, len(axes))
            x = table @ axes
            cells = np.floor(x / epsilon).astype(np.int32)
            columns = [c for i in range(k) for c in (pa.array(cells[:, i]), pa.array(x[:, i]))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n"), batch.column("blob"), *columns], ["id", "n", "blob", *(f"{s}{i}" for i in range(k) for s in "cx")])

    return classes.select("id", "n", "blob").mapInArrow(run, schema)


def _blocks(ordered: DataFrame, k: int) -> DataFrame:
    """Blocks of a sorted table: part, block, box (lo, hi by axis) and the rows as ids, counts, lengths in bytes and all values in one blob."""
    schema = "part int, block int, lo array<double>, hi array<double>, ids array<long>, counts array<long>, sizes array<int>, blob binary"

    def run(batches: Iterator):
        import pyarrow as pa
        from pyspark import TaskContext

        part, block, held = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            while held.num_rows >= BLOCK_ROWS:
                yield make(pa, held.slice(0, BLOCK_ROWS), part, block)
                held, block = held.slice(BLOCK_ROWS), block + 1
        if held is not None and held.num_rows:
            yield make(pa, held, part, block)

    def make(pa, table, part, block):
        x = np.stack([table.column(f"x{i}").to_numpy() for i in range(k)], 1)
        one, blobs = lambda v, t: pa.array([v], t), table.column("blob").to_pylist()
        return pa.RecordBatch.from_arrays(
            [one(part, pa.int32()), one(block, pa.int32()), one(x.min(0), pa.list_(pa.float64())), one(x.max(0), pa.list_(pa.float64())), one(table.column("id").to_pylist(), pa.list_(pa.int64())), one(table.column("n").to_pylist(), pa.list_(pa.int64())), one([len(b) for b in blobs], pa.list_(pa.int32())), one(b"".join(blobs), pa.binary())],
            ["part", "block", "lo", "hi", "ids", "counts", "sizes", "blob"],
        )

    return ordered.mapInArrow(run, schema)


def apart(lo_a, hi_a, lo_b, hi_b, epsilon: float) -> bool:
    """Whether two boxes are provably over epsilon apart."""
    gap = np.maximum(0, np.maximum(lo_a - hi_b, lo_b - hi_a))
    return float((gap**2).sum()) > epsilon**2 * (1 + 1e-9)


def interval_pairs(lo: np.ndarray, hi: np.ndarray, epsilon: float, begin: int, end: int) -> Iterator[tuple[int, int]]:
    """Pairs (a <= b) of sequence parts, a within [begin, end), that are not provably apart, by halving intervals of the sequence."""
    stack = [((begin, end), (begin, end)), ((begin, end), (end, len(lo)))]
    while stack:
        (a, b), (c, d) = stack.pop()
        if a == b or c == d or apart(lo[a:b].min(0), hi[a:b].max(0), lo[c:d].min(0), hi[c:d].max(0), epsilon):
            continue
        if b - a == 1 and d - c == 1:
            yield a, c
        elif (a, b) == (c, d):
            m = (a + b) // 2
            stack += [((a, m), (a, m)), ((a, m), (m, b)), ((m, b), (m, b))]
        elif b - a >= d - c:
            m = (a + b) // 2
            stack += [((a, m), (c, d)), ((m, b), (c, d))]
        else:
            m = (c + d) // 2
            stack += [((a, b), (c, m)), ((a, b), (m, d))]


def _near_parts(spark, parts: list[int], lo: np.ndarray, hi: np.ndarray, epsilon: float) -> DataFrame:
    """(part_a, part_b): each task joins one interval of the sequence to all that follow; boxes are as many as parts."""
    shared = spark.sparkContext.broadcast((np.array(parts, np.int32), lo, hi))

    def run(batches: Iterator):
        import pyarrow as pa

        numbers, lo, hi = shared.value
        for batch in batches:
            for at in batch.column(0).to_pylist():
                found = np.array(list(interval_pairs(lo, hi, epsilon, at, min(at + SPAN, len(lo)))), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(numbers[found[:, 0]]), pa.array(numbers[found[:, 1]])], ["part_a", "part_b"])

    return spark.range(0, len(parts), SPAN).mapInArrow(run, "part_a int, part_b int")


def labels(near: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """For each row and each column of a matrix of links the smallest row that it reaches; len(near) for columns without links.

    Labels travel over all links at once and then to what their own label says, until nothing changes. If same, rows
    and columns are the same vectors.
    """
    none = len(near)
    rows, columns = np.arange(none), np.full(near.shape[1], none)
    r, c = np.flatnonzero(near.any(1)), np.flatnonzero(near.any(0))
    if not len(r):
        return rows, columns
    some, own = near[np.ix_(r, c)], r.astype(np.int16 if none < 1 << 15 else np.int32)
    beyond = np.iinfo(own.dtype).max
    while True:
        across = np.where(some, own[:, None], beyond).min(0)
        new = np.minimum(own, np.where(some, across[None, :], beyond).min(1))
        if same:
            new = np.minimum(new, across)
        new = new[np.searchsorted(r, new)]
        if (new == own).all():
            rows[r], columns[c] = own, across
            return rows, columns
        own = new


def _join_blocks(pairs: DataFrame, dtype: str, width: int, cosine: float) -> DataFrame:
    """kind 0: (a, b) = id and its links in a pair of blocks; kind 1: links (a, b) of a spanning forest."""

    def block(row: dict, side: str):
        ends = np.cumsum([0, *row[f"sizes_{side}"]])
        return (*_matrix([row[f"blob_{side}"][i:j] for i, j in zip(ends[:-1], ends[1:])], dtype, width), np.array(row[f"ids_{side}"]), np.array(row[f"counts_{side}"]))

    def run(batches: Iterator):
        import pyarrow as pa

        last, left = None, None
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                same, name = row["same"], (row["part_a"], row["block_a"])
                if name != last:
                    last, left = name, block(row, "a")
                a, a_size, ids_a, n_a = left
                b, b_size, ids_b, n_b = left if same else block(row, "b")
                near = np.zeros((len(a), len(b)), bool)
                for begin in range(0, len(a), 256):
                    near[begin : begin + 256] = (a[begin : begin + 256] @ b.T >= cosine) & (a_size[begin : begin + 256, None] == b_size)
                if same:
                    np.fill_diagonal(near, False)
                if not near.any():
                    continue
                sum_a, sum_b = near @ n_b, np.zeros(len(b), np.int64) if same else n_a @ near
                of_a, of_b = labels(near, same)
                links = list(zip(ids_a.tolist(), ids_a[of_a].tolist()))
                if not same:
                    links += [(i, int(ids_a[r])) for i, r in zip(ids_b.tolist(), of_b.tolist()) if r < len(a)]
                links = [x for x in links if x[0] != x[1]]
                counts = [(int(i), int(n)) for i, n in zip(ids_a, sum_a) if n] + ([] if same else [(int(i), int(n)) for i, n in zip(ids_b, sum_b) if n])
                rows = [(0, *c) for c in counts] + [(1, *x) for x in links]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())], ["kind", "a", "b"])

    return pairs.mapInArrow(run, "kind int, a long, b long")


def components(embeddings: DataFrame, cosine: float = 0.9, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, n_links, component_id, kept) for every row of embeddings.

    Vectors that are null, empty, zero, hold a null or a non-finite number, or whose key is null link with
    nothing; so do two vectors of different lengths. A null key has a null component and is not kept. Repeated
    rows are linked vectors. Other columns are not read; an empty table gives an empty result.
    """
    spark = embeddings.sparkSession
    dtype = "<f8" if embeddings.schema[vector].dataType.elementType.simpleString() == "double" else "<f4"
    epsilon = float(np.sqrt(2 - 2 * cosine))
    valued = _prepare(embeddings, key, vector, dtype)
    rows = materialize(valued.drop("blob"))
    # Values are written twice only, to meet their equals and as blocks; what else is kept of a vector is its id and print.
    heap = scratch_write(valued.where("blob is not null").groupBy("p", "q").agg(F.min("id").alias("id"), F.count("*").alias("n"), F.first("blob").alias("blob")))
    classes = spark.read.parquet(heap)
    width = classes.agg(F.max(F.octet_length("blob"))).first()[0]
    groups = rows.where("p is not null").groupBy("p", "q").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    named = groups.select("p", "q", "id", "n", F.lit(0).cast("long").alias("links"), F.col("id").alias("component"))
    if width is not None:
        width //= int(dtype[-1])
        axes = _axes(classes, dtype, width)
        k = axes.shape[1]
        order = [F.col(f"c{i}") for i in range(k)] + [F.col(f"x{i}") for i in range(k)] + [F.col("id")]
        parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        sequence = _projected(classes, axes, epsilon, dtype).repartitionByRange(parts, *order).sortWithinPartitions(*order)
        blocks = materialize(_blocks(sequence, k))
        discard(spark, heap)
        # Boxes of the parts: as many rows as parts, a setting.
        boxes = blocks.groupBy("part").agg(*(F.min(F.col("lo")[i]).alias(f"lo{i}") for i in range(k)), *(F.max(F.col("hi")[i]).alias(f"hi{i}") for i in range(k))).orderBy("part").collect()
        lo, hi = (np.array([[r[f"{s}{i}"] for i in range(k)] for r in boxes]) for s in ("lo", "hi"))
        near = _near_parts(spark, [r.part for r in boxes], lo, hi, epsilon)
        side = lambda df, s: df.select(*(F.col(c).alias(f"{c}_{s}") for c in df.columns))
        reach = near.groupBy("part_a").agg(F.collect_list("part_b").alias("reach"))  # as many rows as parts
        gap = sum((F.pow(F.greatest(F.lit(0.0), F.col("lo_a")[i] - F.col("hi_b")[i], F.col("lo_b")[i] - F.col("hi_a")[i]), 2) for i in range(k)), F.lit(0.0))
        met = F.array_contains("reach", F.col("part_b")) & ((F.col("part_a") < F.col("part_b")) | (F.col("block_a") <= F.col("block_b"))) & (gap <= epsilon**2 * (1 + 1e-9))
        # Every task reads the blocks of two pieces of the table; a join by block numbers would write a copy of both blocks for each pair.
        loaded = side(blocks, "a").join(F.broadcast(reach), "part_a").join(side(blocks, "b").hint("shuffle_replicate_nl"), met)
        same = (F.col("part_a") == F.col("part_b")) & (F.col("block_a") == F.col("block_b"))
        root = scratch_write(_join_blocks(loaded.select("part_a", "block_a", same.alias("same"), *(f"{c}_{s}" for s in "ab" for c in ("ids", "counts", "sizes", "blob"))), dtype, width, cosine), "kind")
        found = spark.read.schema("kind int, a long, b long").parquet(root)
        counts = found.where("kind = 0").groupBy(F.col("a").alias("id")).agg(F.sum("b").alias("links"))
        joined = connected_components(found.where("kind = 1").select("a", "b"))
        named = groups.join(counts, "id", "left").join(joined, "id", "left").select("p", "q", "id", "n", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "id").alias("component"))
    out = rows.join(named.withColumnRenamed("id", "first"), ["p", "q"], "left")
    component = F.when(F.col("p").isNull(), F.col("id")).otherwise(F.coalesce("component", "id"))
    return out.select(F.col("id").alias(key), F.coalesce(F.col("links") + F.col("n") - 1, F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(False)).alias("kept"))
