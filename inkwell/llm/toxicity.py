"""Toxicity by a character n-gram linear classifier whose features are scaled by naive Bayes log-count ratios.

Features are the distinct 3- to 5-grams of lower-cased characters of a whole text, hashed to a fixed table. The
ratio of a feature is the log of its smoothed share among toxic over that among other texts; a logistic
regression is fitted to presence times ratio, and the product of weight and ratio is one table of fixed size
that travels with the scoring function. Fitting uses a bounded sample of labelled rows, scoring every row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import discard, parts, scratch_write, texts_of, with_text

#: n-gram lengths, bits of the feature table.
LENGTHS, BITS = (3, 4, 5), 20
#: The fit's bounds: labelled rows of each class, and bytes of their texts.
ROWS_TOXIC, ROWS_CLEAN, FIT_BYTES = 1200, 2400, 16 << 20
#: A feature gets a weight if it stands in so many texts of the sample and its ratio is so many standard errors from 0.
LEAST_TEXTS, EVIDENCE = 4, 3.0
#: Characters that are hashed together, and rows that are held as text at once.
CHUNK, PART = 1 << 16, 200
_GAP = np.zeros(max(LENGTHS), np.uint32)


@dataclass
class Model:
    table: np.ndarray  # float32, weight times ratio by hashed feature; zero where unused
    bias: float


def _hashes(chars: np.ndarray) -> Iterator[np.ndarray]:
    """For each n-gram length, the hashed feature that starts at each character."""
    total = np.zeros(len(chars), np.uint64)
    factor = np.uint64(0x100000001B3)
    wide = chars.astype(np.uint64)
    for n in range(1, max(LENGTHS) + 1):
        total = total[: len(chars) - n + 1] * factor + wide[n - 1 :]
        if n in LENGTHS:
            yield ((total + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BITS)).astype(np.int32)


def _chunks(texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(number of the first text, all characters with gaps between texts, where each text starts and ends)."""
    parts, starts, ends, size, first = [], [], [], 0, 0
    for i, text in enumerate(texts):
        chars = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        starts.append(size)
        ends.append(size + len(chars))
        parts += [chars, _GAP]
        size += len(chars) + len(_GAP)
        if size >= CHUNK or i + 1 == len(texts):
            yield first, np.concatenate(parts), np.array(starts), np.array(ends)
            parts, starts, ends, size, first = [], [], [], 0, i + 1


def hits(texts: list[str], wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text number, feature) pairs among the wanted features, by text."""
    found = []
    for first, chars, starts, ends in _chunks(texts):
        for n, h in zip(LENGTHS, _hashes(chars)):
            at = np.flatnonzero(wanted[h])
            text = np.searchsorted(starts, at, "right") - 1
            inside = at + n <= ends[text]
            found.append((text[inside] + first).astype(np.int64) << BITS | h[at[inside]])
    pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return pairs >> BITS, pairs & ((1 << BITS) - 1)


def fit(texts: list[str], toxic: np.ndarray, penalty: float = 1e-3, steps: int = 400) -> Model:
    """Ratios, the features of enough evidence, and logistic weights by accelerated gradient steps.

    With no text of one class there is no evidence: the model gives that class's complement a score of 0 or 1/2.
    """
    size = 1 << BITS
    toxic = np.asarray(toxic, np.float64)
    if not len(texts) or toxic.min() == toxic.max():
        return Model(np.zeros(size, np.float32), 0.0 if not len(texts) else (-9.0, 9.0)[int(toxic[0])])
    every = np.ones(size, bool)
    counts = np.zeros((2, size))
    for begin in range(0, len(texts), 64):
        text, feature = hits(texts[begin : begin + 64], every)
        label = toxic[begin + text].astype(int)
        for c in (0, 1):
            counts[c] += np.bincount(feature[label == c], minlength=size)
    n = np.array([(toxic == 0).sum(), (toxic == 1).sum()])
    share = (counts + 0.5) / (n[:, None] + 1)
    ratio = np.log(share[1]) - np.log(share[0])
    error = np.sqrt((1 - share[0]) / (share[0] * n[0]) + (1 - share[1]) / (share[1] * n[1]))
    wanted = (counts.sum(0) >= LEAST_TEXTS) & (np.abs(ratio) > EVIDENCE * error)
    rows, columns = [], []
    for begin in range(0, len(texts), 64):
        text, feature = hits(texts[begin : begin + 64], wanted)
        rows.append(text + begin)
        columns.append(feature)
    used = np.flatnonzero(wanted)
    rows, columns = np.concatenate(rows), np.searchsorted(used, np.concatenate(columns))
    values = ratio[used][columns]
    weight, bias = np.zeros(len(used)), float(np.log(n[1] / n[0]))
    moment, scale = np.zeros(len(used)), np.zeros(len(used))
    momentb = scaleb = 0.0
    sample = np.where(toxic == 1, 0.5 / n[1], 0.5 / n[0])  # both classes count the same
    for step in range(1, steps + 1):
        logit = bias + np.bincount(rows, weight[columns] * values, len(texts))
        miss = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - toxic) * sample
        grad = np.bincount(columns, miss[rows] * values, len(used)) + penalty * weight / len(texts)
        gradb = miss.sum()
        moment, scale = 0.9 * moment + 0.1 * grad, 0.999 * scale + 0.001 * grad**2
        momentb, scaleb = 0.9 * momentb + 0.1 * gradb, 0.999 * scaleb + 0.001 * gradb**2
        fix1, fix2 = 1 - 0.9**step, 1 - 0.999**step
        rate = 0.05 * (1 - step / (steps + 1))
        weight -= rate * (moment / fix1) / (np.sqrt(scale / fix2) + 1e-8)
        bias -= rate * (momentb / fix1) / (np.sqrt(scaleb / fix2) + 1e-8)
    table = np.zeros(size, np.float32)
    table[used] = weight * ratio[used]
    return Model(table, float(bias))


def score_texts(model: Model, texts: list[str]) -> np.ndarray:
    text, feature = hits(texts, model.table != 0)
    logit = model.bias + np.bincount(text, model.table[feature].astype(np.float64), len(texts))
    return 1 / (1 + np.exp(-np.clip(logit, -40, 40)))


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """Whether crc32(doc_id as text) mod 5 is 0; such rows are never learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id) % 5 == 0, F.lit(False))


def training_labels(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, __label) of ids that are not held out: the largest of several labels, null labels and ids as none."""
    return labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max(label).cast("int").alias("__label"))


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, rows: dict[int, int], total_bytes: int) -> tuple[list[str], np.ndarray]:
    """Texts and labels of at most rows[value] labelled, not held-out rows of each value, and total_bytes in all.

    Which labelled rows: those whose hashed doc_id is smallest. Several labels of one doc_id count as the
    largest, null labels and ids as none; of several texts of one doc_id the one that sorts first counts. Texts are
    taken in the order of another hash as long as they fit, and one that does not fit is passed over: only the sizes
    of the chosen rows are collected first, then no more than total_bytes of text. The chosen ids are a bounded
    table and so are broadcast.
    """
    spark = documents.sparkSession
    clean = training_labels(labels, label)
    parts = [clean.where(F.col("__label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for value, n in rows.items()]
    chosen = parts[0]
    for part in parts[1:]:
        chosen = chosen.union(part)
    found = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("__text")).join(F.broadcast(chosen), "doc_id").where(F.octet_length("__text") <= total_bytes)
    path = scratch_write(found.groupBy("doc_id").agg(F.first("__label").alias("__label"), F.min("__text").alias("__text")))
    sample = spark.read.parquet(path)
    order = lambda key: (key * 0x9E3779B1 & 0xFFFFFFFF, key)
    taken, size = [], 0
    for row in sorted(sample.select("doc_id", F.octet_length("__text").alias("bytes")).collect(), key=lambda r: order(r.doc_id)):
        if size + row.bytes <= total_bytes:
            size += row.bytes
            taken.append((row.doc_id,))
    fits = sample.join(F.broadcast(spark.createDataFrame(taken, sample.select("doc_id").schema)), "doc_id").select("doc_id", "__label", "__text")
    texts = sorted(fits.collect(), key=lambda r: order(r.doc_id))
    discard(spark, path)
    return [r["__text"] for r in texts], np.array([r["__label"] for r in texts], int)


def train(documents: DataFrame, labels: DataFrame) -> Model:
    """A fit on `labelled_sample`, which says what nulls and repeated rows count as. Of other columns none is read."""
    return fit(*labelled_sample(documents, labels, "toxic", {1: ROWS_TOXIC, 0: ROWS_CLEAN}, FIT_BYTES))


def score(documents: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), out: str = "score") -> DataFrame:
    """Columns `keep` and the toxicity score (double, 0 to 1) of each row's whole text; null and empty texts get the bias alone.

    Equal texts have equal scores, repeated rows stay, and a table without rows gives none. `out` must not be in `keep`.
    """
    if out in keep:
        raise ValueError(f"{out} is a column of the documents")
    from pyspark.sql.types import DoubleType, StructType

    schema = StructType([documents.schema[k] for k in keep]).add(out, DoubleType())
    used = np.flatnonzero(model.table)
    packed = (used.astype(np.int32), model.table[used], model.bias)

    def run(batches: Iterator):
        import pyarrow as pa

        table = np.zeros(1 << BITS, np.float32)
        table[packed[0]] = packed[1]
        whole = Model(table, packed[2])
        for batch in parts(batches, PART):
            scores = score_texts(whole, texts_of(batch, keep, "text"))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(scores, pa.float64())], [*keep, out])

    return with_text(documents, keep, "text").mapInArrow(run, schema)
