"""Language-model scoring by a hashed maximum-entropy model.

Word counts are gathered over the whole training corpus. The most frequent words (a bounded table) travel with
the tasks; the counts of all others reach the documents by a shuffle join, so no vocabulary is held in one place
and no frequent word is a hot key. The model predicts each token from hashed features of the two words before it:
a bias, the previous word, the one before that alone (a skip), and the pair. Its softmax is factored into the
yes-no choices of a Huffman tree; each feature has a hashed weight at each choice. Leaves are the frequent words
and buckets of all others by hash, whose number grows with the words. A word of a bucket has the bucket's
probability times its smoothed share in it, so probabilities of all words sum to one.

A gradient update goes over all training rows: every task sums each weight's gradient and curvature. The tables,
cut into blocks, are added up in Spark in groups of bounded size, and each weight moves by a damped Newton step. As
sums are taken at the same weights everywhere, the model does not depend on how the rows are split, but for rounding. Weights of one feature at four levels of the tree lie side by side, so a path touches few cache lines.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import repeat
from zlib import crc32

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import ascii_words, materialize, mix, text_bytes

#: Words that the tasks know by themselves; bound of outcome numbers (0 is none); most buckets of all other words.
HEAD_WORDS, OUTCOMES, MOST_BUCKETS = 1 << 17, 1 << 20, 1 << 19
#: Words to a bucket; hashed weights of a corpus of a million tokens (2^19) and at most (they travel with every task).
BUCKET_WORDS, WEIGHT_BITS, MOST_WEIGHT_BITS = 4, 19, 24
#: Gradient updates over all training rows, curvature that a step is shrunk by, the part of it that is taken, and the largest step.
ROUNDS, SHRINK, DAMP, MOST_MOVE = 1, 4.0, 0.6, 6.0
#: Weights are whole numbers of 1 / UNIT: three of them add up within 16 bits.
UNIT = 512
#: Tokens and events that are worked on at once, levels of the tree side by side, blocks of an update, tables added up at once, words counted at once.
STEP_TOKENS, CHUNK, LEVELS, BLOCKS, ADDED, COUNTED = 100_000, 1 << 15, 5, 512, 64, 300_000
#: The end of a text: words are not empty.
END = b""


def word_counts(documents: DataFrame, text: str = "text") -> DataFrame:
    """(word binary, c long): occurrences of every word over all rows, and of the end of a text (the empty word)."""

    def run(batches: Iterator):
        import pyarrow as pa

        def out(counts):
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "c"])

        counts: Counter = Counter()
        for batch in batches:
            texts = batch.column(0)
            for i in range(len(texts)):
                counts.update(ascii_words(texts[i].as_py()))
                if len(counts) >= COUNTED:
                    yield out(counts)
                    counts = Counter()
            if len(texts):
                counts[END] += len(texts)
        if counts:
            yield out(counts)

    return documents.select(text_bytes(text)).mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Tree:
    """A canonical Huffman code: code and length of each outcome (length -1: not an outcome), and where the nodes of a depth begin."""

    code: np.ndarray
    length: np.ndarray
    base: np.ndarray  # node number = base[depth] + prefix of the code
    nodes: int


def huffman(mass: np.ndarray) -> tuple[Tree, np.ndarray]:
    """The tree over outcomes 1, 2, ... with these masses, and each node's log odds of way 1."""
    n = len(mass)
    order = np.argsort(mass, kind="stable")
    weight, parent = [*mass[order].tolist(), *[0.0] * (n - 1)], [0] * (2 * n - 1)
    leaf, inner = 0, n
    for new in range(n, 2 * n - 1):
        for _ in range(2):
            if leaf < n and (inner >= new or weight[leaf] <= weight[inner]):
                least, leaf = leaf, leaf + 1
            else:
                least, inner = inner, inner + 1
            weight[new] += weight[least]
            parent[least] = new
    depth = [0] * (2 * n - 1)
    for i in range(2 * n - 3, -1, -1):
        depth[i] = depth[parent[i]] + 1
    length = np.empty(n, np.int64)
    length[order] = depth[:n]
    canonical = np.argsort(length, kind="stable")
    deepest = int(length.max())
    count = np.bincount(length, minlength=deepest + 1)
    first, base, begin, nodes = 0, np.zeros(deepest + 1, np.int64), 0, 0
    code, levels = np.zeros(n, np.int64), []
    for d in range(deepest + 1):
        here = canonical[begin : begin + count[d]]
        begin += int(count[d])
        code[here] = first + np.arange(len(here))
        base[d] = nodes - (first + len(here))
        inner = (1 << d) - first - len(here)
        levels.append((here, nodes, inner))
        nodes += inner
        first = (first + len(here)) << 1
    odds, below = np.zeros(nodes), np.zeros(0)
    for here, begin, inner in reversed(levels):
        pairs = below.reshape(-1, 2)
        odds[begin : begin + inner] = np.log(pairs[:, 1]) - np.log(pairs[:, 0])
        below = np.concatenate([mass[here], pairs.sum(1)])
    return Tree(np.append(0, code), np.append(-1, length).astype(np.int8), base, nodes), odds


@dataclass
class Model:
    head: dict[bytes, int]  # word -> number by falling count; word i is outcome i + 1
    counts: np.ndarray
    total: int  # training tokens
    distinct: int  # training words
    buckets: int  # a power of two; bucket b is outcome len(head) + b + 1
    bucket_log: np.ndarray  # log10 of each bucket's smoothed total
    tree: Tree
    bits: int
    weights: np.ndarray  # 2^bits hashed weights, int16, in parts of 1 / UNIT
    odds: np.ndarray  # the bias of each node
    blank: bool = True  # whether all weights are 0


def start(counts: DataFrame) -> Model:
    """A model that knows the head and predicts outcomes by their shares."""
    sums = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    # The head is every word at least as frequent as a cut, the lowest that leaves no more than HEAD_WORDS words.
    steps = F.when(F.col("c") < 4096, F.col("c")).otherwise(F.floor(4096 * (F.log2("c") - 11)))
    cut, size = None, 0
    for row in counts.groupBy(steps.alias("s")).agg(F.min("c").alias("c"), F.count("*").alias("n")).orderBy(F.desc("c")).collect():
        size += row.n
        if size > HEAD_WORDS:
            break
        cut = row.c
    in_head = F.col("c") >= cut if cut is not None else F.lit(False)
    top = counts.where(in_head).toPandas().sort_values(["c", "word"], ascending=[False, True])
    known = top["c"].to_numpy(np.int64)
    buckets = 1
    while buckets < MOST_BUCKETS and buckets * BUCKET_WORDS < int(sums["v"]) - len(known):
        buckets *= 2
    tail = counts.where(~in_head).groupBy((F.crc32("word") % buckets).alias("b")).agg(F.sum("c").alias("c"), F.count("*").alias("v")).toPandas()
    c, v = np.zeros(buckets), np.zeros(buckets)
    c[tail["b"].to_numpy(np.int64)], v[tail["b"].to_numpy(np.int64)] = tail["c"].to_numpy(float), tail["v"].to_numpy(float)
    tree, odds = huffman(np.concatenate([known, c]) + 0.5)
    total = int(sums["n"])
    bits = min(MOST_WEIGHT_BITS, max(18, WEIGHT_BITS + (max(1, total) >> 20).bit_length() // 2))
    return Model({bytes(w): i for i, w in enumerate(top["word"])}, known, total, int(sums["v"]), buckets, np.log10(c + 0.5 * (v + 1)), tree, bits, np.zeros(1 << bits, np.int16), odds.astype(np.float32))


def outcomes(model: Model, words: list[bytes]) -> np.ndarray:
    """Numbers of a text's words and its end: places in the head, then buckets of all other words."""
    numbers = np.fromiter(map(model.head.get, [*words, END], repeat(-1)), np.int64, len(words) + 1)
    for i in np.flatnonzero(numbers < 0).tolist():
        numbers[i] = len(model.head) + (crc32(words[i] if i < len(words) else END) & (model.buckets - 1))
    return numbers


def events(numbers: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """One integer for each token: outcome, previous outcome, the one before it. Before a text stands outcome 0."""
    own = np.where(numbers < OUTCOMES - 1, numbers + 1, 0)
    first = np.concatenate([[0], own[:-1]])
    second = np.concatenate([[0, 0], own[:-2]])[: len(own)]
    first[starts] = 0
    second[starts] = 0
    after = starts + 1
    second[after[after < len(own)]] = 0
    return (second * OUTCOMES + first) * OUTCOMES + own


def features(keys: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Outcomes and, for each kind of feature but the bias, its hash."""
    own = keys % OUTCOMES
    pair = keys // OUTCOMES
    first, second = pair % OUTCOMES, pair // OUTCOMES
    return own, [mix(((kind << 60) + what).astype(np.uint64)) for kind, what in ((1, first), (2, second), (3, pair))]


class Paths:
    """The choices of events, level by level: events are sorted by the length of their path, so a level is a slice."""

    def __init__(self, model: Model, keys: np.ndarray):
        own, hashes = features(keys)
        own = np.where(own < len(model.tree.length), own, 0)
        length = model.tree.length[own]
        order = np.argsort(-length, kind="stable")
        self.order = order[: np.count_nonzero(length > 0)]
        length = length[self.order].astype(np.uint64)
        self.model = model
        self.code = model.tree.code[own[self.order]].view(np.uint64) << np.uint64(64) - length  # the first way is the highest bit
        self.hashes = [h[self.order] for h in hashes]
        self.reach = np.searchsorted(-length.astype(np.int64), -np.arange(length.max(initial=0), dtype=np.int64), "left").tolist()

    def __iter__(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[np.ndarray]]]:
        """For each level: how many events reach it, the way taken, the logit of way 1 and the weights' places."""
        model, u = self.model, np.uint64
        shift, turns = u(64 - model.bits), u((1 << LEVELS) - 1)
        for depth, n in enumerate(self.reach):
            prefix = self.code[:n] >> u(64 - depth) if depth else np.zeros(n, np.uint64)
            node = prefix.view(np.int64) + model.tree.base[depth]
            if depth % LEVELS == 0:
                root = node.view(np.uint64) * u(0x9E3779B97F4A7C15)
                # The leading bits name a run of 2^LEVELS weights, the next ones turn the order within it.
                runs = [((h[:n] ^ root) * u(0xBF58476D1CE4E5B9)) >> shift for h in self.hashes]
            below = u(1 << depth % LEVELS)
            slot = below + (prefix & (below - u(1)))
            places = [(run[:n] ^ slot).view(np.int64) for run in runs]
            logit = model.odds.take(node)
            if not model.blank:
                first, *others = (model.weights.take(at) for at in places)
                logit += sum(others, first) * np.float32(1 / UNIT)
            yield n, ((self.code[:n] >> u(63 - depth)) & u(1)).astype(np.float32), logit, places


def log10_probability(model: Model, keys: np.ndarray) -> np.ndarray:
    """Of outcomes; those without a leaf have none (-300)."""
    out = np.full(len(keys), -300.0)
    for begin in range(0, len(keys), CHUNK):
        paths = Paths(model, keys[begin : begin + CHUNK])
        logs = np.zeros(len(paths.order))
        for n, way, logit, _ in paths:
            logit *= 1 - 2 * way
            logs[:n] -= np.maximum(logit, 0) + np.log1p(np.exp(-np.abs(logit)))
        out[begin + paths.order] = logs / np.log(10)
    return out


class Gradients:
    """Sums over one task's events at the shared weights: gradients and curvatures of the log likelihood."""

    def __init__(self, model: Model):
        self.model, self.tokens = model, 0
        self.sums = np.zeros(len(model.weights), np.complex64)  # both numbers of a weight side by side

    def add(self, keys: np.ndarray) -> None:
        self.tokens += len(keys)
        keys, counts = np.unique(keys, return_counts=True)
        counts = counts.astype(np.float32)
        for begin in range(0, len(keys), CHUNK):
            paths = Paths(self.model, keys[begin : begin + CHUNK])
            some = counts[begin : begin + CHUNK][paths.order]
            value = np.empty(len(some), np.complex64)
            for n, way, logit, places in paths:
                chance = 1 / (1 + np.exp(-logit))
                value.real[:n] = some[:n] * (way - chance)
                value.imag[:n] = some[:n] * (chance * (1 - chance))
                for at in places:
                    np.add.at(self.sums, at, value[:n])

    def tables(self) -> np.ndarray:
        """Two rows: gradients, curvatures."""
        return np.stack([self.sums.real, self.sums.imag])


def steps(tables: np.ndarray) -> np.ndarray:
    """How far each weight moves, in the weights' unit: a damped Newton step, shrunk towards none where there is little evidence."""
    gradient, curvature = tables.astype(np.float64)
    return np.rint(np.clip(DAMP * gradient / (curvature + SHRINK), -MOST_MOVE, MOST_MOVE) * UNIT).astype(np.int16)


def _batches_of_events(model: Model, batches: Iterator) -> Iterator[tuple[list, list[int], np.ndarray, np.ndarray, np.ndarray]]:
    """Texts in groups of about STEP_TOKENS tokens: the rows' places in the batch, their words, numbers, starts and events."""
    for batch in batches:
        texts = batch.column("__text")
        places, words, numbers, size = [], [], [], 0
        for i in range(len(texts)):
            words.append(ascii_words(texts[i].as_py()))
            numbers.append(outcomes(model, words[-1]))
            places.append(i)
            size += len(numbers[-1])
            if size >= STEP_TOKENS or i + 1 == len(texts):
                flat = np.concatenate(numbers)
                starts = np.cumsum([0, *map(len, numbers[:-1])])
                yield batch, places, words, flat, starts
                places, words, numbers, size = [], [], [], 0


def train(documents: DataFrame, model: Model, text: str = "text", rounds: int = ROUNDS) -> Model:
    """The model after `rounds` gradient updates, each over all rows of documents.

    A task sends 4 bytes for each weight, so tasks are joined until each has about as many tokens as there are weights.
    """
    spark = documents.sparkSession
    rows = documents.select(text_bytes(text).alias("__text"))
    most = max(spark.sparkContext.defaultParallelism, model.total >> model.bits)
    rows = rows.coalesce(most)
    schema = "block int, task long, data binary"
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(model)

        def run(batches: Iterator, shared=shared):
            import pyarrow as pa
            from pyspark import TaskContext

            task = TaskContext.get().partitionId()

            def out(sums):
                for number, part in enumerate(np.array_split(_rounded(sums.tables()), BLOCKS, axis=1)):
                    yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([task], pa.int64()), pa.array([part.tobytes()], pa.binary())], ["block", "task", "data"])

            sums = Gradients(shared.value)
            for _, _, _, flat, starts in _batches_of_events(shared.value, batches):
                sums.add(events(flat, starts))
            if sums.tokens:
                yield from out(sums)

        tables = rows.mapInArrow(run, schema)
        tasks = most
        while tasks > ADDED:  # at most some ADDED tables of a block are in one place
            tables = tables.groupBy("block", F.floor(F.col("task") / ADDED).alias("group")).applyInArrow(_added, schema)
            tasks = -(-tasks // ADDED)
        parts = sorted(tables.groupBy("block").applyInArrow(_moved, "block int, data binary").collect(), key=lambda r: r.block)
        if parts:
            moved = model.weights.astype(np.int32) + np.concatenate([np.frombuffer(r.data, np.int16) for r in parts])
            model = replace(model, weights=np.clip(moved, -(1 << 13), 1 << 13).astype(np.int16), blank=False)
        shared.unpersist()
    return model


def _rounded(tables: np.ndarray) -> np.ndarray:
    """The upper half of float32 numbers, rounded to 8 bits of precision."""
    bits = tables.astype(np.float32).view(np.uint32)
    return ((bits + 0x7FFF + ((bits >> 16) & 1)) >> 16).astype(np.uint16)


def _sum_of(table) -> np.ndarray:
    total = None
    for data in table.column("data"):
        part = (np.frombuffer(data.as_buffer(), np.uint16).astype(np.uint32) << 16).view(np.float32).reshape(2, -1)
        total = part.astype(np.float64) if total is None else total + part
    return total


def _added(key, table):
    import pyarrow as pa

    return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int64()), pa.array([_rounded(_sum_of(table)).tobytes()], pa.binary())], names=["block", "task", "data"])


def _moved(key, table):
    import pyarrow as pa

    return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([steps(_sum_of(table)).tobytes()], pa.binary())], names=["block", "data"])


def score(documents: DataFrame, counts: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """Columns `keep`, n_tokens, n_known, train_tokens (long), base_score and score (double) of every row's whole text.

    Tokens are the words and one end; a null or empty text has the end alone. base_score is the sum of
    log10((c + 0.5) / (N + 0.5 (V + 1))) over tokens; score is the model's log10 probability of the text.
    Repeated rows stay; an empty table gives an empty result, and without training rows nothing is known.
    """
    from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructType

    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(model)
    schema = StructType([documents.schema[k] for k in keep])
    for name, kind in (("__row", "long"), ("__tokens", "long"), ("__head", "long"), ("__log_head", "double"), ("__log_buckets", "double"), ("__model", "double"), ("__words", ArrayType(BinaryType())), ("__ns", ArrayType(IntegerType()))):
        schema = schema.add(name, kind)

    def run(batches: Iterator):
        import pyarrow as pa
        from pyspark import TaskContext

        model = shared.value
        size = len(model.head)
        log = np.append(np.log10(model.counts + 0.5), 0.0)
        row = TaskContext.get().partitionId() << 40
        for batch, places, words, flat, starts in _batches_of_events(model, batches):
            keys, back = np.unique(events(flat, starts), return_inverse=True)
            sums = lambda v: np.add.reduceat(v, starts)
            tail = flat >= size
            logs = log[np.minimum(flat, size)]
            shares = np.where(tail, model.bucket_log[np.maximum(flat - size, 0)], 0)
            tails = []
            for w, begin in zip(words, starts.tolist()):
                unknown = np.flatnonzero(tail[begin : begin + len(w)])
                tails.append(Counter([w[i] for i in unknown.tolist()]))
            n = len(places)
            sliced = batch.slice(places[0], n)
            columns = [np.arange(row, row + n), np.diff(np.append(starts, len(flat))), sums((~tail).astype(np.int64)), sums(logs), sums(shares), sums(log10_probability(model, keys)[back])]
            row += n
            yield pa.RecordBatch.from_arrays([*(sliced.column(k) for k in keep), *map(pa.array, columns), pa.array([list(t) for t in tails], pa.list_(pa.binary())), pa.array([list(t.values()) for t in tails], pa.list_(pa.int32()))], schema.names)

    passed = materialize(documents.select(*keep, text_bytes(text).alias("__text")).mapInArrow(run, schema))
    tail = passed.select("__row", F.explode(F.arrays_zip("__words", "__ns")).alias("t")).select("__row", F.col("t.__words").alias("word"), F.col("t.__ns").alias("n"))
    counted = tail.join(counts, "word", "left")
    value = F.log10(F.coalesce("c", F.lit(0)) + 0.5) * F.col("n")
    found = counted.groupBy("__row").agg(F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).cast("long").alias("__tail_known"), F.sum(value).alias("__log_tail"))
    out = passed.drop("__words", "__ns").join(found, "__row", "left")
    tail_log = F.coalesce("__log_tail", F.lit(0.0))
    base = float(np.log10(model.total + 0.5 * (model.distinct + 1)))
    return out.select(
        *keep,
        F.col("__tokens").alias("n_tokens"),
        (F.col("__head") + F.coalesce("__tail_known", F.lit(0))).alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("__log_head") + tail_log - base * F.col("__tokens")).alias("base_score"),
        (F.col("__model") + tail_log - F.col("__log_buckets")).alias("score"),
    )


def learnt(doc_id: str = "doc_id") -> Column:
    """Whether a row is learnt from: crc32(doc_id as text) mod 5 is not 1. Null ids are learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 != 1, F.lit(True))


def fit_and_score(documents: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Scores every row by a model of the rows that are learnt from; see `score` for the columns.

    Null texts are learnt as empty ones, rows with a null id are learnt from, and repeated rows count as often as
    they stand there. Ties of words in frequency go to the word that sorts first. Other columns are not read.
    """
    training = documents.where(learnt())
    counts = materialize(word_counts(training))
    return score(documents, counts, train(training, start(counts)), keep)
