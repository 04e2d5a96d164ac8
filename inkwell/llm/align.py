"""Cross-tokenizer alignment over packed bitsets.

Texts are encoded by two tokenizers, A and B. The ends of each side's tokens are marked in a bitset over the bytes of
a block of texts, 64 to a word. Its AND holds the shared cuts, its OR the links: between two neighbouring marks of
either side lies the overlap of exactly one token of A and one of B, and each overlap lies between two such marks.
Popcounts (rank) tell how many tokens of a side end up to a byte, set bits in order (select) where; so cuts become
token ranges and marks become pairs of tokens without a search.

How often a pair of ids is linked corpus-wide is summed in tasks, then by shuffle. The most frequent pairs, at most
FREQUENT_PAIRS of them, travel to the tasks that score documents; all others are joined, which is exact: what is not
frequent stands at most as often as the least frequent of those, so no key of that join is hot.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import discard, parts, scratch_write, text_bytes, unused

#: Pairs whose counts travel to every task (17 bytes each).
FREQUENT_PAIRS = 1 << 18
#: Bytes of texts that are aligned together; units that a tokenizer gets at once; units and their characters that a worker remembers.
BLOCK_BYTES, MOST_CALL, MOST_UNITS, MOST_UNIT_CHARS = 1 << 19, 1 << 12, 600_000, 1 << 24
#: Pairs that a task adds up before it hands them on.
HELD_PAIRS = 1 << 20


class Bits:
    """A packed set of positions with rank and select."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    @classmethod
    def marks(cls, positions: np.ndarray, size: int) -> Bits:
        """Positions below size."""
        flags = np.zeros(-(-size // 64) * 64, bool)
        flags[positions] = True
        return cls(np.packbits(flags, bitorder="little").view("<u8"))

    def __and__(self, other: Bits) -> Bits:
        return Bits(self.words & other.words)

    def __or__(self, other: Bits) -> Bits:
        return Bits(self.words | other.words)

    def rank(self, positions: np.ndarray) -> np.ndarray:
        """How many members are smaller than each position."""
        word, bit = positions >> 6, (positions & 63).astype(np.uint64)
        inside = self.words[np.minimum(word, len(self.words) - 1)] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[word] + np.bitwise_count(inside)

    def select(self) -> np.ndarray:
        """All members in order."""
        return np.flatnonzero(np.unpackbits(self.words.view(np.uint8), bitorder="little"))


class Alignment:
    """Two tokenizations of the same bytes: sizes of the tokens of A and B, one after another."""

    def __init__(self, a_sizes: np.ndarray, b_sizes: np.ndarray):
        a_ends, b_ends = np.cumsum(a_sizes, dtype=np.int64), np.cumsum(b_sizes, dtype=np.int64)
        size = int(a_ends[-1]) + 1 if len(a_ends) else 1
        if len(a_ends) != 0 and a_ends[-1] != b_ends[-1]:
            raise ValueError("both sides need the same bytes")
        self.a, self.b = Bits.marks(a_ends, size), Bits.marks(b_ends, size)
        self.shared, self.either = self.a & self.b, self.a | self.b

    def ranges(self) -> tuple[np.ndarray, np.ndarray]:
        """Behind each shared cut: how many tokens of A and of B there are before it."""
        cuts = self.shared.select() + 1
        return self.a.rank(cuts), self.b.rank(cuts)

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of A and of B whose byte ranges overlap, by their places."""
        marks = self.either.select()
        return self.a.rank(marks), self.b.rank(marks)


def byte_alphabet() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes: visible Latin-1 signs for themselves, then from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


class ByteLevel:
    """Side A: a byte-level BPE of a tokenizers file; special tokens' strings are ordinary text."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        letters, vocabulary = byte_alphabet(), self.model.get_vocab(with_added_tokens=True)
        self.bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.sizes, self.cut = np.array([len(x) for x in self.bytes], np.int64), True

    def encode(self, spaced: list[str]) -> list[list[int]]:
        return [e.ids for e in self.model.encode_batch_fast(spaced, add_special_tokens=False)]


class Pieces:
    """Side B: a sentencepiece model with byte fallback, which adds the space in front itself."""

    SPACE = "▁"

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(p[1:-1], 16)]) if self.model.is_byte(i) else p.replace(self.SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.sizes = np.array([len(x) for x in self.bytes], np.int64)
        #: No piece goes on behind a word's end, so a text may be cut there.
        self.cut = not any(self.SPACE in p.lstrip(self.SPACE) for p in pieces)

    def encode(self, spaced: list[str]) -> list[list[int]]:
        return self.model.encode([s[1:] for s in spaced], num_threads=1)


class Units:
    """Ids of the units that one tokenizer has met, one after another, and whether its tokens join to the unit."""

    def __init__(self, side, kind: str):
        self.side, self.kind = side, kind
        self.forget()

    def forget(self) -> None:
        self.ids, self.counts, self.whole, self._starts = np.zeros(0, self.kind), np.zeros(0, np.int64), np.zeros(0, bool), None

    def add(self, units: list[str]) -> None:
        """Encodes units. Those without white space at their ends are joined to one text, which costs a call less a unit; if its tokens don't join to it, each goes by itself."""
        inner = np.array([bool(u) and not u[0].isspace() and not u[-1].isspace() for u in units], bool)
        joined = self._joined([u for u, i in zip(units, inner) if i])
        if joined is None:
            inner[:] = False
            joined = np.zeros(0, self.kind), np.zeros(0, np.int64)
        alone = self.side.encode([" " + u for u, i in zip(units, inner) if not i])
        fits = [b"".join(map(self.side.bytes.__getitem__, ids)) == (" " + u).encode() for ids, u in zip(alone, (u for u, i in zip(units, inner) if not i))]
        ids = np.concatenate([joined[0], np.array([i for one in alone for i in one], self.kind)])
        counts = np.concatenate([joined[1], np.array([len(one) for one in alone], np.int64)])
        order = np.argsort(np.concatenate([np.flatnonzero(inner), np.flatnonzero(~inner)]))
        whole = np.ones(len(units), bool)
        whole[~inner] = fits
        self.ids = np.concatenate([self.ids, _gathered(ids, counts, order)])
        self.counts, self.whole = np.concatenate([self.counts, counts[order]]), np.concatenate([self.whole, whole])

    def _joined(self, units: list[str]):
        """Ids of the units and how many each has; nothing if the tokens don't join to the text of all."""
        text = "".join(" " + u for u in units)
        coded = np.array(self.side.encode([text])[0] if units else [], self.kind)
        if b"".join(map(self.side.bytes.__getitem__, coded.tolist())) != text.encode():
            return None
        ends = np.cumsum([len(u.encode()) + 1 for u in units], dtype=np.int64)
        return coded, np.diff(np.searchsorted(np.cumsum(self.side.sizes[coded]), ends) + 1, prepend=0) if units else np.zeros(0, np.int64)

    def of(self, units: np.ndarray) -> np.ndarray:
        """The ids of these units in their order."""
        return _gathered(self.ids, self.counts, units, self.starts())

    def starts(self) -> np.ndarray:
        if self._starts is None or len(self._starts) != len(self.counts):
            self._starts = np.cumsum(self.counts) - self.counts
        return self._starts


def _gathered(ids: np.ndarray, counts: np.ndarray, which: np.ndarray, starts: np.ndarray | None = None) -> np.ndarray:
    """Of stretches of ids, counts of them in each, those of `which` in its order."""
    starts = np.cumsum(counts) - counts if starts is None else starts
    own = counts[which]
    return ids[np.repeat(starts[which] - (np.cumsum(own) - own), own) + np.arange(int(own.sum()))]


class _Numbered(dict):
    def __missing__(self, unit):
        value = self[unit] = len(self)
        return value


#: Where neither tokenizer joins: a single space between signs that are no white space.
_CUT = re.compile(r"(?<=\S) (?=\S)")


class Pair:
    """Both sides: ids of texts, and what can be told from ids.

    A text is cut into units at single spaces. Byte-level pre-tokens begin there, and no piece of the other side goes on
    behind a space, so the ids of the units, each with a space before it, are those of the text. A unit is encoded when it
    is met first and remembered up to a bound; so no call holds a long text unless that has no single space.
    """

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = ByteLevel(a_path), Pieces(b_path)
        self.kinds = tuple("<u2" if len(side.bytes) <= 1 << 16 else "<u4" for side in (self.a, self.b))
        self.units = tuple(Units(side, kind) for side, kind in zip((self.a, self.b), self.kinds))
        self.cut = _CUT.split if self.a.cut and self.b.cut else lambda text: [text]
        self.forget()

    def forget(self) -> None:
        self.number, self.known, self.held = _Numbered(), 0, 0
        for side in self.units:
            side.forget()

    def encode(self, texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of A and B for each text in UTF-8; none if a side's tokens don't join to the text."""
        if self.known > MOST_UNITS or self.held > MOST_UNIT_CHARS:
            self.forget()
        read = [t.decode("utf-8", "replace") for t in texts]
        units = [np.fromiter(map(self.number.__getitem__, self.cut(t)), np.int64) if t else np.zeros(0, np.int64) for t in read]
        if len(self.number) > self.known:
            new = list(self.number)[self.known :]
            for i in range(0, len(new), MOST_CALL):
                for side in self.units:
                    side.add(new[i : i + MOST_CALL])
            self.known, self.held = len(self.number), self.held + sum(map(len, new))
        none = tuple(np.zeros(0, kind) for kind in self.kinds)
        whole = [bool(u.size) and all(side.whole[u].all() for side in self.units) and r.encode() == t for u, r, t in zip(units, read, texts)]
        return [tuple(side.of(u) for side in self.units) if w else none for u, w in zip(units, whole)]


@lru_cache(maxsize=1)
def _pair(a_path: str, b_path: str) -> Pair:
    """A worker keeps its tokenizers and what they have met from task to task."""
    return Pair(a_path, b_path)


class Sizes:
    """Byte lengths of both vocabularies' tokens, and the names of ids with the sign behind them."""

    def __init__(self, pair: Pair):
        self.a, self.b = pair.a.sizes, pair.b.sizes
        self.kinds = pair.kinds
        names = lambda n, last: [x for i in range(n) for x in (b"%d," % i, b"%d%s" % (i, last))]
        self.names = names(len(self.a), b"|") + names(len(self.b), b";")

    def read(self, batch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of A and B of a batch's rows, joined, and where each row's end."""
        out = []
        for name, kind in zip(("__a", "__b"), self.kinds):
            rows = batch.column(name).to_pylist()
            ends = np.cumsum([len(r) for r in rows], dtype=np.int64) // np.dtype(kind).itemsize
            out += [np.frombuffer(b"".join(rows), kind).astype(np.int64), ends]
        return out[0], out[2], out[1], out[3]

    def groups(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens in the order of groups, A before B, as codes of self.names; how many of A and B there are up to each cut."""
        a_ends, b_ends = Alignment(self.a[a], self.b[b]).ranges()
        a_counts, b_counts = np.diff(a_ends, prepend=0), np.diff(b_ends, prepend=0)
        out = np.empty(len(a) + len(b), np.int64)
        last = np.zeros(len(a), np.int64)
        last[a_ends - 1] = 1
        out[np.arange(len(a)) + np.repeat(b_ends - b_counts, a_counts)] = 2 * a + last
        last = np.zeros(len(b), np.int64)
        last[b_ends - 1] = 1
        out[np.arange(len(b)) + np.repeat(a_ends, b_counts)] = 2 * len(self.a) + 2 * b + last
        return out, a_ends, b_ends

    def links(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each link's id pair as one number, and the place of its token of A."""
        at, to = Alignment(self.a[a], self.b[b]).links()
        return (a[at] << 32) | b[to], at


def _blocks(batches: Iterator, limit: int) -> Iterator:
    """Slices of Arrow batches with about so many bytes of __text."""
    for batch in batches:
        begin, size = 0, 0
        for i, text in enumerate(batch.column("__text")):
            size += len(text.as_buffer())
            if size >= limit:
                yield batch.slice(begin, i + 1 - begin)
                begin, size = i + 1, 0
        if begin < batch.num_rows:
            yield batch.slice(begin)


def tokenized(documents: DataFrame, a_path: str, b_path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns keep, __a and __b (binary ids), n_a, n_b, n_groups, n_links (long) and groups (string: `a1,a2|b1;a3|b2,b3`)."""
    fields = [documents.schema[k] for k in keep]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "__a binary, __b binary, n_a long, n_b long, n_groups long, n_links long, groups string"])

    def run(batches: Iterator):
        import pyarrow as pa

        pair = _pair(a_path, b_path)
        sizes = Sizes(pair)
        for batch in _blocks(parts(batches), BLOCK_BYTES):
            coded = pair.encode(batch.column("__text").to_pylist())
            a_ends, b_ends = (np.cumsum([len(c[side]) for c in coded], dtype=np.int64) for side in (0, 1))
            a, b = (np.concatenate([c[side] for c in coded]).astype(np.int64) for side in (0, 1))
            codes, a_cuts, _ = sizes.groups(a, b)
            group_ends = np.searchsorted(a_cuts, a_ends, "right")
            n_a, n_b, n_groups = (np.diff(x, prepend=0) for x in (a_ends, b_ends, group_ends))
            ends, begins = a_ends + b_ends, a_ends + b_ends - n_a - n_b
            names = [b"".join(map(sizes.names.__getitem__, codes[x:y].tolist()))[:-1] for x, y in zip(begins.tolist(), ends.tolist())]
            columns = [*(batch.column(f.name) for f in fields), pa.array([c[0].tobytes() for c in coded], pa.binary()), pa.array([c[1].tobytes() for c in coded], pa.binary())]
            columns += [pa.array(x, pa.int64()) for x in (n_a, n_b, n_groups, n_a + n_b - n_groups)] + [pa.array(names, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [*keep, "__a", "__b", "n_a", "n_b", "n_groups", "n_links", "groups"])

    return documents.select(*keep, text_bytes(text).alias("__text")).mapInArrow(run, schema)


def _merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
    counts = np.zeros(len(keys), np.int64)
    np.add.at(counts, at, np.concatenate([n for _, n in held]))
    return keys, counts


def pair_counts(coded: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(pair, n, best): how often each pair of ids is linked in coded's rows; best if no pair of the same B id is linked more often. pair is A's id * 2^32 + B's."""

    def run(batches: Iterator):
        import pyarrow as pa

        sizes = Sizes(_pair(a_path, b_path))
        held, size = [], 0

        def out():
            keys, counts = _merged(held)
            for i in range(0, len(keys), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + (1 << 16)]), pa.array(counts[i : i + (1 << 16)])], ["pair", "n"])

        for batch in parts(batches):
            a, b, _, _ = sizes.read(batch)
            held.append(np.unique(sizes.links(a, b)[0], return_counts=True))
            size += len(held[-1][0])
            if size > HELD_PAIRS:
                held = [_merged(held)]
                size = len(held[0][0])
                if size > HELD_PAIRS // 2:
                    yield from out()
                    held, size = [], 0
        if held:
            yield from out()

    counts = coded.select("__a", "__b").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = counts.withColumn("b", F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)))
    return counts.join(counts.groupBy("b").agg(F.max("n").alias("most")), "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _frequent(counts: DataFrame, most: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """The least n so that at most `most` pairs have it or more, and those pairs, their n and best, sorted by pair. At most some 500 rows of sizes and `most` pairs come to the driver."""
    step = F.floor(8 * F.log2(F.col("n").cast("double"))).cast("int")
    least, total = None, 0
    for row in sorted(counts.groupBy(step.alias("step")).agg(F.count("*").alias("pairs"), F.min("n").alias("least")).collect(), key=lambda r: -r["step"]):
        total += row["pairs"]
        if total > most:
            break
        least = row["least"]
    if least is None:
        return 1 << 62, *(np.zeros(0, np.int64),) * 2, np.zeros(0, bool)
    chosen = counts.where(F.col("n") >= least).toArrow()
    pair, n, best = (chosen.column(c).to_numpy() for c in ("pair", "n", "best"))
    order = np.argsort(pair)
    return least, pair[order], n[order], best[order]


def _scored(coded: DataFrame, a_path: str, b_path: str, frequent, name: str) -> DataFrame:
    """(name, n_best, count_sum, pairs, times): what the frequent pairs add to each row, and the row's other pairs with their numbers."""

    def run(batches: Iterator):
        import pyarrow as pa

        sizes = Sizes(_pair(a_path, b_path))
        known, n, best = frequent.value
        for batch in parts(batches, 200):
            a, b, a_ends, _ = sizes.read(batch)
            pairs, at = sizes.links(a, b)
            row = np.searchsorted(a_ends, at, "right")
            place = np.minimum(np.searchsorted(known, pairs), max(len(known) - 1, 0))
            found = known[place] == pairs if len(known) else np.zeros(len(pairs), bool)
            sums, bests = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            np.add.at(sums, row[found], n[place[found]])
            np.add.at(bests, row[found], best[place[found]].astype(np.int64))
            row, pairs = row[~found], pairs[~found]
            order = np.lexsort((pairs, row))
            row, pairs = row[order], pairs[order]
            fresh = np.flatnonzero(np.concatenate([[True], (np.diff(row) != 0) | (np.diff(pairs) != 0)])) if len(row) else np.zeros(0, np.int64)
            times = np.diff(np.append(fresh, len(row)))
            offsets = pa.array(np.searchsorted(row[fresh], np.arange(batch.num_rows + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int64))) for x in (pairs[fresh], times)]
            yield pa.RecordBatch.from_arrays([batch.column(name), pa.array(bests), pa.array(sums), *lists], [name, "n_best", "count_sum", "pairs", "times"])

    return coded.select(name, "__a", "__b").mapInArrow(run, f"`{name}` long, n_best long, count_sum long, pairs array<long>, times array<long>")


def align(documents: DataFrame, a_path: str, b_path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), digest: bool = False, frequent_pairs: int = FREQUENT_PAIRS) -> DataFrame:
    """Columns keep, n_a, n_b, n_groups, n_links, n_best, count_sum (long) and groups (string), or groups_sha256 if digest is set.

    Side A encodes a space and the text, side B the text to which it adds a space. groups are the token ids between
    shared cuts (`a1,a2|b1;a3|b2,b3`). A link is an overlap of a token of A with one of B; count_sum adds up, over a
    row's links, how often the link's pair of ids is linked in the whole table; n_best counts the links whose pair is
    linked most often of all with the same id of B, ties included. Both files are read by each Python worker, so they
    are an installed package's. Null and empty texts, and texts whose tokens don't join to them, have no tokens: zeros
    and an empty groups. Repeated rows stay and count each; no text is too long (all but the ids of a block of texts
    is bounded); an empty table gives no rows. keep must not hold one of the result's names.
    """
    made = {"n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups", "groups_sha256"}
    if clash := made & {k.lower() for k in keep}:
        raise ValueError(f"columns to keep have the names of results: {sorted(clash)}")
    spark = documents.sparkSession
    row = unused("__row", keep)
    inner = tuple(f"__k{i}" for i in range(len(keep)))
    own = documents.select(*(F.col(k).alias(i) for k, i in zip(keep, inner)), F.col(text).alias("__t"))
    coded = tokenized(own, a_path, b_path, "__t", inner)
    if digest:
        coded = coded.withColumn("groups", F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)))
    coded_path = scratch_write(coded.withColumn(row, F.monotonically_increasing_id()))
    coded = spark.read.parquet(coded_path)
    counts_path = scratch_write(pair_counts(coded, a_path, b_path))
    counts = spark.read.parquet(counts_path)
    least, *table = _frequent(counts, frequent_pairs)
    frequent = spark.sparkContext.broadcast(tuple(table))
    scored_path = scratch_write(_scored(coded, a_path, b_path, frequent, row))
    scored = spark.read.parquet(scored_path)
    rest = scored.select(row, F.explode(F.arrays_zip("pairs", "times")).alias("e")).select(row, "e.pairs", "e.times").withColumnRenamed("pairs", "pair")
    rest = rest.join(counts.where(F.col("n") < least), "pair").groupBy(row).agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("n") * F.col("times")).alias("more"))
    whole = scored.select(row, "n_best", "count_sum").join(rest, row, "left")
    sums = scratch_write(whole.select(row, (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"), (F.col("count_sum") + F.coalesce("more", F.lit(0))).alias("count_sum")))
    slim = scratch_write(coded.drop("__a", "__b"))
    discard(spark, coded_path, counts_path, scored_path)
    frequent.destroy()
    out = spark.read.parquet(slim).join(spark.read.parquet(sums), row)
    return out.select(*(F.col(i).alias(k) for k, i in zip(keep, inner)), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256" if digest else "groups"))
