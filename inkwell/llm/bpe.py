"""Byte-level BPE encoding and decoding by corpus-level merge replay.

A block of documents is one corpus. Its distinct pre-tokens are laid out as one array of symbols with an
inverted index from the rank of a token pair to the positions where that pair stands. Every merge is then
applied once, in rank order, to all its positions at the same time, and only the touched neighbours get new
entries in the index. Documents are read off their pre-tokens' ids afterwards. Blocks are bounded by bytes,
so nothing is shuffled, broadcast or gathered, and a lost task repeats only its own split.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import parts, text_bytes

#: Bytes of text that are encoded together, and pre-tokens remembered between blocks.
BLOCK_BYTES, CACHE_WORDS = 4 << 20, 150_000
#: Bytes of a short batch that goes back to Spark.
OUT_BYTES = 2 << 20


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a .tiktoken file: base64 of a token's bytes and its rank on each line."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


class MergeReplay:
    """Encodes lists of pre-tokens by replaying a rank table's merges over all of them."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.size = max(ranks.values()) + 1
        single = np.full(256, -1, np.int32)
        for value in range(256):
            single[value] = ranks.get(bytes([value]), -1)
        if (single < 0).any():
            raise ValueError("a byte-level table needs a rank for each of the 256 bytes")
        self.single = single
        # All pairs of tokens whose bytes together are a token: left * size + right -> rank, sorted by the key.
        keys, values = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left * self.size + right)
                    values.append(rank)
        order = np.argsort(np.array(keys, np.int64))
        self.keys, self.values = np.array(keys, np.int64)[order], np.array(values, np.int32)[order]

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the merged pair, -1 where there is none or either side is a separator (-1)."""
        if not len(self.keys):
            return np.full(len(left), -1, np.int32)
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.values[at], -1).astype(np.int32)

    def one(self, word: bytes) -> list[int]:
        """The plain loop over one pre-token: the lowest rank first, the leftmost of equals."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(a + b, self.size), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == self.size:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after another, and how many each word has."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.concatenate([[0], np.cumsum(lengths + 1)])
        n = int(starts[-1]) + 1
        symbols = np.full(n, -1, np.int32)
        inside = np.ones(n, bool)
        inside[np.concatenate([[0], starts[1:]])] = False
        symbols[inside] = self.single[np.frombuffer(b"".join(words), np.uint8)]
        after = np.arange(1, n + 1, dtype=np.int32)
        before = np.arange(-1, n - 1, dtype=np.int32)
        pair = np.full(n, -1, np.int32)
        pair[:-1] = self.pair_ranks(symbols[:-1], symbols[1:])
        odd = self._replay(symbols, after, before, pair)
        kept = symbols >= 0
        ids = symbols[kept]
        word_of = np.cumsum(~inside)[kept] - 1
        counts = np.bincount(word_of, minlength=len(words))[: len(words)]
        if odd:
            return self._mend(words, ids, counts, {int(np.searchsorted(starts, at, "left")) - 1 for at in odd})
        return ids, counts

    def _replay(self, symbols, after, before, pair) -> list[int]:
        """Applies all merges in place; returns positions whose merge made a pair of lower rank."""
        places = np.flatnonzero(pair >= 0)
        places = places[np.argsort(pair[places], kind="stable")]
        ranks, first = np.unique(pair[places], return_index=True)
        index = {int(r): [p] for r, p in zip(ranks, np.split(places, first[1:]))}
        queue, odd = sorted(index), []
        while queue:
            rank = heapq.heappop(queue)
            at = index.pop(rank)
            at = at[0] if len(at) == 1 else np.sort(np.concatenate(at))
            at = at[pair[at] == rank]
            if not len(at):
                continue
            if len(at) > 1:
                linked = after[at[:-1]] == at[1:]
                if linked.any():  # a run of overlapping pairs: every other one, from its left end
                    step = np.arange(len(at))
                    begin = np.maximum.accumulate(np.where(np.concatenate([[True], ~linked]), step, 0))
                    at = at[(step - begin) % 2 == 0]
            gone = after[at]
            behind = after[gone]
            symbols[at], symbols[gone] = rank, -2
            pair[gone] = -1
            after[at] = behind
            before[behind] = at
            touched = np.concatenate([before[at], at])
            fresh = self.pair_ranks(symbols[touched], symbols[after[touched]])
            pair[touched] = fresh
            touched, fresh = touched[fresh >= 0], fresh[fresh >= 0]
            if not len(fresh):
                continue
            low = fresh < rank
            if low.any():  # such a word is encoded again by the plain loop
                odd += touched[low].tolist()
                touched, fresh = touched[~low], fresh[~low]
            order = np.argsort(fresh, kind="stable")
            touched, fresh = touched[order], fresh[order]
            cuts = np.flatnonzero(np.diff(fresh)) + 1
            for r, p in zip(fresh[np.concatenate([[0], cuts])].tolist() if len(fresh) else [], np.split(touched, cuts)):
                if r in index:
                    index[r].append(p)
                else:
                    index[r] = [p]
                    heapq.heappush(queue, r)
        return odd

    def _mend(self, words, ids, counts, which):
        parts = np.split(ids, np.cumsum(counts)[:-1])
        for i in which:
            parts[i] = np.array(self.one(words[i]), np.int32)
        return np.concatenate(parts), np.array([len(p) for p in parts])


class Encoder:
    """Encodes blocks of texts; pre-tokens seen before are remembered up to a bound."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, cache_words: int = CACHE_WORDS):
        import regex

        self.replay, self.find, self.bound = MergeReplay(ranks), regex.compile(pattern).findall, cache_words
        self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = _Numbered()
        self.known = 0
        self.ids, self.counts = np.zeros(0, np.uint16 if self.replay.size <= 1 << 16 else np.uint32), np.zeros(0, np.int64)

    def block(self, texts: list[str]) -> list[np.ndarray]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        if len(self.index) > self.bound:
            self._forget()
        words = [np.fromiter(map(self.index.__getitem__, self.find(text)), np.int32) for text in texts]
        if len(self.index) > self.known:
            new = [w.encode("utf-8", "surrogatepass") for w in list(self.index)[self.known :]]
            ids, counts = self.replay.encode(new)
            self.ids = np.concatenate([self.ids, ids.astype(self.ids.dtype)])
            self.counts = np.concatenate([self.counts, counts])
            self.known = len(self.index)
        ends = np.cumsum(self.counts)
        starts = ends - self.counts
        out = []
        for of in words:
            lengths = self.counts[of]
            total = int(lengths.sum())
            at = np.repeat(starts[of] - (np.cumsum(lengths) - lengths), lengths) + np.arange(total)
            out.append(self.ids[at].astype("<u4"))
        return out


class Decoder:
    """The bytes that ids stand for."""

    def __init__(self, ranks: dict[bytes, int]):
        self.token = {rank: word for word, rank in ranks.items()}.__getitem__

    def __call__(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.token, ids.tolist()))


class _Numbered(dict):
    def __missing__(self, word):
        value = self[word] = len(self)
        return value


def encode(documents: DataFrame, ranks_path: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), block_bytes: int = BLOCK_BYTES, with_decoded: bool = False) -> DataFrame:
    """Columns `keep`, n_tokens (long) and ids (binary: little-endian unsigned 32-bit integers) of each row.

    with_decoded adds decoded (binary), what the ids decode to, from the same Python worker.

    ranks_path is read by each Python worker, so it names a file that every executor has (an installed
    package's file). Each match of pattern is encoded by itself; there are no special tokens. A null or
    empty text has no tokens; repeated rows stay repeated; no length is too long; keep must not hold a result's name.
    """
    if clash := {"n_tokens", "ids", "decoded"} & {k.lower() for k in keep}:
        raise ValueError(f"columns to keep have the names of results: {sorted(clash)}")
    fields = [documents.schema[k] for k in keep]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "n_tokens long", "ids binary", *(["decoded binary"] if with_decoded else [])])

    def run(batches: Iterator):
        import pyarrow as pa

        ranks = load_ranks(ranks_path)
        encoder, decoded = Encoder(ranks, pattern), Decoder(ranks) if with_decoded else None

        def emit(kept, texts):
            ids = encoder.block([t.decode("utf-8", "replace") for t in texts])
            begin = 0
            while begin < len(ids):
                end, size = begin, 0
                while end < len(ids) and (end == begin or size < OUT_BYTES):
                    size += ids[end].nbytes
                    end += 1
                part = pa.Table.from_batches(kept).slice(begin, end - begin)
                columns = [part.column(f.name) for f in fields]
                columns += [pa.array([len(x) for x in ids[begin:end]], pa.int64()), pa.array([x.tobytes() for x in ids[begin:end]], pa.binary())]
                columns += [pa.array([decoded(x) for x in ids[begin:end]], pa.binary())] if with_decoded else []
                yield from pa.table(columns, names=[*keep, "n_tokens", "ids", *(["decoded"] if with_decoded else [])]).combine_chunks().to_batches()
                begin = end

        kept, texts, size = [], [], 0
        for batch in parts(batches):
            values = batch.column("__text").to_pylist()
            begin = 0
            for i, value in enumerate(values):
                size += len(value)
                if size >= block_bytes:
                    kept.append(batch.slice(begin, i + 1 - begin))
                    texts += values[begin : i + 1]
                    yield from emit(kept, texts)
                    kept, texts, size, begin = [], [], 0, i + 1
            if begin < len(values):
                kept.append(batch.slice(begin))
                texts += values[begin:]
        if texts:
            yield from emit(kept, texts)

    return documents.select(*keep, text_bytes(text).alias("__text")).mapInArrow(run, schema)


def decode(encoded: DataFrame, ranks_path: str, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns `keep` and decoded (binary: the tokens' bytes joined). Null ids decode to no bytes; an id without a token raises."""
    fields = [encoded.schema[k] for k in keep]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "decoded binary"])

    def run(batches: Iterator):
        import pyarrow as pa

        decoded = Decoder(load_ranks(ranks_path))
        for batch in parts(batches):
            texts = [decoded(np.frombuffer(x or b"", "<u4")) for x in batch.column("__ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(texts, pa.binary())], [*keep, "decoded"])

    return encoded.select(*keep, F.col(ids).alias("__ids")).mapInArrow(run, schema)
