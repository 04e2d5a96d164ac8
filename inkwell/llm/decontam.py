"""Benchmark decontamination by greedy string tiling.

The benchmark is the stated query set and is taken in blocks of bounded size, against all documents. Words that a
document shares with a block are joined by seeds, runs of as many words as the shortest tile has. A document and an
item with seeds that could cover enough of the item are tiled by running Karp-Rabin: the longest matches of
unmarked words are marked first, with search lengths that fall, so passages count in whatever order they stand.
A document is contaminated where tiles cover the threshold's share of an item.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import ascii_words, discard, mix, parts, scratch_write, text_bytes, text_name, texts_of, unused, with_text

#: Words of the shortest tile, the share of an item's words that counts, and bytes of benchmark text in a block.
TILE_WORDS, COVERAGE, BLOCK_BYTES = 5, 0.4, 8 << 20
_FACTOR = 0x9E3779B97F4A7C15


def _rolling(ids: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of `size` ids."""
    total = np.zeros(max(0, len(ids) - size + 1), np.uint64)
    for i in range(size):
        total = total * np.uint64(_FACTOR) + ids[i : len(ids) - size + 1 + i].astype(np.uint64)
    return mix(total)


def _runs(live: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], live.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def tiles(item: np.ndarray, document: np.ndarray, shortest: int = TILE_WORDS) -> list[tuple[int, int, int]]:
    """Tiles (place in item, place in document, words) of two id arrays; ids below 0 in the document match nothing.

    Running Karp-Rabin greedy string tiling: matches of at least the search length are found by hashes and
    extended; if one is over twice as long the search starts again at its length; matches are marked from the
    longest, then the length is halved down to the shortest. Ties go to the earliest place in item, then document.
    """
    free_item, free_doc = np.ones(len(item), bool), document >= 0
    found, search = [], max(shortest, min(len(item), 32))
    while True:
        spots, hashes = _free_hashes(document, free_doc, search)
        order = np.argsort(hashes, kind="stable")
        spots, hashes = spots[order], hashes[order]
        matches, longest = [], 0
        places, wanted = _free_hashes(item, free_item, search)
        low, high = np.searchsorted(hashes, wanted, "left"), np.searchsorted(hashes, wanted, "right")
        for i in np.flatnonzero(low < high).tolist():
            at, there = int(places[i]), spots[low[i] : high[i]]
            if at and free_item[at - 1]:  # not those that are part of a match that begins earlier
                there = there[(there == 0) | ~free_doc[there - 1] | (document[there - 1] != item[at - 1])]
            for spot in there.tolist():
                size = min(len(item) - at, len(document) - spot)
                same = free_item[at : at + size] & free_doc[spot : spot + size] & (item[at : at + size] == document[spot : spot + size])
                n = size if same.all() else int(np.argmin(same))
                if n >= search:
                    matches.append((-n, at, spot))
                    longest = max(longest, n)
        if longest > 2 * search:
            search = longest
            continue
        heapq.heapify(matches)
        while matches:
            minus, at, there = heapq.heappop(matches)
            free = free_item[at : at - minus] & free_doc[there : there - minus]
            if free.all():
                free_item[at : at - minus] = False
                free_doc[there : there - minus] = False
                found.append((at, there, -minus))
                continue
            for begin, end in _runs(free):  # what is left of an overlapped match competes again
                if end - begin >= search:
                    heapq.heappush(matches, (begin - end, at + begin, there + begin))
        if search == shortest:
            return sorted(found)
        search = max(shortest, search // 2)


def _free_hashes(ids: np.ndarray, free: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all runs of `size` free ids, and their hashes."""
    if len(ids) < size:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    taken = np.concatenate([[0], np.cumsum(~free)])
    places = np.flatnonzero(taken[size:] == taken[:-size])
    return places, _rolling(ids, size)[places]


@dataclass
class Block:
    """Items of a part of the benchmark, with their seeds."""

    items: list[tuple[object, np.ndarray]]
    words: dict[bytes, int]
    seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]  # by seed length: sorted hashes, item numbers, places
    shortest: int = TILE_WORDS

    @classmethod
    def of(cls, rows: list[tuple[object, bytes]], shortest: int = TILE_WORDS) -> Block:
        words: dict[bytes, int] = {}
        items = [(key, np.array([words.setdefault(w, len(words)) for w in ascii_words(text)], np.int64)) for key, text in rows]
        items = [i for i in items if len(i[1])]
        seeds = {}
        for size in range(1, shortest + 1):
            chosen = [n for n, (_, ids) in enumerate(items) if min(len(ids), shortest) == size]
            if chosen:
                hashes = [_rolling(items[n][1], size) for n in chosen]
                number = np.repeat(chosen, [len(h) for h in hashes])
                place = np.concatenate([np.arange(len(h)) for h in hashes])
                flat = np.concatenate(hashes)
                order = np.argsort(flat, kind="stable")
                seeds[size] = flat[order], number[order], place[order]
        return cls(items, words, seeds, shortest)

    def matches(self, text: bytes, coverage: float) -> list[tuple]:
        """(item key, words of the item, covered words, tiles) of the items that the text covers enough of."""
        tokens = ascii_words(text)
        ids = np.fromiter(map(self.words.get, tokens, repeat(-1)), np.int64, len(tokens))
        if len(ids) and ids.max() < 0:
            return []
        out = []
        known = np.concatenate([[0], np.cumsum(ids >= 0)])
        for size, (hashes, number, place) in self.seeds.items():
            if len(ids) < size:
                continue
            at = np.flatnonzero(known[size:] - known[:-size] == size)
            mine = _rolling(ids, size)[at]
            distinct = np.unique(mine)
            low, high = np.searchsorted(hashes, distinct, "left"), np.searchsorted(hashes, distinct, "right")
            runs = high - low
            hits = np.repeat(low - np.cumsum(runs) + runs, runs) + np.arange(runs.sum())  # the seeds that the text has, each once
            hits = hits[np.argsort(number[hits], kind="stable")]
            for begin, end in zip(*_groups(number[hits])):
                key, item = self.items[number[hits[begin]]]
                reach = np.zeros(len(item) + 1, np.int64)
                np.add.at(reach, place[hits[begin:end]], 1)
                np.add.at(reach, place[hits[begin:end]] + size, -1)
                if np.count_nonzero(np.cumsum(reach)) < coverage * len(item):
                    continue  # tiles lie within the seeds: they cannot cover enough
                spots = at[np.isin(mine, hashes[hits[begin:end]])]
                near = np.unique((spots[:, None] + np.arange(size)).ravel())
                gaps = np.concatenate([[0], np.cumsum(np.diff(near) > 1)])
                inside, back = np.full(len(near) + int(gaps[-1]), -1, np.int64), np.zeros(len(near) + int(gaps[-1]), np.int64)
                inside[np.arange(len(near)) + gaps], back[np.arange(len(near)) + gaps] = ids[near], near
                found = tiles(item, inside, size)
                covered = sum(t[2] for t in found)
                if covered >= coverage * len(item):
                    out.append((int(number[hits[begin]]), key, len(item), covered, [(int(a), int(back[d]), int(m)) for a, d, m in found]))
        return [x[1:] for x in sorted(out, key=lambda x: x[0])]


def _groups(values: np.ndarray) -> tuple[list[int], list[int]]:
    """Where runs of equal values begin and end."""
    cuts = np.flatnonzero(np.diff(values)) + 1
    return ([0, *cuts.tolist()], [*cuts.tolist(), len(values)]) if len(values) else ([], [])


_MATCH = "array<struct<item_id:{key},item_words:bigint,covered_words:bigint,tiles:array<struct<item_at:bigint,doc_at:bigint,words:bigint>>>>"


def matches(documents: DataFrame, benchmark: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", coverage: float = COVERAGE, block_bytes: int = BLOCK_BYTES, out: str = "__matches") -> DataFrame:
    """Columns `keep` and `out`, the items that each row contains (an array of structs, empty if none).

    A null or empty text, like an item without words, matches nothing; items shorter than a tile must stand
    whole. Items with the same or a null id are separate items, repeated ones match as often as they stand there.
    Repeated documents stay. An item's tiles that could be placed in several ways lie as early as they can. Each
    block is one more pass over documents, written before the next begins. `out` must not be in `keep`.
    """
    from pyspark.sql.types import StructField, StructType

    if out in keep:
        raise ValueError(f"{out} is a column of the documents")
    kind = benchmark.schema["item_id"].dataType.simpleString()
    items = benchmark.groupBy("item_id", text_bytes("text").alias("__t")).agg(F.count("*").alias("__n"))
    size = items.agg(F.sum(F.octet_length("__t"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    placed = items.withColumn("__b", F.pmod(F.xxhash64("item_id", "__t"), F.lit(blocks)))
    df, before = with_text(documents, keep, text).withColumn(out, F.array().cast(_MATCH.format(key=kind))), None
    for number in range(blocks):
        rows = sorted(((r[0], bytes(r[1]), r[2]) for r in placed.where(F.col("__b") == number).select("item_id", "__t", "__n").collect()), key=lambda r: (r[0] is not None, r[0], r[1]))
        shared = df.sparkSession.sparkContext.broadcast((Block.of([((r[0], r[2]), r[1]) for r in rows])))
        last = number + 1 == blocks
        schema = StructType([StructField(f.name, f.dataType) for f in df.schema if not (last and text not in keep and f.name == text_name(keep, text))])

        def run(batches: Iterator, shared=shared, names=tuple(schema.names)):
            import pyarrow as pa

            block = shared.value
            for batch in parts(batches):
                old, new = batch.column(out), []
                for i, document in enumerate(texts_of(batch, keep, text)):
                    found = block.matches(document.encode("utf-8", "surrogatepass"), coverage)
                    new.append((old[i].as_py() or []) + [{"item_id": k, "item_words": n, "covered_words": c, "tiles": [dict(zip(("item_at", "doc_at", "words"), t)) for t in ts]} for (k, times), n, c, ts in found for _ in range(times)])
                yield pa.RecordBatch.from_arrays([pa.array(new, old.type) if n == out else batch.column(n) for n in names], list(names))

        df = df.mapInArrow(run, schema)
        if not last:
            path = scratch_write(df)
            df = df.sparkSession.read.parquet(path)
            if before:
                discard(df.sparkSession, before)
            before = path
    return df.select(*keep, out)


def decontaminate(documents: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of documents that contain no benchmark item, with all their columns."""
    name = unused("__matches", documents.columns)
    return matches(documents, benchmark, tuple(documents.columns), text, out=name).where(F.size(name) == 0).drop(name)
