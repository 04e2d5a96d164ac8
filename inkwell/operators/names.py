"""Names in texts: one scan of a text finds all names of a table, at all their places, by an automaton of the names.

What is scanned is dealt in blocks of sentences and shards of names, so that neither a long book nor a book with many
names is one task, and each block is read once for each shard, however many names that has.
"""

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.sources import scratch

#: Sentences that are scanned together, and names of one automaton.
BLOCK, SHARD = 500, 10_000
# Title words before a name, words that are no names, words beside which a word is none.
HONORIFICS = ("mr", "mrs", "ms", "miss", "dr", "prof", "professor", "captain", "lord", "lady", "sir", "dame", "duke", "duchess", "earl", "count", "countess", "baron", "baroness", "general", "colonel", "major", "sergeant", "officer", "detective", "inspector", "agent", "king", "queen", "prince", "princess", "emperor", "empress")
COMMON = ("the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "as", "is", "was", "are", "were", "been", "have", "has", "had", "do", "does", "did", "will", "would", "should", "could", "may", "might", "must", "can", "shall", "i", "you", "we", "chapter", "part", "section", "volume", "book", "page")
NOT_NAMES = ("he", "she", "they", "it", "this", "that", "these", "those", "if", "when", "while", "since", "because", "however", "therefore", "yes", "no", "not", "mom", "dad", "mother", "father")
PLACES, ROLES = ("in", "at", "to", "from"), ("adventurer", "rank", "knight", "saint", "guild")

# White space as Spark's regular expressions know it; word borders are those of all letters.
_SPACE = r"[ \t\n\x0b\f\r]"
_RUN = rf"([A-Z][a-z]+(?:{_SPACE}+[A-Z][a-z]+)*)\b"
_NAME, _TITLED = re.compile(rf"\b{_RUN}"), re.compile(rf"\b(?ai:{'|'.join(HONORIFICS)})\.?{_SPACE}+{_RUN}")
_SENTENCE, _BLANK = re.compile(r"[.!?]+"), re.compile(rf"{_SPACE}+")


def automaton(names: list[str]):
    """Finds all of names (distinct, not empty) in one pass over a text; values are their places in the list."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for i, name in enumerate(names):
        found.add_word(name, (i, len(name)))
    if names:
        found.make_automaton()
    return found


def places(found, text: str) -> dict[int, list[int]]:
    """For each name that stands in text, where it begins, overlaps included."""
    out: dict[int, list[int]] = {}
    if len(found):
        for end, (i, size) in found.iter(text):
            out.setdefault(i, []).append(end + 1 - size)
    return out


def counted(text: str, names: list[str]) -> list[int]:
    """How often each name stands in text, none over another place of its own."""
    out = [0] * len(names)
    for i, begins in places(automaton(names), text).items():
        end = 0
        for begin in begins:
            if begin >= end:
                out[i] += 1
                end = begin + len(names[i])
    return out


def _shards(names: DataFrame, doc: str, size: int, *more: str) -> DataFrame:
    """(doc, __names): each document's distinct names, with columns `more`, in lists of about `size`."""
    distinct = names.where(F.col("name") != "").select(doc, "name", *more).distinct()
    parts = distinct.groupBy(doc).agg(F.ceil(F.count("*") / size).cast("int").alias("__of"))
    return distinct.join(parts, doc).groupBy(doc, F.pmod(F.xxhash64("name"), F.col("__of")).alias("__shard")).agg(F.collect_list(F.struct("name", *more)).alias("__names")).drop("__shard")


def mentions(sentences: DataFrame, names: DataFrame, doc: str = "doc_id", text: str = "sentence", order: str = "pos", block: int = BLOCK, shard: int = SHARD, more: tuple[str, ...] = ()) -> DataFrame:
    """Sentences with each name of their own document that stands in them, and places: where in the sentence it begins.

    names has (doc, name); an empty or null name stands nowhere, a repeated one counts once; other columns of it are
    left out but for `more`, of which a name has one value. order numbers a document's sentences. A block is read
    text by text and its hits are kept as numbers in flat arrays, so a worker holds little besides the batch.
    """
    import pyarrow as pa

    @F.arrow_udf("array<struct<i:int,j:int,places:array<int>>>")
    def scan(texts: pa.Array, lists: pa.Array) -> pa.Array:
        from array import array

        import numpy as np

        last, found = None, None
        rows, hits, own, which, begins = array("i", [0]), array("i", [0]), array("i"), array("i"), array("i")
        for ts, ns in zip(texts, lists):
            ns = ns.as_py()
            if ns != last:
                last, found = ns, automaton(ns)
            for i, t in enumerate(ts.as_py()):
                for j, at in places(found, t).items() if t else ():
                    own.append(i)
                    which.append(j)
                    begins.extend(at)
                    hits.append(len(begins))
            rows.append(len(own))
        flat = lambda a: pa.array(np.frombuffer(a, np.int32) if len(a) else [], pa.int32())
        one = pa.StructArray.from_arrays([flat(own), flat(which), pa.ListArray.from_arrays(flat(hits), flat(begins))], ["i", "j", "places"])
        return pa.ListArray.from_arrays(flat(rows), one)

    packed = sentences.groupBy(doc, F.floor(F.col(order) / block).alias("__block")).agg(F.collect_list(F.struct(*(c for c in sentences.columns if c != doc))).alias("__rows"))
    both = packed.join(_shards(names, doc, shard, *more), doc)
    hits = both.select(doc, "__rows", "__names", F.explode(scan(F.col(f"__rows.{text}"), F.col("__names.name"))).alias("__hit"))
    rows = hits.select(doc, F.get("__rows", F.col("__hit.i")).alias("__row"), F.get("__names", F.col("__hit.j")).alias("__name"), F.col("__hit.places").alias("places"))
    # The key stays the join's own column: what is counted for each document next needs no other shuffle.
    return rows.select(*(F.col(c) if c == doc else F.col("__row").getField(c).alias(c) for c in sentences.columns), *(F.col("__name").getField(c).alias(c) for c in ("name", *more)), "places")


def mention_profiles(sentences: DataFrame, names: DataFrame, doc: str = "doc_id", order: str = "pos", text: str = "sentence", contexts: int = 5, size: int = 100) -> DataFrame:
    """(doc, name, mentions, contexts): in how many sentences a name stands, and the beginnings of the first of them.

    Each task keeps the first contexts of a name only, so a name that stands in very many sentences gathers few.
    """
    found = mentions(sentences, names, doc, text, order)
    near = found.groupBy(doc, "name", F.floor(F.col(order) / BLOCK).alias("__block")).agg(F.count("*").alias("n"), F.slice(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.substring(text, 1, size).alias("t")))), 1, contexts).alias("early"))
    whole = near.groupBy(doc, "name").agg(F.sum("n").alias("mentions"), F.array_sort(F.flatten(F.collect_list("early"))).alias("all"))
    return whole.select(doc, "name", "mentions", F.slice("all", 1, contexts)["t"].alias("contexts"))


def pronoun_usage(sentences: DataFrame, names: DataFrame, pronouns: DataFrame, doc: str = "doc_id", order: str = "pos", text: str = "sentence", name_order: str = "ord", window: int = 3) -> DataFrame:
    """(doc, name, pronoun, n): pronouns credited to names.

    A sentence's pronouns go to every name in it; if there is none, to the name of the nearest of the `window` sentences
    before it that has one, the first there by name_order. pronouns has (doc, order, pronoun), a row for each
    credit that a token gives. Sentences are numbered without gaps, so what an earlier sentence hands on is joined by
    number; no window has to hold a whole document.
    """
    known = names.where(F.col("name") != "").groupBy(doc, "name").agg(F.min(name_order).alias("__o"))
    found = mentions(sentences, known, doc, text, order, more=("__o",)).select(doc, order, "name", "__o")
    # Written once: both who is named and what is handed on are read from it, and the texts are scanned once.
    present = scratch.materialize(found.groupBy(doc, order).agg(F.array_sort(F.collect_list(F.struct("__o", "name"))).alias("who")))
    handed = present.select(doc, F.col("who")[0]["name"].alias("first"), F.col(order).alias("from"), F.explode(F.sequence(F.col(order) + 1, F.col(order) + window)).alias(order))
    recent = handed.groupBy(doc, order).agg(F.max_by("first", "from").alias("recent"))
    said = pronouns.groupBy(doc, order, "pronoun").agg(F.count("*").alias("n"))
    credited = said.join(present, [doc, order], "left").join(recent, [doc, order], "left")
    whom = F.when(F.col("who").isNotNull(), F.col("who")["name"]).when(F.col("recent").isNotNull(), F.array("recent"))
    return credited.select(doc, F.explode(whom).alias("name"), "pronoun", "n").groupBy(doc, "name", "pronoun").agg(F.sum("n").alias("n"))


def _bare(token: str) -> str:
    return "".join(c for c in token if c.isalnum() or c == "_")


def of_text(text: str) -> list[str]:
    """Names of one text: capitalised runs of its sentences that are no stop words, not after a place's preposition and not before a role; runs after a title."""
    out: dict[str, None] = {}
    for sentence in _SENTENCE.split(text):
        tokens = None
        for name in dict.fromkeys(_NAME.findall(sentence)):
            low = name.lower()
            if low in COMMON or len(name) < 2 or all(part in NOT_NAMES for part in _BLANK.split(low)):
                continue
            if _BLANK.search(name) is None:  # only a candidate of one word can equal a token
                tokens = tokens or [_bare(t) for t in _BLANK.split(sentence.lower().strip(" \t\n\x0b\f\r"))]
                beside = [(tokens[i - 1] if i else None, tokens[i + 1] if i + 1 < len(tokens) else None) for i, t in enumerate(tokens) if t == low]
                if any(before in PLACES or after in ROLES for before, after in beside):
                    continue
            out[name] = None
    out |= dict.fromkeys(_TITLED.findall(text))
    return list(out)


def name_candidates(texts: DataFrame, key: str = "doc_id", text: str = "text", top: int = 20) -> DataFrame:
    """(key, name, n, rank): names of a text by how often they stand in it, the top ones; ties by name.

    All of it happens within the row, so nothing is shuffled and repeated keys stay apart. Null texts have no names.
    """
    schema = f"i long, name string, n int, rank int, `{key}` {texts.schema[key].dataType.simpleString()}"

    def run(batches: Iterator):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for i, value in enumerate(batch.column("__text").to_pylist()):
                found = of_text(value) if value else []
                ranked = sorted(zip([-n for n in counted(value, found)], found))[:top] if found else []
                rows += [(i, name, -n, rank) for rank, (n, name) in enumerate(ranked, 1)]
            columns = [pa.array([r[c] for r in rows], kind) for c, kind in enumerate((pa.int64(), pa.string(), pa.int32(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([*columns, batch.column(key).take(columns[0])], ["i", "name", "n", "rank", key])

    return texts.select(key, F.col(text).alias("__text")).mapInArrow(run, schema).select(key, "name", "n", "rank")
