"""N-gram Jaccard join by prefix trees.

Every text is the set of its distinct 5-word shingles (64-bit hashes); two texts link at a Jaccard similarity of
0.8 or more. Equal sets are one class first. Sets are put into one global order, rare shingles first, in which two
similar sets must share one of their first n - ceil(0.8 n) + 1 shingles (their prefix). The order needs no exact
counts: a fixed-size table of counts over all texts moves frequent shingles to the end.

Classes that share prefix shingles gather in clusters around a hub. The sets of a cluster, in blocks of bounded
size, are stored in a prefix tree whose paths are the ordered sets; probing sets walk it, share the overlap counted
on common paths, and leave a branch when what remains of either set is too short. Candidates from two clusters
that are not yet connected go through the same trees afterwards, so no link between components is lost. Links that
cannot change a component are not looked for, so a group of thousands of copies costs few links.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkwell.llm.common import SHINGLE_WORDS, Forest, ascii_words, connected_components, discard, scratch_write, shingle_set, text_bytes, unused, word_hashes

#: Bits of the table of shingle counts, and of the table that marks documents whose sets are needed.
COUNT_BITS, MARK_BITS = 20, 24
#: Documents and shingles of a block, of which a tree holds two at most.
BLOCK_DOCS, BLOCK_SHINGLES = 64, 1 << 18
#: Rows whose sets are held at once.
PART = 1000
#: How often the members of a hub follow it to another, and documents with a shingle that are a crowd.
FOLLOWED, CROWD = 3, 16
#: A shingle may be hot if its bucket has so many documents and so many times the mean; its rows are dealt over SALTS.
HOT_ROWS, HOT_TIMES, SALTS = 1000, 16, 1024


def _bucket(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - COUNT_BITS)).astype(np.int64)


def ordered(shingles: np.ndarray, heavy: np.ndarray) -> np.ndarray:
    """The set in the global order: by count of its bucket (0 unless heavy), then by hash."""
    return shingles[np.lexsort((shingles, heavy[_bucket(shingles)]))]


def prefix_length(n: int) -> int:
    return n - (4 * n + 4) // 5 + 1


def _sets(batches: Iterator) -> Iterator[tuple[object, list, list[np.ndarray]]]:
    for whole in batches:
        for begin in range(0, whole.num_rows, PART):
            batch = whole.slice(begin, PART)
            yield batch, batch.column("__id").to_pylist(), [shingle_set(word_hashes(ascii_words(t))) for t in batch.column("__text").to_pylist()]


def _read(documents: DataFrame, key: str, text: str) -> DataFrame:
    return documents.select(F.col(key).cast("long").alias("__id"), text_bytes(text).alias("__text"))


def fingerprints(documents: DataFrame, key: str, text: str) -> DataFrame:
    """kind 0: a document's id (a), 128-bit fingerprint of its set (b, c), set size (n) and text hash (h). kind 1: a bucket (a) and its count (n).

    A task reports buckets whose count is over twice its mean and over 2; the others count as rare.
    """

    def run(batches: Iterator):
        import pyarrow as pa

        counts = np.zeros(1 << COUNT_BITS, np.int64)
        schema = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("c", pa.int64()), ("n", pa.int64()), ("h", pa.int64())])
        for batch, ids, sets in _sets(batches):
            prints = np.frombuffer(b"".join(hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets), np.int64).reshape(-1, 2)
            if sets:
                counts += np.bincount(_bucket(np.concatenate(sets)), minlength=len(counts))
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(ids), np.int32)), pa.array(ids, pa.int64()), pa.array(prints[:, 0]), pa.array(prints[:, 1]), pa.array([len(s) for s in sets], pa.int64()), batch.column("__h")], schema=schema)
        heavy = np.flatnonzero(counts > max(2.0, 2 * counts.mean()))
        zeros = pa.array(np.zeros(len(heavy), np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(heavy), np.int32)), pa.array(heavy), zeros, zeros, pa.array(counts[heavy]), zeros], schema=schema)

    return _read(documents, key, text).withColumn("__h", F.xxhash64("__text")).mapInArrow(run, "kind int, a long, b long, c long, n long, h long")


def _heavy(counted: DataFrame) -> Broadcast:
    """Counts of the reported buckets, sent to all tasks once: at most 2 ** COUNT_BITS rows, whatever the input's size."""
    table = counted.groupBy("a").agg(F.least(F.sum("n"), F.lit(2**31 - 1)).cast("int").alias("n")).toArrow()
    heavy = np.zeros(1 << COUNT_BITS, np.int32)
    heavy[table.column("a").to_numpy()] = table.column("n").to_numpy()
    return counted.sparkSession.sparkContext.broadcast(heavy)


def prefixes(documents: DataFrame, shared: Broadcast, key: str, text: str) -> DataFrame:
    """(token, doc, n, hot): the prefix shingles of each set; of equal sets in a part of a batch, those of the smallest id."""
    least_hot = max(HOT_ROWS, HOT_TIMES * float(shared.value.mean()))

    def run(batches: Iterator):
        import pyarrow as pa

        for _, ids, sets in _sets(batches):
            least: dict[bytes, int] = {}
            for i, s in enumerate(sets):
                if len(s) and ids[i] is not None:
                    print_ = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                    if print_ not in least or ids[i] < ids[least[print_]]:
                        least[print_] = i
            for begin in range(0, len(least), 500):
                some = list(least.values())[begin : begin + 500]
                tokens = [ordered(sets[i], shared.value)[: prefix_length(len(sets[i]))] for i in some]
                lengths = [len(t) for t in tokens]
                flat = np.concatenate(tokens)
                yield pa.RecordBatch.from_arrays([pa.array(flat.view(np.int64)), pa.array(np.repeat(np.array([ids[i] for i in some], np.int64), lengths)), pa.array(np.repeat(np.array([len(sets[i]) for i in some], np.int64), lengths)), pa.array(shared.value[_bucket(flat)] >= least_hot)], ["token", "doc", "n", "hot"])

    return _read(documents, key, text).mapInArrow(run, "token long, doc long, n long, hot boolean")


def _marked_sets(documents: DataFrame, wanted: DataFrame, heavy: Broadcast, key: str, text: str) -> DataFrame:
    """(doc, set): ordered sets (binary) of at least the wanted documents.

    wanted(doc) becomes a bit table of fixed size; a false mark costs a set that the next join drops.
    """
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << MARK_BITS))
    bits = wanted.select(slot(F.col("doc").cast("long")).alias("s")).groupBy(F.shiftright("s", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(s & 63 as int)))").alias("bits")).toArrow()
    marks = np.zeros(1 << MARK_BITS - 6, np.int64)
    marks[bits.column("word").to_numpy()] = bits.column("bits").to_numpy()
    shared = documents.sparkSession.sparkContext.broadcast(marks.view(np.uint64))

    def run(batches: Iterator):
        import pyarrow as pa

        for batch in batches:
            marks = shared.value
            slots = batch.column("__slot").to_numpy()
            keep = np.flatnonzero((marks[slots >> 6] >> (slots & 63).astype(np.uint64)) & np.uint64(1))
            texts, ids = batch.column("__text"), batch.column("__id")
            for begin in range(0, len(keep), 500):
                some = keep[begin : begin + 500]
                sets = [ordered(shingle_set(word_hashes(ascii_words(texts[int(i)].as_py()))), heavy.value).tobytes() for i in some]
                yield pa.RecordBatch.from_arrays([pa.array([ids[int(i)].as_py() for i in some], pa.int64()), pa.array(sets, pa.binary())], ["doc", "set"])

    source = _read(documents, key, text).where("__id is not null").withColumn("__slot", slot(F.col("__id")))
    return source.mapInArrow(run, "doc long, set binary")


class PrefixTree:
    """Ordered sets (ascending integers) by their common beginnings; a node holds what its sets share beyond its parent."""

    def __init__(self, sets: list[np.ndarray]):
        order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">i4").tobytes())
        self.root = self._node(sets, order, 0)

    def _node(self, sets, order, depth):
        """(shared integers, depth at their end, smallest and largest size below, ids that end here, children)."""
        first, last = sets[order[0]], sets[order[-1]]
        size = min(len(first), len(last))
        differ = np.flatnonzero(first[depth:size] != last[depth:size])
        end = depth + int(differ[0]) if len(differ) else size
        ends, children, begin = [], [], 0
        while begin < len(order) and len(sets[order[begin]]) == end:
            ends.append(order[begin])
            begin += 1
        while begin < len(order):
            head, stop = sets[order[begin]][end], begin + 1
            while stop < len(order) and sets[order[stop]][end] == head:
                stop += 1
            children.append(self._node(sets, order[begin:stop], end))
            begin = stop
        sizes = [len(sets[i]) for i in order]
        return first[depth:end], end, min(sizes), max(sizes), ends, children, order

    def probe(self, x: np.ndarray, inside: np.ndarray, done) -> Iterator[int]:
        """Ids of stored sets with Jaccard similarity of 0.8 or more with x. inside marks the integers of x; done(ids) is whether none of them matters any more."""
        n, stack = len(x), [(self.root, 0)]
        while stack:
            (shared, depth, least, most, ends, children, below), overlap = stack.pop()
            if done(below):
                continue
            begin, step, alive = 0, 32, True
            while begin < len(shared):
                part = shared[begin : begin + step]
                overlap += int(np.count_nonzero(inside[part]))
                begin += len(part)
                step *= 2
                at = depth - len(shared) + begin
                left = n - int(np.searchsorted(x, part[-1], "right"))
                size = min(max(at + left, least), most)  # the size that allows the greatest similarity
                if 9 * (overlap + min(size - at, left)) < 4 * (n + size):
                    alive = False
                    break
            if alive:
                yield from (i for i in ends if 9 * overlap >= 4 * (n + depth))
                stack += [(child, overlap) for child in children]


def tree_links(docs: list[int], sides: list[int], sets: list[np.ndarray], heavy: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what the similar pairs connect: pairs within side 0 if there is no side 1, else across."""
    every = np.unique(np.concatenate(sets))
    every = ordered(every, heavy)
    back = np.argsort(every, kind="stable")
    local = [np.sort(back[np.searchsorted(every, s, sorter=back)]).astype(np.int32) for s in sets]
    cross = any(sides)
    stored = [i for i in range(len(docs)) if sides[i] or not cross]
    probing = [i for i in range(len(docs)) if not sides[i]]
    if not stored or not probing:
        return []
    tree, forest, links = PrefixTree([local[i] for i in stored]), Forest(), []
    inside = np.zeros(len(every), bool)
    for i in probing:
        inside[local[i]] = True
        done = lambda ids, i=i: all(forest.find(docs[stored[j]]) == forest.find(docs[i]) for j in ids) if len(ids) < 8 else False
        for j in tree.probe(local[i], inside, done):
            if forest.join(docs[i], docs[stored[j]]):
                links.append((docs[i], docs[stored[j]]))
        inside[local[i]] = False
    return links


def _links_of_blocks(blocks: DataFrame, sets: DataFrame, heavy: Broadcast) -> DataFrame:
    """blocks(g, h, i, doc, side): each (g, h, i) is one tree. Links (a, b)."""

    def run(table):
        import pyarrow as pa

        sets = [np.frombuffer(s, np.uint64) for s in table.column("set").to_pylist()]
        links = tree_links(table.column("doc").to_pylist(), table.column("side").to_pylist(), sets, heavy.value)
        return pa.table([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], names=["a", "b"])

    # One plan at every size: a broadcast of small inputs would only hide what large ones shuffle.
    return blocks.join(sets.hint("merge"), "doc").groupBy("g", "h", "i").applyInArrow(run, "a long, b long")


def _block_pairs(members: DataFrame) -> DataFrame:
    """members(g, doc, n) as blocks of bounded size and all pairs of blocks of the same g."""
    sized = members.groupBy("g").agg(F.count("*").alias("docs"), F.sum("n").alias("n")).where("docs > 1")
    sized = sized.select("g", F.greatest(F.ceil(F.col("docs") / BLOCK_DOCS), F.ceil(F.col("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    placed = members.join(sized, "g").withColumn("own", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int"))
    paired = placed.select("g", "doc", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    return paired.select("g", F.least("own", "other").alias("h"), F.greatest("own", "other").alias("i"), "doc", (F.col("own") > F.col("other")).cast("int").alias("side"))


def components(documents: DataFrame, key: str = "doc_id", text: str = "text", hashed: bool = False) -> DataFrame:
    """(key, n_shingles, component_id) for every row of documents; if hashed, also __h, its text's hash.

    A null or empty text has an empty set and links with nothing; a null key has a null component. Rows of one key
    are one document: what links one of them links all. Other columns are not read; an empty table gives an empty
    result.
    """
    spark, made = documents.sparkSession, []

    def materialize(df: DataFrame) -> DataFrame:
        made.append(scratch_write(df))
        return spark.read.parquet(made[-1])

    root = scratch_write(fingerprints(documents, key, text), "kind")
    table = spark.read.schema("kind int, a long, b long, c long, n long, h long").parquet(root)
    rows = table.where("kind = 0").select("a", "b", "c", "n", "h")
    heavy = _heavy(table.where("kind = 1"))
    classes = materialize(rows.where("n > 0 and a is not null").groupBy("b", "c").agg(F.min("a").alias("doc"), F.first("n").alias("n")))
    kept = [made.pop()]
    # A key that several classes have, as it was given with several texts, links them.
    repeated = rows.join(classes.select("b", "c", "doc"), ["b", "c"]).where("a <> doc").join(classes.select(F.col("doc").alias("a")), "a", "left_semi").select("a", F.col("doc").alias("b"))
    # Prefix shingles that at least two classes have. Those that may be hot are dealt by salt here and counted below.
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("doc"), F.lit(SALTS))).otherwise(0).alias("salt")
    first = prefixes(documents, heavy, key, text).select("*", salt).withColumn("m", F.count("*").over(Window.partitionBy("token", "salt"))).where("hot or m > 1").drop("m", "salt")
    first = materialize(first.join(classes.select("doc").distinct(), "doc", "left_semi"))
    by_token = Window.partitionBy("token")
    sign = F.xxhash64("doc").cast("decimal(20,0)")
    cold = first.where("not hot").select("token", "doc", "n", F.count("*").over(by_token).alias("m"), F.min("doc").over(by_token).alias("hub"), F.sum(sign).over(by_token).cast("string").alias("sign"))
    # Hot ones are added up before they are shuffled, and come back by a join that Spark can split.
    sums = first.where("hot").groupBy("token").agg(F.count("*").alias("m"), F.min("doc").alias("hub"), F.sum(sign).cast("string").alias("sign")).where("m > 1")
    warm = first.where("hot").select("token", "doc", "n").join(sums, "token").select("token", "doc", "n", "m", "hub", "sign")
    tokens = materialize(cold.where("m > 1").union(warm))
    # Each class joins the hub that most of its shared shingles have.
    votes = tokens.groupBy("doc", "n", "hub").agg(F.count("*").alias("v"))
    ranked = F.max(F.struct("v", (-F.col("hub")).alias("minus")))
    votes = materialize(votes.groupBy("doc", "n").agg(ranked.alias("b")).select("doc", "n", (-F.col("b.minus")).alias("g"), "b.v"))
    # A hub that shares a fifth of its prefix with a hub of its own takes its members there: families of copies
    # gather in one cluster, chance meetings of a shingle or two do not.
    follow = votes.where((F.col("g") < F.col("doc")) & (5 * F.col("v") >= F.expr("n div 5 + 1"))).select(F.col("doc").alias("g"), F.col("g").alias("next"))
    clusters = votes.select("doc", "n", "g")
    for _ in range(FOLLOWED):
        clusters = clusters.join(follow, "g", "left").select("doc", "n", F.coalesce("next", "g").alias("g"))
    clusters = materialize(clusters)
    inner = materialize(_block_pairs(clusters))
    links = materialize(repeated.union(_links_of_blocks(inner, _marked_sets(documents, inner.select("doc"), heavy, key, text), heavy)))
    joined = materialize(connected_components(links))
    # Candidates of two clusters that are not connected yet; shingles with the same classes count together.
    placed = clusters.join(joined.select(F.col("id").alias("doc"), "component"), "doc", "left").select("doc", "g", F.coalesce("component", "doc").alias("component"))
    groups = tokens.join(placed, "doc")
    mixed = groups.groupBy("token").agg(F.min("g").alias("g0"), F.max("g").alias("g1"), F.min("component").alias("c0"), F.max("component").alias("c1"), F.first("m").alias("m"), F.first("hub").alias("hub"), F.first("sign").alias("sign")).where("g0 < g1 and c0 < c1")
    alike = mixed.groupBy("m", "hub", "sign").agg(F.min("token").alias("token"), F.count("*").alias("weight")).select("token", "weight")
    sparse = materialize(groups.join(alike, "token").select("token", "weight", "doc", "n", "g", "component"))
    # Families of copies that lie across clusters gather once more, around the hubs of their large shared groups;
    # documents that share less than a tenth of their prefix there are no family.
    crowds = sparse.join(sparse.groupBy("token").agg(F.count("*").alias("crowd"), F.min("doc").alias("hub")).where(F.col("crowd") >= CROWD), "token")
    again = crowds.groupBy("doc", "n", "hub").agg(F.sum("weight").alias("v")).groupBy("doc", "n").agg(F.max(F.struct("v", (-F.col("hub")).alias("minus"))).alias("b"))
    again = materialize(again.where(10 * F.col("b.v") >= F.expr("n div 5 + 1")).select("doc", "n", (-F.col("b.minus")).alias("g")))
    across = materialize(_block_pairs(again))
    if not across.isEmpty():
        links = materialize(links.union(_links_of_blocks(across, _marked_sets(documents, across.select("doc"), heavy, key, text), heavy)))
        joined = materialize(connected_components(links))
    sparse = sparse.drop("component").join(joined.select(F.col("id").alias("doc"), "component"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    sparse = materialize(sparse.join(again.select("doc", F.col("g").alias("again")), "doc", "left"))
    left, right = (sparse.select("token", *(["weight"] if s == "a" else []), *(F.col(c).alias(f"{c}_{s}") for c in ("doc", "n", "g", "component", "again"))) for s in "ab")
    met = (F.col("g_a") == F.col("g_b")) | (F.col("component_a") == F.col("component_b")) | F.coalesce(F.col("again_a") == F.col("again_b"), F.lit(False))
    pairs = left.join(right, (left.token == right.token) & (F.col("doc_a") < F.col("doc_b")) & ~met & (5 * F.least("n_a", "n_b") >= 4 * F.greatest("n_a", "n_b")))
    rest = lambda s: F.expr(f"ceil(4 * n_{s} / 5) - 1")  # noqa: E731  shingles behind the prefix
    pairs = pairs.groupBy("doc_a", "doc_b", "n_a", "n_b").agg(F.sum("weight").alias("shared")).where(9 * (F.col("shared") + F.greatest(rest("a"), rest("b"))) >= 4 * (F.col("n_a") + F.col("n_b")))
    pairs = materialize(pairs.select("doc_a", "doc_b"))
    if not pairs.isEmpty():
        wide = pairs.join(pairs.groupBy("doc_a").agg(F.ceil(F.count("*") / BLOCK_DOCS).alias("parts")), "doc_a").select(F.col("doc_a").alias("g"), F.pmod(F.xxhash64("doc_b"), F.col("parts")).cast("int").alias("h"), F.lit(0).alias("i"), "doc_b")
        outer = materialize(wide.select("g", "h", "i", F.explode(F.array(F.struct(F.col("g").alias("doc"), F.lit(0).alias("side")), F.struct(F.col("doc_b").alias("doc"), F.lit(1).alias("side")))).alias("e")).select("g", "h", "i", "e.*").distinct())
        more = materialize(_links_of_blocks(outer, _marked_sets(documents, outer.select("doc"), heavy, key, text), heavy))
        joined = connected_components(links.union(more))
    kept.append(scratch_write(joined))
    joined = spark.read.parquet(kept[-1])
    discard(spark, *made)
    named = classes.join(joined, classes.doc == joined.id, "left").select("b", "c", F.coalesce("component", "doc").alias("component_id"))
    out = rows.join(named, ["b", "c"], "left")
    return out.select(F.col("a").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("a").isNotNull() & (F.col("n") > 0), F.coalesce("component_id", "a")).otherwise(F.col("a")).alias("component_id"), *([F.col("h").alias("__h")] if hashed else []))


def distinct_documents(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component: that whose key is the component's id. Of repeated rows one stays; rows without a key all stay."""
    own, place, chosen, digest = (unused(stem, documents.columns) for stem in ("__own", "__n", "__key", "__h"))
    keep = components(documents, key, text, hashed=True).where(F.col(key) == F.col("component_id")).select(F.col(key).alias(chosen), F.col("__h").alias(digest)).distinct()
    marked = documents.withColumn(own, F.xxhash64(text_bytes(text)))
    joined = marked.join(keep, (F.col(key) == F.col(chosen)) & (F.col(own) == F.col(digest)), "left_semi")
    one = joined.withColumn(place, F.row_number().over(Window.partitionBy(key, own).orderBy(key, own))).where(F.col(place) == 1)
    return one.drop(place, own).unionByName(documents.where(F.col(key).isNull()))
