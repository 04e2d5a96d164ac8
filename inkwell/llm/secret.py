"""Secret scans by grammar inference.

What the base patterns find is labelled credentials: the values behind a keyword, access keys, hex strings. From a
bounded sample of distinct values of each kind, and from a sample of ordinary runs of the same characters, a
probabilistic automaton is inferred: the prefix tree's states are merged where their strings go on in statistically
compatible ways (Hoeffding's bound on ends, classes of characters and characters, and so on down the tree), first
with states of the same depth, so that what a format's length tells is kept, then with earlier ones, so that what is
free in length becomes a loop. Every run of credential characters in every text is then scored. It is a secret if it
is far likelier under some kind's automaton than under that of ordinary runs, ends where the format may end, and is
typical of the kind: its log likelihood is no further below what the automaton itself expects along its path than
that of labelled values which the automaton hasn't seen.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import discard, parts, scratch_write, text_bytes

# Fixed values of the base patterns: keywords (ASCII letters in either case), signs of a value, least lengths.
ASSIGN = re.compile(rb"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
SIGNS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
HEX = b"0123456789abcdef"
LEAST = {"assign": 12, "access": 18, "hex": 16, "format": 12}
#: Kinds of spans in the order of a tie; format is what the automata add.
KINDS = ("assign", "access", "hex", "format")
#: Runs of credential characters that are no base match.
PLAIN = "plain"

#: Distinct values of a kind that are sampled (one of five for thresholds) and the longest of them; fewer than LEAST_VALUES make no automaton.
SAMPLE_VALUES, SAMPLE_LENGTH, LEAST_VALUES = 2500, 256, 10
#: Error level of a merge test, and states of one depth at most.
ALPHA, DEPTH_STATES = 0.05, 32
#: Natural log of the odds against an ordinary run that a secret needs; standard deviations below the expected log likelihood that are allowed at least and at most.
ODDS, LEAST_Z, MOST_Z = math.log(10_000), 3.0, 6.0
#: Times that secrets are taken out of the sample of ordinary runs.
PLAIN_ROUNDS = 3
#: Bytes of text that are scanned together.
BLOCK_BYTES = 1 << 20

END = len(SIGNS)
_CODE = np.full(256, 255, np.uint8)
_CODE[np.frombuffer(SIGNS, np.uint8)] = np.arange(len(SIGNS), dtype=np.uint8)
_IS_HEX = np.isin(np.arange(256), np.frombuffer(HEX, np.uint8))
_IS_SIGN = _CODE < END
#: Classes of symbols that are tested beside the symbols: capitals, small letters, digits, other signs, the end.
_CLASS = np.zeros((END + 1, 5))
_CLASS[np.arange(END + 1), [0] * 26 + [1] * 26 + [2] * 10 + [3] * (END - 62) + [4]] = 1


def _bound(n: float, m: float) -> float:
    """Hoeffding: how far two frequencies of n and m draws of one source may lie apart."""
    return math.sqrt(0.5 * math.log(2 / ALPHA)) * (1 / math.sqrt(n) + 1 / math.sqrt(m))


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two count vectors over symbols and the end may be of one source."""
    n, m = a.sum(), b.sum()
    if not n or not m or (bound := _bound(n, m)) >= 1:
        return True
    apart = a / n - b / m
    return bool(np.abs(apart).max() <= bound and np.abs(apart @ _CLASS).max() <= bound)


class Automaton:
    """A probabilistic automaton over SIGNS: counts[state, symbol or end], goto[state, symbol] (-1: none); state 0 begins."""

    def __init__(self, counts: np.ndarray, goto: np.ndarray):
        self.counts, self.goto = counts, goto
        n, kinds = counts.sum(1, keepdims=True), (counts > 0).sum(1, keepdims=True)
        whole = counts.sum(0) + 0.5
        rest = whole / whole.sum()
        chance = np.where(n > 0, (counts + kinds * rest) / np.maximum(n + kinds, 1), rest)
        # One more state for strings that left the automaton: symbols by their share, each at a tenth of it.
        chance = np.vstack([chance, rest])
        log = np.log(chance)
        self.expected = -(chance * log).sum(1)
        self.spread = (chance * log**2).sum(1) - self.expected**2
        log[-1] -= math.log(10)
        self.log, self.ends = log, np.append(counts[:, END] > 0, False)
        # An unseen symbol of a class that was seen goes where most go; one of another class leaves the automaton.
        most = goto[np.arange(len(goto)), counts[:, :END].argmax(1)]
        usual = np.where((counts @ _CLASS > 0) @ _CLASS[:END].T > 0, np.where(most < 0, len(counts), most)[:, None], len(counts))
        self.next = np.vstack([np.where(goto < 0, usual, goto), np.full(goto.shape[1], len(counts))])

    def score(self, values: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log likelihood of each whole value, how many standard deviations it lies above what is expected on its path, and whether a learnt value ended where it ends."""
        lengths = np.array([len(v) for v in values], np.int64)
        order = np.argsort(-lengths, kind="stable")
        codes = _CODE[np.frombuffer(b"".join(values), np.uint8)]
        begins = (np.cumsum(lengths) - lengths)[order]
        state, total, expected, spread = np.zeros(len(values), np.int64), *(np.zeros(len(values)) for _ in range(3))
        left = np.searchsorted(-lengths[order], -np.arange(lengths.max(initial=0) + 1), "left")  # how many are longer than each place
        for at in range(int(lengths.max(initial=0))):
            n = left[at]
            now = state[:n]
            code = codes[begins[:n] + at]
            total[:n] += self.log[now, code]
            expected[:n] += self.expected[now]
            spread[:n] += self.spread[now]
            state[:n] = self.next[now, code]
        total += self.log[state, END]
        expected += self.expected[state]
        spread += self.spread[state]
        out, z, ends = np.empty(len(values)), np.empty(len(values)), np.empty(len(values), bool)
        out[order], z[order], ends[order] = total, (total + expected) / np.sqrt(spread + 1), self.ends[state]
        return out, z, ends


def infer(values: list[bytes]) -> Automaton:
    """The automaton of some values: their prefix tree, folded where it is statistically compatible."""
    counts, goto = _layers(values)
    return _loops(counts, goto)


def _layers(values: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The prefix tree with its states merged within each depth, largest first. A state is the set of values that pass it."""
    width = max((len(v) for v in values), default=0) + 1
    rows = np.full((len(values), width), END, np.uint8)
    for row, value in zip(rows, values):
        row[: len(value)] = _CODE[np.frombuffer(value, np.uint8)]

    def tally(members, depth):
        return np.bincount(rows[members, depth], minlength=END + 1).astype(float)

    def compatible(a, b, depth):
        if _bound(len(a), len(b)) >= 1:
            return True
        x, y = tally(a, depth), tally(b, depth)
        if not alike(x, y):
            return False
        on = [s for s in np.flatnonzero((x > 0) & (y > 0)) if s != END and _bound(x[s], y[s]) < 1]
        return all(compatible(a[rows[a, depth] == s], b[rows[b, depth] == s], depth + 1) for s in on)

    counts, goto, level, depth = [], [], [np.arange(len(values))], 0
    while level:
        blue = []
        for members in level:
            own = tally(members, depth)
            blue += [(len(counts), s, members[rows[members, depth] == s]) for s in np.flatnonzero(own[:END])]
            counts.append(own)
            goto.append(np.full(END, -1, np.int64))
        level, depth = [], depth + 1
        for state, symbol, members in sorted(blue, key=lambda x: (-len(x[2]), x[0], x[1])):
            fits = [i for i, red in enumerate(level) if compatible(red, members, depth)]
            if not fits and len(level) == DEPTH_STATES:  # into the one that goes on most like it
                own = tally(members, depth) / len(members)
                fits = [min(range(len(level)), key=lambda i: np.abs(tally(level[i], depth) / len(level[i]) - own).sum())]
            if fits:
                level[fits[0]] = np.concatenate([level[fits[0]], members])
            else:
                level.append(members)
            goto[state][symbol] = len(goto) + (fits[0] if fits else len(level) - 1)
    return np.array(counts), np.array(goto)


def _loops(counts: np.ndarray, goto: np.ndarray) -> Automaton:
    """Merges each state, shallow ones first, with the first earlier state that is compatible to the end of both."""
    parent = list(range(len(counts)))
    tally, steps = {i: c for i, c in enumerate(counts)}, {i: {int(s): int(t) for s, t in enumerate(row) if t >= 0} for i, row in enumerate(goto)}

    def folded(red, blue):
        """What changes if both are one: parents, counts and steps; nothing if some states that fall together aren't alike."""
        up, own, go, todo = {}, {}, {}, [(red, blue)]

        def find(x):
            while (y := up.get(x, parent[x])) != x:
                x = y
            return x

        while todo:
            a, b = (find(x) for x in todo.pop())
            if a == b:
                continue
            a, b = min(a, b), max(a, b)
            x, y = own.get(a, tally[a]), own.get(b, tally[b])
            if not alike(x, y):
                return None
            up[b], own[a] = a, x + y
            here = dict(go.get(a, steps[a]))
            for symbol, to in go.get(b, steps[b]).items():
                if symbol in here:
                    todo.append((here[symbol], to))
                else:
                    here[symbol] = to
            go[a] = here
        return up, own, go

    red = [0]
    for blue in range(1, len(counts)):
        if parent[blue] != blue:
            continue
        for other in red:
            if parent[other] == other and (change := folded(other, blue)):
                up, own, go = change
                for state, to in up.items():
                    parent[state] = to
                tally |= own
                steps |= go
                break
        else:
            red.append(blue)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    kept = sorted(i for i in range(len(counts)) if parent[i] == i)
    number = {state: i for i, state in enumerate(kept)}
    out = np.full((len(kept), END), -1, np.int64)
    for state in kept:
        for symbol, to in steps[state].items():
            out[number[state], symbol] = number[find(to)]
    return Automaton(np.array([tally[s] for s in kept]) if kept else np.zeros((1, END + 1)), out if kept else np.full((1, END), -1, np.int64))


class Formats:
    """The automata of the labelled kinds with their thresholds, and that of ordinary runs."""

    def __init__(self, samples: dict[str, list[bytes]]):
        """samples: kind -> distinct values in the order of their hashes."""
        self.kinds: list[tuple[str, Automaton, float]] = []
        for kind in KINDS[:3]:
            values = samples.get(kind, [])
            if len(values) < LEAST_VALUES:
                continue
            model = infer([v for i, v in enumerate(values) if i % 5])
            z = model.score([v for i, v in enumerate(values) if i % 5 == 0])[1]
            self.kinds.append((kind, model, -min(max(-float(np.quantile(z, 0.01)), LEAST_Z), MOST_Z)))
        # Among the ordinary runs there are secrets that no base pattern found: those that a kind explains better.
        plain = samples.get(PLAIN, [])
        self.plain = infer(plain)
        for _ in range(PLAIN_ROUNDS):
            odds = self._odds(plain)[1]
            if not plain or not (odds > 0).any():
                break
            plain = [v for v, x in zip(plain, odds) if x <= 0]
            self.plain = infer(plain)
        self.known: dict[bytes, tuple[bool, float]] = {}

    def _odds(self, values: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Largest log odds of a kind against ordinary runs, and the same of kinds that a value is typical of."""
        usual = self.plain.score(values)[0]
        best, typical = (np.full(len(values), -np.inf) for _ in range(2))
        for _, model, least in self.kinds:
            likely, z, ends = model.score(values)
            best = np.maximum(best, likely - usual)
            typical = np.maximum(typical, np.where((z >= least) & ends, likely - usual, -np.inf))
        return best, typical

    def judge(self, values: list[bytes]) -> list[tuple[bool, float]]:
        """For each value whether it is a secret by its format, and the largest log odds of a kind against ordinary runs."""
        if len(self.known) > 100_000:
            self.known.clear()
        new = list({v for v in values if v not in self.known})
        if new and self.kinds:
            best, typical = self._odds(new)
            self.known.update(zip(new, zip((typical >= ODDS).tolist(), best.tolist())))
        return [self.known.get(v, (False, -math.inf)) for v in values]


def _runs(flags: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the longest stretches of set flags with `least` or more; the last flag is unset."""
    edge = np.flatnonzero(np.diff(flags.view(np.int8), prepend=0))
    begins, ends = edge[::2], edge[1::2]
    long = ends - begins >= least
    return begins[long], ends[long]


class Block:
    """Texts in UTF-8 that are scanned together, a line feed behind each: no pattern goes across."""

    def __init__(self, texts: list[bytes]):
        self.data = b"\n".join([*texts, b""])
        self.array = np.frombuffer(self.data, np.uint8)
        sizes = np.array([len(t) + 1 for t in texts], np.int64)
        self.begins = np.cumsum(sizes) - sizes

    def base(self) -> list[tuple[int, int, int, bytes]]:
        """(begin, place in KINDS, end, value) of all base matches, in bytes of the block, by begin and kind."""
        out = [(m.start(), 0, m.end(), self.data[slice(*m.span(1))]) for m in ASSIGN.finditer(self.data.lower()) if m.end(1) - m.start(1) >= LEAST["assign"]]
        out += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(self.data) if len(m[0]) >= LEAST["access"]]
        out += [(b, 2, e, self.data[b:e]) for b, e in zip(*(x.tolist() for x in _runs(_IS_HEX[self.array], LEAST["hex"])))]
        return sorted(out)

    def candidates(self, base: list) -> list[tuple[int, int]]:
        """Runs of credential characters without dots, dashes and underscores around them, long enough and not within a base match."""
        out, at, reach = [], 0, -1
        for begin, end in zip(*(x.tolist() for x in _runs(_IS_SIGN[self.array], LEAST["format"]))):
            run = self.data[begin:end]
            begin, end = end - len(run.lstrip(b".-_")), begin + len(run.rstrip(b".-_"))
            if end - begin < LEAST["format"]:
                continue
            while at < len(base) and base[at][0] <= begin:
                reach = max(reach, base[at][2])
                at += 1
            if end > reach:
                out.append((begin, end))
        return out

    def places(self, positions: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """The text of each position, and how many code points of that text stand before it."""
        at = np.array(positions, np.int64)
        row = np.searchsorted(self.begins, at, "right") - 1
        points = np.concatenate([[0], np.cumsum((self.array & 0xC0) != 0x80, dtype=np.int64)])
        return row, points[at] - points[self.begins[row]]


def _blocks(batches: Iterator, size: int = BLOCK_BYTES) -> Iterator:
    for batch in parts(batches):
        texts, begin, total = batch.column("__text").to_pylist(), 0, 0
        for i, text in enumerate(texts):
            total += len(text)
            if total >= size or i + 1 == len(texts):
                yield batch.slice(begin, i + 1 - begin), texts[begin : i + 1]
                begin, total = i + 1, 0


def labelled(documents: DataFrame, text: str = "text", most: int = SAMPLE_VALUES) -> DataFrame:
    """(kind, hash, value): distinct base values and ordinary runs, of each task those of the smallest hashes; so those of the smallest hashes of all are among them."""

    def run(batches: Iterator):
        import pyarrow as pa
        from xxhash import xxh3_64_intdigest

        held: dict[str, dict[bytes, int]] = {k: {} for k in (*KINDS[:3], PLAIN)}

        def fewest(values):
            return dict(sorted(values.items(), key=lambda x: (x[1], x[0]))[:most])

        for _, texts in _blocks(batches):
            block = Block(texts)
            base = block.base()
            found = [(KINDS[k], v) for _, k, _, v in base] + [(PLAIN, block.data[b:e]) for b, e in block.candidates(base)]
            for kind, value in found:
                if len(value) <= SAMPLE_LENGTH and value not in held[kind]:
                    held[kind][value] = xxh3_64_intdigest(value) >> 1
                    if len(held[kind]) >= 4 * most:
                        held[kind] = fewest(held[kind])
        for kind, values in held.items():
            values = fewest(values)
            yield pa.RecordBatch.from_arrays([pa.array([kind] * len(values), pa.string()), pa.array(values.values(), pa.int64()), pa.array(values, pa.binary())], ["kind", "hash", "value"])

    return documents.select(text_bytes(text).alias("__text")).mapInArrow(run, "kind string, hash long, value binary")


def samples(credentials: DataFrame, most: int = SAMPLE_VALUES) -> dict[str, list[bytes]]:
    """Of each kind the `most` distinct values of the smallest hashes, in their order.

    Counts by ranges of hashes tell first from where on there are too many; so the driver gets `most` values of a kind
    and those of one range in 1,024 more, each of SAMPLE_LENGTH bytes at most.
    """
    step = F.shiftright("hash", 53)
    sizes: dict[str, list] = {}
    for row in credentials.groupBy("kind", step.alias("step")).agg(F.count("*").alias("n")).collect():
        sizes.setdefault(row["kind"], []).append((row["step"], row["n"]))
    wanted = F.lit(False)
    for kind, steps in sizes.items():
        total, last = 0, -1
        for last, n in sorted(steps):
            total += n
            if total >= most:
                break
        wanted |= (F.col("kind") == kind) & (step <= last)
    out: dict[str, list] = {}
    for row in credentials.where(wanted).collect():
        out.setdefault(row["kind"], []).append((row["hash"], bytes(row["value"])))
    return {kind: [v for _, v in sorted(values)[:most]] for kind, values in out.items()}


def fit(documents: DataFrame, text: str = "text", most: int = SAMPLE_VALUES) -> Formats:
    """Learns the formats of what the base patterns find in documents; the rest of the table isn't looked at."""
    path = scratch_write(labelled(documents, text, most).distinct())
    found = samples(documents.sparkSession.read.parquet(path), most)
    discard(documents.sparkSession, path)
    return Formats(found)


def scan(documents: DataFrame, formats: Formats, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns keep, n_assign, n_access, n_hex, n_format (long), base_spans and spans (strings), score (double).

    Spans are kind:start:end in code points, end exclusive, by start, then kind as in KINDS, joined by commas;
    base_spans are those of the base patterns, leftmost and non-overlapping within a kind; spans has those of the
    automata (kind format) too. score is the largest log odds of a run that is no base match against an ordinary one,
    -inf without such a run. Null and empty texts have none of all; repeated rows stay; an empty table gives no rows;
    no text is too long. keep must not hold one of the result's names; other columns of any name are left out.
    """
    made = ["n_assign", "n_access", "n_hex", "n_format", "base_spans", "spans", "score"]
    if clash := set(made) & {k.lower() for k in keep}:
        raise ValueError(f"columns to keep have the names of results: {sorted(clash)}")
    fields = [documents.schema[k] for k in keep]
    inner = [f"__k{i}" for i in range(len(keep))]
    schema = ", ".join([*(f"`{i}` {f.dataType.simpleString()}" for i, f in zip(inner, fields)), "n_assign long, n_access long, n_hex long, n_format long, base_spans string, spans string, score double"])

    def run(batches: Iterator):
        import pyarrow as pa

        for batch, texts in _blocks(batches):
            block = Block(texts)
            base = block.base()
            runs = block.candidates(base)
            judged = formats.judge([block.data[b:e] for b, e in runs])
            found = sorted([x[:3] for x in base] + [(b, 3, e) for (b, e), (yes, _) in zip(runs, judged) if yes])
            row, begins = block.places([x[0] for x in found])
            _, ends = block.places([x[2] for x in found])
            counts = np.zeros((len(texts), 4), np.int64)
            names: list[list[str]] = [[] for _ in texts]
            for r, (_, kind, _), begin, end in zip(row.tolist(), found, begins.tolist(), ends.tolist()):
                counts[r, kind] += 1
                names[r].append(f"{KINDS[kind]}:{begin}:{end}")
            score = np.full(len(texts), -np.inf)
            np.maximum.at(score, block.places([b for b, _ in runs])[0], [odds for _, odds in judged])
            columns = [batch.column(i) for i in inner] + [pa.array(counts[:, k]) for k in range(4)]
            columns += [pa.array([",".join(n for n in own if not n.startswith("format")) for own in names], pa.string()), pa.array([",".join(own) for own in names], pa.string()), pa.array(score)]
            yield pa.RecordBatch.from_arrays(columns, [*inner, *made])

    out = documents.select(*(F.col(k).alias(i) for k, i in zip(keep, inner)), text_bytes(text).alias("__text")).mapInArrow(run, schema)
    return out.select(*(F.col(i).alias(k) for k, i in zip(keep, inner)), *made)
