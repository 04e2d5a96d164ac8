"""Quality by a sparse rule ensemble over text statistics.

Statistics of each whole text are computed once per row. On a bounded sample of labelled rows, small boosted
trees are grown and every path from a root to a node becomes a conjunctive rule; a lasso logistic regression
keeps few of them. The kept rules are compiled into one Spark column expression over the statistics columns,
so scoring is code that Spark generates and needs no model file.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import parts, texts_of, unused, with_text
from inkwell.llm.toxicity import labelled_sample, training_labels

#: The fit's bounds: labelled rows of each class and bytes of their texts.
ROWS_GOOD, ROWS_BAD, FIT_BYTES = 3000, 2000, 20 << 20
#: Statistics, in the order that `statistics` returns them.
STATISTICS = ("log_bytes", "log_words", "word_length", "distinct_share", "top_word_share", "repeat_share", "upper_share", "digit_share", "symbol_share", "pipe_share", "bang_share", "marked_share", "log_lines", "repeated_line_share", "ascii_letter_share", "other_byte_share")
_UPPER, _LOWER, _DIGIT = np.arange(65, 91), np.arange(97, 123), np.arange(48, 58)
#: ASCII signs besides those of plain prose (full stop, comma, apostrophe, hyphen, brackets, quotes, colon, semicolon, question mark).
_SYMBOL = np.frombuffer(b"#$%&*+/<=>@\\^_`{|}~", np.uint8)


def statistics(data: bytes) -> list[float]:
    """All shares are 0 for an empty text."""
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    words = data.split()
    lines = data.split(b"\n")
    size, n = max(1, len(data)), max(1, len(words))
    letters = int(counts[_UPPER].sum() + counts[_LOWER].sum())
    by_word = Counter(words)
    same = sum(map(bytes.__eq__, words, words[1:]))
    marked = sum(not w[-2:].isalnum() and w[-2:].isascii() and not w[-2:-1].isalnum() for w in words if len(w) > 1)
    return [
        float(np.log1p(len(data))),
        float(np.log1p(len(words))),
        sum(map(len, words)) / n,
        len(by_word) / n,
        max(by_word.values(), default=0) / n,
        same / n,
        float(counts[_UPPER].sum()) / max(1, letters),
        float(counts[_DIGIT].sum()) / size,
        float(counts[_SYMBOL].sum()) / size,
        float(counts[124]) / size,
        float(counts[33]) / size,
        marked / n,
        float(np.log1p(len(lines))),
        1 - len(set(lines)) / len(lines),
        letters / size,
        float(counts[128:].sum()) / size,
    ]


def with_statistics(documents: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", prefix: str = "s_") -> DataFrame:
    """Columns `keep` and one double column <prefix><name> for each statistic; null counts as the empty text."""
    from pyspark.sql.types import DoubleType, StructType

    schema = StructType([documents.schema[k] for k in keep])
    for name in STATISTICS:
        schema = schema.add(f"{prefix}{name}", DoubleType())

    def run(batches: Iterator):
        import pyarrow as pa

        for batch in parts(batches):
            table = np.array([statistics(t.encode("utf-8", "surrogatepass")) for t in texts_of(batch, keep, text)]).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), *(pa.array(table[:, i]) for i in range(len(STATISTICS)))], schema.names)

    return with_text(documents, keep, text).mapInArrow(run, schema)


@dataclass(frozen=True)
class Rule:
    """All of (statistic number, above, threshold): the statistic is above the threshold, or is not."""

    terms: tuple[tuple[int, bool, float], ...]

    def holds(self, table: np.ndarray) -> np.ndarray:
        out = np.ones(len(table), bool)
        for i, above, limit in self.terms:
            out &= (table[:, i] > limit) == above
        return out

    def column(self, prefix: str = "s_") -> Column:
        out = F.lit(True)
        for i, above, limit in self.terms:
            value = F.col(f"{prefix}{STATISTICS[i]}")
            out = out & (value > F.lit(limit) if above else value <= F.lit(limit))
        return out


@dataclass
class Model:
    bias: float
    rules: list[tuple[Rule, float]] = field(default_factory=list)

    def scores(self, table: np.ndarray) -> np.ndarray:
        logit = np.full(len(table), self.bias)
        for rule, weight in self.rules:
            logit += weight * rule.holds(table)
        return 1 / (1 + np.exp(-np.clip(logit, -40, 40)))

    def column(self, prefix: str = "s_") -> Column:
        logit = F.lit(float(self.bias))
        for rule, weight in self.rules:
            logit = logit + F.when(rule.column(prefix), F.lit(float(weight))).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-F.greatest(F.lit(-40.0), F.least(F.lit(40.0), logit))))


def _grow(table, edges, bins, residual, rows, depth, terms, out, leaves):
    """Splits rows by the statistic and edge that lower the squared residual most; every node's path goes to out."""
    if terms:
        out.append(Rule(tuple(sorted(terms))))
    best = (1e-9, None)
    total, n = residual[rows].sum(), len(rows)
    if depth and n >= 20:
        for i in range(table.shape[1]):
            k = len(edges[i])
            if not k:
                continue
            counts = np.bincount(bins[rows, i], minlength=k + 1)
            sums = np.bincount(bins[rows, i], residual[rows], k + 1)
            left_n, left = np.cumsum(counts)[:-1], np.cumsum(sums)[:-1]
            right_n = n - left_n
            ok = (left_n >= 10) & (right_n >= 10)
            gain = np.where(ok, left**2 / np.maximum(left_n, 1) + (total - left) ** 2 / np.maximum(right_n, 1), 0) - total**2 / n
            at = int(np.argmax(gain))
            if gain[at] > best[0]:
                best = (gain[at], (i, at))
    if best[1] is None:
        leaves.append((rows, residual[rows].mean() if n else 0.0))
        return
    i, at = best[1]
    low = bins[rows, i] <= at
    for above, part in ((False, rows[low]), (True, rows[~low])):
        _grow(table, edges, bins, residual, part, depth - 1, [*terms, (i, above, float(edges[i][at]))], out, leaves)


def tree_rules(table: np.ndarray, label: np.ndarray, trees: int = 24, depth: int = 3, rate: float = 0.3, seed: int = 7) -> list[Rule]:
    """Distinct rules of boosted trees, each grown on half the rows."""
    edges = [np.unique(np.quantile(table[:, i], np.linspace(0.02, 0.98, 49))) for i in range(table.shape[1])]
    edges = [e[(e >= table[:, i].min()) & (e < table[:, i].max())] for i, e in enumerate(edges)]
    bins = np.stack([np.searchsorted(e, table[:, i], "left") for i, e in enumerate(edges)], 1)
    rng = np.random.default_rng(seed)
    logit, rules = np.full(len(label), np.log((label.mean() + 1e-6) / (1 - label.mean() + 1e-6))), []
    for _ in range(trees):
        residual = label - 1 / (1 + np.exp(-logit))
        rows = np.sort(rng.permutation(len(label))[: max(40, len(label) // 2)])
        found, leaves = [], []
        _grow(table, edges, bins, residual, rows, depth, [], found, leaves)
        rules += found
        for rule, value in _leaf_values(found, table, residual):
            logit[rule] += rate * 4 * value
    return list(dict.fromkeys(rules))


def _leaf_values(rules, table, residual):
    longest = [r for r in rules if not any(len(o.terms) > len(r.terms) and set(r.terms) <= set(o.terms) for o in rules)]
    for rule in longest:
        held = rule.holds(table)
        if held.any():
            yield held, residual[held].mean()


def lasso(matrix: np.ndarray, label: np.ndarray, penalty: float, steps: int = 600) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression with an L1 penalty, by accelerated proximal gradient steps."""
    n, k = matrix.shape
    lip = 0.25 * (np.linalg.norm(matrix, 2) ** 2 / n + 1) + 1e-9
    weight, bias = np.zeros(k), float(np.log((label.mean() + 1e-6) / (1 - label.mean() + 1e-6)))
    ahead, aheadb, t = weight, bias, 1.0
    for _ in range(steps):
        miss = 1 / (1 + np.exp(-np.clip(matrix @ ahead + aheadb, -30, 30))) - label
        step = ahead - matrix.T @ miss / n / lip
        new = np.sign(step) * np.maximum(np.abs(step) - penalty / lip, 0)
        newb = aheadb - miss.mean() / lip
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, aheadb = new + (t - 1) / t2 * (new - weight), newb + (t - 1) / t2 * (newb - bias)
        weight, bias, t = new, newb, t2
    return weight, bias


def fit(table: np.ndarray, label: np.ndarray, penalty: float = 0.002) -> Model:
    """One class alone, or no rows, gives a constant score (1/2 without rows)."""
    label = np.asarray(label, float)
    if len(label) < 40 or label.min() == label.max():
        return Model(float(np.clip(np.log((label.mean() + 1e-4) / (1 - label.mean() + 1e-4)), -9, 9)) if len(label) else 0.0)
    rules, columns, seen = [], [], set()
    for rule in tree_rules(table, label):
        held = rule.holds(table)
        key = held.tobytes()
        if 0 < held.mean() < 1 and key not in seen:
            seen.add(key)
            rules.append(rule)
            columns.append(held)
    if not rules:
        return Model(float(np.log(label.mean() / (1 - label.mean()))))
    weight, bias = lasso(np.stack(columns, 1).astype(float), label, penalty)
    return Model(bias, [(r, float(w)) for r, w in zip(rules, weight) if abs(w) > 1e-6])


def train(documents: DataFrame, labels: DataFrame) -> Model:
    """A fit on the bounded sample, its bias shifted from the sample's odds of the classes to those of all training labels.

    `labelled_sample` says what nulls and repeated rows count as. Of other columns none is read.
    """
    texts, marks = labelled_sample(documents, labels, "quality", {1: ROWS_GOOD, 0: ROWS_BAD}, FIT_BYTES)
    model = fit(np.array([statistics(t.encode("utf-8", "surrogatepass")) for t in texts]).reshape(-1, len(STATISTICS)), marks)
    counts = {r["__label"]: r["n"] for r in training_labels(labels, "quality").groupBy("__label").agg(F.count("*").alias("n")).collect()}
    good, bad = int((marks == 1).sum()), int((marks == 0).sum())
    if not (model.rules and good and bad):
        return model
    return replace(model, bias=model.bias + float(np.log(counts[1] / counts[0]) - np.log(good / bad)))


def score(documents: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), out: str = "score") -> DataFrame:
    """Columns `keep` and the quality score (double, 0 to 1) of each row's whole text, empty texts too.

    A null text counts as empty. Equal texts have equal scores, repeated rows stay, and a table without rows gives
    none. Columns of any name may be kept; `out` must not be among them.
    """
    if out in keep:
        raise ValueError(f"{out} is a column of the documents")
    prefix = unused("s_", keep)
    return with_statistics(documents, keep, prefix=prefix).select(*keep, model.column(prefix).alias(out))
