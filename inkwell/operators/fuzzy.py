"""Nearest names by matching blocks, found by an index of pieces instead of comparing lengths with lengths."""

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters by which two names may differ in the first, cheap look-up.
NEAR = 2
#: From this length on the ratio leaves out popular letters, so such names are compared one by one.
LONG = 200
_EPS = 1e-9


def matched(a: list[str], b: list[str]) -> np.ndarray:
    """For each pair the letters in matching blocks: the longest common run, the first of equals in a, then in b, and so on to both sides of it."""
    n = len(a)
    out = np.zeros(n, np.int64)
    if not n:
        return out
    la, lb = (np.fromiter(map(len, x), np.int64, n) for x in (a, b))
    x, y = (np.array(s, f"U{max(int(size.max()), 1)}").view(np.uint32).reshape(n, -1) for s, size in ((a, la), (b, lb)))
    pair, a0, a1, b0, b1 = np.arange(n), np.zeros(n, np.int64), la, np.zeros(n, np.int64), lb
    columns = np.arange(y.shape[1])
    while len(pair):
        left, right = x[pair], y[pair]
        inside = (columns >= b0[:, None]) & (columns < b1[:, None])
        run = np.zeros((len(pair), y.shape[1] + 1), np.int16)
        best, at, to = (np.zeros(len(pair), np.int64) for _ in range(3))
        for i in range(int(a0.min()), int(a1.max())):
            same = (left[:, i : i + 1] == right) & inside & ((a0 <= i) & (i < a1))[:, None]
            run[:, 1:] = np.where(same, run[:, :-1] + 1, 0)
            place = run.argmax(1)
            size = run[np.arange(len(pair)), place].astype(np.int64)
            more = size > best
            best[more], at[more], to[more] = size[more], i + 1 - size[more], place[more] - size[more]
        np.add.at(out, pair, best)  # a pair may have several windows
        sides = [(pair, a0, at, b0, to), (pair, at + best, a1, to + best, b1)]
        pair, a0, a1, b0, b1 = (np.concatenate(c) for c in zip(*([v[(best > 0) & (s[2] > s[1]) & (s[4] > s[3])] for v in s] for s in sides)))
    return out


def ratios(a: list[str], b: list[str]) -> np.ndarray:
    """2 * matched / (both lengths); two empty names are equal."""
    from difflib import SequenceMatcher

    short = np.array([len(t) < LONG for t in b], bool)
    out = np.empty(len(a))
    for i in np.flatnonzero(~short):
        out[i] = SequenceMatcher(None, a[i], b[i]).ratio()
    at = np.flatnonzero(short)
    both = np.array([len(a[i]) + len(b[i]) for i in at], float)
    out[at] = np.where(both > 0, 2 * matched([a[i] for i in at], [b[i] for i in at]) / np.maximum(both, 1), 1.0)
    return out


def _bounds(length: Column, cutoff: float) -> tuple[Column, Column]:
    """Lengths of partners that can reach the cutoff."""
    return F.ceil(length * F.lit(cutoff / (2 - cutoff)) - _EPS).cast("int"), F.floor(length * F.lit((2 - cutoff) / cutoff) + _EPS).cast("int")


def _edits(lengths: Column, cutoff: float, most: int | None) -> Column:
    """Letters outside the matching blocks that names of together so many letters may have."""
    edits = F.floor(lengths * F.lit(1 - cutoff) + _EPS).cast("int")
    return edits if most is None else F.least(edits, F.lit(most))


def _pieces(rows: DataFrame, *keep: str) -> DataFrame:
    """Adds piece number i, its begin and end, of a name of `la` letters cut into d + 1 pieces."""
    cut = lambda i: F.floor(i * F.col("la") / (F.col("d") + 1)).cast("int")
    return rows.select(*keep, "la", "d", F.explode(F.sequence(F.lit(0), F.col("d"))).alias("i")).select("*", cut(F.col("i")).alias("begin"), cut(F.col("i") + 1).alias("end"))


def index(keys: DataFrame, cutoff: float, most: int | None = None) -> DataFrame:
    """(c, la, d, i, piece): each key c cut into d + 1 pieces, for each d that a partner's length allows."""
    low, high = _bounds(F.length("c"), cutoff)
    sized = keys.select("c", F.length("c").alias("la"), _edits(F.length("c") + low, cutoff, most).alias("d0"), _edits(F.length("c") + high, cutoff, most).alias("d1"))
    return _pieces(sized.select("c", "la", F.explode(F.sequence("d0", "d1")).alias("d")), "c").select("c", "la", "d", "i", F.expr("substring(c, begin + 1, end - begin)").alias("piece"))


def probes(queries: DataFrame, cutoff: float, most: int | None = None) -> DataFrame:
    """(k, la, d, i, piece): what an unharmed piece of a partner of la letters can be in the query k, at each shift that d edits allow."""
    low, high = _bounds(F.length("k"), cutoff)
    sized = queries.select("k", F.length("k").alias("lb"), F.explode(F.sequence(F.greatest(low, F.lit(1)), F.greatest(high, F.lit(1)))).alias("la"))
    sized = sized.withColumn("d", _edits(F.col("la") + F.col("lb"), cutoff, most)).where("abs(la - lb) <= d")
    shifted = _pieces(sized, "k", "lb").select("*", F.explode(F.expr("sequence(-((d + la - lb) div 2), (d + lb - la) div 2)")).alias("shift"))
    return shifted.where("begin + shift >= 0 AND end + shift <= lb").select("k", "la", "d", "i", F.expr("substring(k, CAST(begin + shift + 1 AS int), end - begin)").alias("piece"))


def candidates(queries: DataFrame, keys: DataFrame, cutoff: float, most: int | None = None) -> DataFrame:
    """Distinct (k, c) that share a piece: all pairs whose ratio reaches the cutoff with at most `most` letters outside the blocks are among them.

    Of a key's d + 1 pieces d edits leave one as it is, at a place that has moved by no more than the edits before it.
    """
    on = ["la", "d", "i", "piece"]
    return probes(queries, cutoff, most).join(index(keys, cutoff, most), on).select("k", "c").distinct()


def _best(pairs: DataFrame, cutoff: float) -> DataFrame:
    import pandas as pd

    @F.pandas_udf("double")
    def ratio(candidate: pd.Series, query: pd.Series) -> pd.Series:
        order = np.argsort([len(c) for c in candidate], kind="stable")
        out, a, b = np.empty(len(order)), candidate.tolist(), query.tolist()
        for i in range(0, len(order), 1024):
            part = order[i : i + 1024]
            out[part] = ratios([a[j] for j in part], [b[j] for j in part])
        return pd.Series(out)

    return pairs.withColumn("ratio", ratio("c", "k")).where(F.col("ratio") >= cutoff).groupBy("k").agg(F.max(F.struct("ratio", "c")).alias("b")).select("k", "b.ratio", "b.c")


def closest(queries: DataFrame, keys: DataFrame, cutoff: float) -> DataFrame:
    """For each query k the key c of the highest matching-block ratio, if that reaches the cutoff; ties to the greater key.

    Two look-ups by pieces. The first allows NEAR letters outside the blocks, so pieces are long and few keys share one;
    whatever it finds that no farther key could beat is settled. The second, for all other queries, allows as many as
    the cutoff does. Nulls match nothing. Columns: k, and those of keys but c.
    """
    asked, named = queries.where("k <> ''").select("k").distinct(), keys.where("c <> ''").select("c").distinct()
    near = _best(candidates(asked, named, cutoff, NEAR), cutoff)
    _, high = _bounds(F.length("k"), cutoff)
    whole = F.length("k") + high
    settled = (_edits(whole, cutoff, None) <= NEAR) | (F.coalesce("ratio", F.lit(0.0)) > 1 - (NEAR + 1) / whole + _EPS)
    tried = asked.join(near, "k", "left").withColumn("settled", settled)
    far = _best(candidates(tried.where("NOT settled").select("k"), named, cutoff), cutoff)
    found = tried.where("settled AND c IS NOT NULL").select("k", "c").unionByName(far.select("k", "c"))
    rest = [x for x in keys.columns if x != "c"]
    if not rest:
        return found.select("k")
    return found.join(keys.groupBy("c").agg(F.max(F.struct(*rest)).alias("r")), "c").select("k", *(F.col(f"r.{x}").alias(x) for x in rest))
