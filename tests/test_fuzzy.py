import difflib
import random

import pytest

from inkwell.operators import fuzzy

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def _name(rng):
    return " ".join("".join(rng.choices("etaoinshrdlucmfwyp", k=rng.randint(2, 9))) for _ in range(rng.randint(1, 3)))


def _misspelt(rng, name):
    """Letters replaced, left out, put in or swapped, words swapped, ends cut; some names stay beyond 0.85."""
    for _ in range(rng.randint(0, 4)):
        i = rng.randrange(max(len(name), 1))
        name = rng.choice([name[:i] + rng.choice(LETTERS) + name[i + 1 :], name[:i] + name[i + 1 :], name[:i] + rng.choice(LETTERS) + name[i:], name[:i] + name[i + 1 : i + 2] + name[i : i + 1] + name[i + 2 :], name[: len(name) - 1], name[1:], " ".join(reversed(name.split(" "))), name + "s"])
    return name


@pytest.mark.parametrize("cutoff", [0.85, 0.6, 0.95])
def test_closest_equals_a_loop_over_all_keys(spark, cutoff):
    rng = random.Random(int(100 * cutoff))
    keys = sorted({_name(rng) for _ in range(300)} | {"aaaa", "aaab", "ab" * 60, "x", "é" * 7, "long " * 50, "🙂🙂🙂🙂"})
    asked = sorted({_misspelt(rng, rng.choice(keys)) for _ in range(500)} | {_name(rng) for _ in range(60)} | {"aaac", "ba" * 60, "y", "ée" * 4, "long " * 49 + "lo", "🙂🙂🙂", ""})
    got = {r.k: r.name for r in fuzzy.closest(spark.createDataFrame([(a,) for a in [*asked, None, asked[5]]], "k string"), spark.createDataFrame([(k, k.upper(), 1) for k in keys], "c string, name string, n int"), cutoff).collect()}
    want = {a: m[0].upper() for a in asked if a and (m := difflib.get_close_matches(a, keys, 1, cutoff))}
    assert got == want and len(want) > 100


def test_matching_blocks_equal_the_library(spark):
    rng = random.Random(4)
    a = ["".join(rng.choices("abc", k=rng.randint(0, 30))) for _ in range(3000)]
    b = ["".join(rng.choices("abcd", k=rng.randint(0, 30))) for _ in range(3000)]
    assert fuzzy.ratios(a, b).tolist() == [difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)]


def test_few_keys_are_compared(spark):
    """A misspelt name meets few of the keys, and with four times the keys not many more."""
    rng = random.Random(9)
    keys = list({" ".join("".join(rng.choices(LETTERS, k=7)) for _ in range(2)) for _ in range(8000)})
    asked = spark.createDataFrame([(k[:5] + "#" + k[6:],) for k in keys[:200]], "k string")
    met = [fuzzy.candidates(asked, spark.createDataFrame([(k,) for k in keys[:n]], "c string"), 0.85, fuzzy.NEAR).count() for n in (2000, 8000)]
    assert 200 <= met[0] <= met[1] <= 1.5 * 200
