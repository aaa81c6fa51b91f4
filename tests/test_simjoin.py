"""The prefix-filter join against all pairs."""

import random
from difflib import SequenceMatcher

import numpy as np
import pytest

from evalspark.operators import simjoin as SJ, textops as TO


def variants(rnd, n):
    words = ["return", "value", "index", "self", "==", "(", ")", "for", "in", "range", "é中", "𝒳", "="]
    base = ["".join(rnd.choice(words) for _ in range(rnd.randrange(1, 40))) for _ in range(n // 6)] + ["=" * 120, "ab" * 90, "-" * 3, "x"]
    out = []
    for _ in range(n):
        t = list(rnd.choice(base))
        for _ in range(rnd.randrange(0, 5)):
            at = rnd.randrange(len(t) + 1)
            t[at:at + rnd.randrange(2)] = [rnd.choice("ab=é")] * rnd.randrange(3)
        out.append("".join(t))
    return out


@pytest.mark.parametrize("threshold", [0.98, 0.9, 0.75, 0.5])
def test_equals_all_pairs(spark, threshold):
    rnd = random.Random(int(threshold * 100))
    left, right = variants(rnd, 240), variants(rnd, 90)
    side = lambda ts: spark.createDataFrame([(t,) for t in [*ts, None, ""]], "t string").repartition(3)
    got = sorted((r.lt, r.rt) for r in SJ.similar_texts(side(left), side(right), threshold).collect())
    want = sorted({(a, b) for a in set(left) for b in set(right) if a and b and SequenceMatcher(None, a, b).ratio() > threshold})
    assert got == want and want


def test_prefixes_of_close_texts_meet():
    """Any two texts within the edits of a threshold share a q-gram of their prefixes, near its place."""
    rnd = random.Random(5)
    counts = np.array([rnd.randrange(50) for _ in range(SJ.SLOTS)])
    for threshold in (0.98, 0.9, 0.8):
        q = SJ.gram_size(threshold)
        for _ in range(300):
            a = "".join(rnd.choice("abc") for _ in range(rnd.randrange(30, 200)))
            t = list(a)
            for _ in range(SJ.edits(len(a), threshold) // 2):
                at = rnd.randrange(len(t))
                t[at:at + 1] = [] if rnd.random() < 0.5 else [t[at], rnd.choice("abc")]
            b = "".join(t)
            (g, p), (h, r) = SJ.prefix(a, counts, threshold, q), SJ.prefix(b, counts, threshold, q)
            room = (1 - threshold) * (len(a) + len(b))
            assert any(x == y and abs(int(i) - int(j)) < room for x, i in zip(g, p) for y, j in zip(h, r))


def test_copies_and_keys(spark):
    """A line that a third of the rows hold is one text in the join; its rows come back at the end."""
    rows = [(i, "the very same line of code" if i % 3 == 0 else f"some other line number {i} of the table") for i in range(600)]
    left = spark.createDataFrame(rows, "i long, a string").repartition(4)
    right = spark.createDataFrame([(1, "the very same  line of code"), (2, "nothing like it")], "j long, b string")
    got = TO.fuzzy_pairs(left, right, "i", "j", "a", "b")
    assert {(r.i, r.j) for r in got.collect()} == {(i, 1) for i in range(0, 600, 3)}
    assert TO.fuzzy_pairs(left.limit(0), right, "i", "j", "a", "b").count() == 0


def test_edit_room_agrees_in_both_forms(spark):
    from pyspark.sql import functions as F

    for threshold in (0.98, 0.9, 0.75, 0.5):
        rows = spark.range(1, 500).select("id", SJ._edits(F.col("id"), threshold).alias("k")).collect()
        assert all(r.k == SJ.edits(r.id, threshold) for r in rows)
        for a in range(1, 60):
            for b in range(1, 120):
                most = 2 * min(a, b) / (a + b)
                if most > threshold:  # the fewest edits are the difference of the lengths
                    assert abs(a - b) <= min(SJ.edits(a, threshold), SJ.edits(b, threshold))
