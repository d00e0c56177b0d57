import random
from math import floor, isfinite

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracetide.llm import vector_file as vf


def brute(rows, anchors=lambda i: i % 100 == 0, k=5, low=80, high=100, scale=256):
    """rows (id, vector, label) as (anchor, positive, rank, negative, positive score, negative score)."""
    use = [(i, tuple(floor(scale * x) for x in v), y) for i, v, y in rows if y is not None and v is not None and all(x is not None and isfinite(x) for x in v)]
    last = lambda i: (i is None, i or 0)
    out = []
    for i, v, y in {r for r in use if r[0] is not None and anchors(r[0])}:
        score = lambda w: sum(a * b for a, b in zip(v, w, strict=True))  # noqa: B023, E731
        same = sorted(((-score(w), last(j), j) for j, w, z in use if z == y and j != i and len(w) == len(v)))[:k]
        others = sorted((-score(w), last(j), j) for j, w, z in use if z != y and len(w) == len(v))
        for p, _, j in same:
            fits = [(s, x) for s, _, x in others if low * -p <= 100 * -s <= high * -p][:k]
            out += [(i, j, r + 1, x, -p, -s) for r, (s, x) in enumerate(fits)]
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()), key=str)


SCHEMA = "vec_id long, embedding array<float>, label int"


def rows_of(n, dim, seed, labels=10):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, dim))
    x = centres[rng.integers(0, 8, n)] + 0.5 * rng.normal(size=(n, dim))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    y = np.where(rng.random(n) < 0.4, 0, rng.integers(0, labels, n))  # one label holds over a third
    return [(i, v.tolist(), int(z)) for i, (v, z) in enumerate(zip(x, y, strict=True))]


@pytest.mark.parametrize(("bits", "block_rows"), [(6, 1 << 17), (2, 60), (1, 1000)])
def test_against_brute_force(spark, bits, block_rows):
    rows = rows_of(1200, 12, 1)
    found = vf.mine(spark.createDataFrame(rows, SCHEMA).repartition(3), F.col("vec_id") % 100 == 0, bits=bits, block_rows=block_rows)
    assert got(found) == brute(rows)


def test_other_windows_and_counts(spark):
    rows = rows_of(300, 5, 2, labels=3)
    found = vf.mine(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 30 == 0, positives=2, negatives=3, low=50, high=120)
    want = [r for r in brute(rows, lambda i: i % 30 == 0, k=2, low=50, high=120)]
    full = brute(rows, lambda i: i % 30 == 0, k=3, low=50, high=120)
    kept = {r[:2] for r in want}
    assert got(found) == [r for r in full if r[:2] in kept]


def test_nulls_ties_repeats_and_clashing_columns(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [0.9, 0.1], 2), (4, [0.9, 0.1], 2), (None, [0.9, 0.1], 2), (None, [1.0, 0.0], 1), (5, [1.0, 0.1], 3), (6, None, 1), (7, [None, 1.0], 1), (8, [nan, 1.0], 2), (9, [inf, 0.0], 2), (10, [1.0], 2), (100, [-1.0, 0.0], 1), (200, [], 1), (201, [], 1), (202, [], 2), (300, [1.0, 0.0], None), (400, [1.0, 0.0], 2), (400, [0.0, 1.0], 2), (401, [0.5, 0.5], 2), (402, [2.0, 2.0], 1), (403, [-1.0, -1.0], 2), (500, [0.0, 0.0], 2), (0, [1.0, 0.0], 1)]
    rng = random.Random(4)
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA + ", block int, asker int, cells string")
    assert got(vf.mine(df, F.col("vec_id") % 100 == 0)) == brute(rows)
    assert got(vf.mine(df.limit(0), F.col("vec_id") % 100 == 0)) == []
    assert got(vf.mine(df, F.lit(False))) == []


def test_scores_that_fit_no_long_are_an_error(spark):
    df = spark.createDataFrame([(0, [1e300], 1), (1, [1.0], 1)], "vec_id long, embedding array<double>, label int")
    with pytest.raises(Exception, match="fit no long"):
        vf.mine(df, F.col("vec_id") == 0).collect()


def test_bounds_hold_and_spare_most_rows():
    rng = np.random.default_rng(7)
    x = rng.integers(-90, 90, (3000, 16))
    file = vf.VectorFile(np.arange(3000), rng.integers(0, 4, 3000), x, 6)
    q = rng.integers(-90, 90, (40, 16))
    low, high = file.bounds(q, 0, 3000)
    exact = q @ file.x.T
    assert (low <= exact).all() and (exact <= high).all()
    bars = np.array([vf.kth_greatest(r, 5) for r in low])
    assert ((high >= bars[:, None]).sum(axis=1) < 150).all()
    large = vf.VectorFile(np.arange(2), np.zeros(2, int), np.array([[1 << 29, 5], [-7, 1 << 29]]), 6)
    low, high = large.bounds(np.array([[1 << 29, 3]]), 0, 2)
    assert low.dtype == np.int64 and (low <= np.array([[1 << 29, 3]]) @ large.x.T).all()
