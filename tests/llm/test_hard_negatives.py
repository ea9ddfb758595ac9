"""Hard negatives against brute force, and on awkward rows."""

import math

import numpy as np
from pyspark.sql import functions as F

from contractlens.llm import negatives

SCHEMA = "vec_id long, embedding array<double>, label int, anchor_id string, score string"


def brute(rows, asks, positives=5, count=3, low=50, high=95, scale=256):
    known = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = [math.floor(x * scale) for x in v]
        if (i, len(q)) not in known or (label, q) < known[i, len(q)]:
            known[i, len(q)] = (label, q)
    out = []
    for (a, size), (label, q) in known.items():
        if not asks(a):
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, r, strict=True)), i, of) for (i, n), (of, r) in known.items() if n == size and i != a)
        for p, i, of in [x for x in scored if x[2] == label][:positives]:
            good = [x for x in scored if x[2] != label and low * -p <= 100 * -x[0] <= high * -p]
            out += [(a, i, k + 1, x[1], -p, -x[0]) for k, x in enumerate(good[:count])]
    return sorted(out)


def run(spark, rows, asks="vec_id % 5 = 0", **how):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    return sorted(tuple(r) for r in negatives.hard_negatives(df, F.expr(asks), **how).collect())


def test_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(4, 6))
    rows = [(i, (centres[i % 3] + rng.normal(size=6) * 0.7).tolist(), int(rng.integers(0, 3))) for i in range(400)]
    found = run(spark, rows)
    assert found == brute(rows, lambda i: i % 5 == 0) and len(found) > 300
    found = run(spark, rows, positives=2, negatives=7, low=10, high=100)
    assert found == brute(rows, lambda i: i % 5 == 0, 2, 7, 10, 100)


def test_ties_hot_vectors_and_small_blocks(spark, monkeypatch):
    """A third of the rows are one vector; blocks of few rows and anchors give the same."""
    monkeypatch.setattr(negatives, "CELL_BYTES", 4000)
    rng = np.random.default_rng(6)
    rows = [(i, [0.5, 0.25, 1.0] if i % 3 == 0 else rng.integers(-2, 3, 3).astype(float).tolist(), i % 4) for i in range(300)]
    rows += [(i, [0.5, 0.25, 1.0], 9) for i in range(300, 310)]
    assert run(spark, rows) == brute(rows, lambda i: i % 5 == 0)


def test_awkward_rows(spark):
    rows = [
        (0, [1.0, 1.0], 1), (1, [1.0, 0.5], 1), (2, [1.0, 0.2], 2), (3, [0.9, 0.5], 2),
        (None, [1.0, 1.0], 1), (4, None, 1), (5, [1.0, 1.0], None), (6, [1.0, None], 2), (7, [math.nan, 1.0], 2), (8, [math.inf, 1.0], 2),
        (10, [], 1), (11, [], 1), (12, [], 2),  # the score 0 on all sides
        (15, [1.0], 3), (20, [2.0, 1.0, 1.0], 4), (1, [1.0, 0.5], 1), (3, [0.9, 0.5], 0),  # repeated, and with two labels
        (25, [0.0, 0.0], 7), (26, [1.0, 1.0], 7), (27, [-1.0, -1.0], 7),  # an anchor with the score 0 to all
    ]
    found = run(spark, rows)
    assert found == brute(rows, lambda i: i % 5 == 0)
    assert (10, 11, 1, 12, 0, 0) in found and (0, 1, 1, 3, 98304, 91648) in found
    assert run(spark, []) == [] and run(spark, rows[:1]) == []


def test_large_components(spark):
    rows = [(i, [float(2 ** (12 + i)), 1.0 + i, -3.0 * i], i % 2) for i in range(12)]
    assert run(spark, rows, "vec_id < 3") == brute(rows, lambda i: i < 3)


def test_windows_are_exact():
    for p in [*range(-50, 200), 10**17 + 7]:
        a, b = negatives._bounds(p, 50, 95)
        assert 50 * p <= 100 * a and (100 * (a - 1) < 50 * p) and 100 * b <= 95 * p < 100 * (b + 1)
