"""Operator 12 against brute force."""

import math
import random

import numpy as np
import pytest

from reportmill.llm.hardneg import exact_scores, hard_negatives

SCHEMA = "vec_id long, label int, embedding array<float>, row string, score int, window int"


def brute(rows, positives=5, k=3):
    ok = [(i, y, [math.floor(256 * float(np.float32(x))) for x in v]) for i, y, v in rows if None not in (i, y, v) and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, label, q in {(i, y, tuple(v)) for i, y, v in ok if i % 50 == 0}:
        scored = sorted((-sum(x * y for x, y in zip(q, v, strict=True)), i, y) for i, y, v in ok if i != a and len(v) == len(q))
        for p, i, _ in [s for s in scored if s[2] == label][:positives]:
            low = [(-n, j) for n, j, y in scored if y != label and -50 * p <= -100 * n <= -95 * p]
            out += [(a, i, rank, j, -p, n) for rank, (n, j) in enumerate(low[:k], 1)]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(*r, "a", 1, 2) for r in rows], SCHEMA).repartition(3)


def mined(spark, rows, **how):
    return sorted(map(tuple, hard_negatives(table(spark, rows), **how).collect()))


@pytest.mark.parametrize("how", [{}, {"block": 3, "group": 64, "gather": 1}])
def test_against_brute_force(spark, how):
    r = random.Random(1)
    rows = [(i, r.randrange(3), [r.gauss(0, 1) + 1 for _ in range(8)]) for i in range(400)]
    rows += [(1000 + i, i % 3, rows[3][2]) for i in range(120)]  # copies with different labels
    rows += [(5000, None, rows[0][2]), (5050, 1, None), (5100, 1, [1.0, None] * 4), (5150, 1, [float("nan")] * 8), (5200, 1, [float("-inf")] * 8), (None, 1, rows[0][2]), (5250, 1, [1.0, 2.0]), (5251, 2, [0.5, 2.0]), (5252, 1, [0.6, 2.0]), (5300, 1, [])]
    want = brute(rows)
    assert len(want) > 60 and mined(spark, rows, **how) == want


def test_a_third_are_copies_inside_the_windows(spark):
    """More rows than any bound share the k-th score, so all digits are refined and ids decide."""
    r = random.Random(2)
    rows = [(i, 0, [10 + r.random(), r.random()]) for i in range(60)] + [(100 + i, 1, [8.0, 0.25]) for i in range(150)] + [(400 + i, 2, [r.uniform(0, 12), r.random()]) for i in range(200)]
    want = brute(rows)
    assert len(want) > 20 and mined(spark, rows, gather=1, group=50) == want


def test_zero_negative_and_wide_scores(spark):
    rows = [(0, 0, [0.0, 0.0]), (1, 0, [1.0, 1.0]), (2, 1, [5.0, 5.0]), (3, 1, [1.0, 0.0]), (50, 2, [-1.0, 0.0]), (51, 2, [1.0, 0.0]), (100, 3, [2.0**20, 1.0]), (101, 3, [2.0**20, 0.0]), (102, 4, [2.0**19 + 5, 3.0]), (103, 4, [2.0**19, 0.0])]
    want = brute(rows)
    assert mined(spark, rows, gather=1) == want and any(w[5] == 0 for w in want) and any(w[5] > 2**50 for w in want)


def test_repeated_few_and_none(spark):
    rows = [(50, 1, [1.0]), (50, 1, [1.0]), (1, 1, [1.0]), (1, 1, [1.0]), (2, 2, [0.75]), (2, 2, [0.75])]
    n = 192 * 256
    assert mined(spark, rows) == [(50, 1, 1, 2, 65536, n)] * 2 + [(50, 1, 2, 2, 65536, n)] * 2
    assert mined(spark, rows[:1]) == [] and mined(spark, rows[:4]) == []
    assert mined(spark, [(50, 1, [-1.0]), (1, 1, [1.0]), (2, 2, [1.0])]) == []
    assert hard_negatives(spark.createDataFrame([], SCHEMA)).count() == 0


def test_exact_scores():
    a = np.array([[2**40, 2**40], [3, -1]])
    assert exact_scores(a[1:], a).tolist() == [[2**41, 10]]
    assert exact_scores(a, np.array([[2**30, -(2**30)]])).tolist() == [[0], [2**32]]
    with pytest.raises(OverflowError):
        exact_scores(a, a)
