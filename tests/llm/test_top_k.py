"""Operator 10 against brute force."""

import math
import random

import numpy as np
import pytest

from reportmill.llm.vafile import bounds, cells, products, top_k

SCHEMA = "vec_id long, embedding array<float>, label int, dim string, query_key string"


def brute(rows, every, k):
    ok = [(i, v) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    whole = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in ok]
    out = set()
    for q, a in {(i, tuple(v)) for i, v in whole if i % every == 0}:
        scored = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in whole if i != q and len(a) == len(b))
        out |= {(q, rank, i, -s) for rank, (s, i) in enumerate(scored[:k], 1)}
    return out


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "a", "b") for i, v in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("block,group", [(2048, 8192), (3, 64)])
def test_against_brute_force(spark, block, group):
    r = random.Random(1)
    rows = [(i, [r.gauss(0, 1) for _ in range(16)]) for i in range(400)]
    rows += [(1000 + i, rows[3][1]) for i in range(150)] + [(50 * i, rows[3][1]) for i in range(40, 44)]  # ties
    rows += [(5000, None), (5050, [1.0, None] * 8), (5100, [float("nan")] * 16), (5150, [float("inf")] * 16), (None, rows[0][1]), (5200, []), (5250, [1.0, 2.0]), (5251, [0.5, -2.0])]
    got = {tuple(x) for x in top_k(table(spark, rows), block=block, group=group).collect()}
    want = brute(rows, 50, 5)
    assert {g for g in got if g[0] != 5200} == want


def test_repeated_few_and_none(spark):
    one = [1.0, 0.0]
    rows = [(50, one), (50, one), (1, [0.5, 0.5]), (1, [0.5, 0.5])]
    assert sorted(map(tuple, top_k(table(spark, rows)).collect())) == [(50, 1, 1, 128 * 256), (50, 2, 1, 128 * 256)]
    assert top_k(table(spark, [(50, one)])).count() == 0
    assert top_k(spark.createDataFrame([], SCHEMA)).count() == 0


def test_many_near_copies_take_more_rounds(spark):
    """Wide cells can't tell the copies of a third of the rows apart, nor their order by id."""
    r = random.Random(3)
    far = [10 * r.random() for _ in range(8)]
    rows = [(i, [r.uniform(0, 10) for _ in range(8)]) for i in range(300)] + [(300 + i, [x + i % 7 / 256 for x in far]) for i in range(120)] + [(450 + i // 3, far) for i in range(60)]
    for first in (1, 4):
        got = {tuple(x) for x in top_k(table(spark, rows), group=100, first=first).collect()}
        assert got == brute(rows, 50, 5)


def test_zero_queries_are_done_at_once(spark):
    rows = [(i, [0.0, 0.0] if i % 50 == 0 else [float(i), -1.0]) for i in range(1, 200)]
    assert {tuple(x) for x in top_k(table(spark, rows)).collect()} == brute(rows, 50, 5)


@pytest.mark.parametrize("size", [100, 3000, 2**40])
def test_bounds_are_upper_bounds(size):
    r = np.random.default_rng(2)
    v, q = r.integers(-size, size, (300, 24)), r.integers(-3000, 3000, (20, 24))
    cell, shift = cells(v.ravel(), np.full(300, 24))
    got, exact = bounds(q, cell.reshape(300, 24), shift), q @ v.T
    assert (got >= exact).all()
    assert size > 100 or (got == exact).all()
    assert size == 100 or (shift > 0).all()


def test_cells_of_empty_and_single_vectors():
    cell, shift = cells(np.array([127, -128, 128, -129, 0]), np.array([0, 2, 0, 1, 1, 1, 0]))
    assert shift.tolist() == [0, 0, 0, 1, 1, 0, 0] and cell.tolist() == [127, -128, 64, -65, 0]


def test_large_components(spark):
    rows = [(50, [2.0**22, 3.0]), (1, [2.0**20, 1.0]), (2, [-(2.0**22), 1.0])]
    got = [tuple(x) for x in top_k(table(spark, rows)).collect()]
    assert got == [(50, 1, 1, 2**58 + 768 * 256), (50, 2, 2, -(2**60) + 768 * 256)]
    v = np.array([[2**40, 2**40], [2**40, -(2**40)]])
    with pytest.raises(OverflowError):
        products(v, np.array([[2**30, -(2**30)]] * 2))
    assert products(v[:1], np.array([[2**30, -(2**30)]])).tolist() == [0]
