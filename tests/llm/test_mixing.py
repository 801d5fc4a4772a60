"""Operator 5: targets against brute force, and how near the mix comes to them."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from reportmill.llm.mixing import mix_sources, mixed, targets

SCHEMA = "doc_id long, text string, source string, size long, place long"


def rows(seed=4, n=900):
    r = random.Random(seed)
    out = [(i, "w " * r.randint(0, 60), r.choice(["a", "b", "b", "b", "b", "Z", "é", None])) for i in range(n)]
    return out + [(5000, None, "a"), (5001, "", None), (5002, "x\xa0y z", "lone"), (None, "a b c", "a"), (7, out[7][1], out[7][2]), (5003, None, "empty")]


def brute_targets(sizes):
    """Raises all sources' targets together in small steps of their weights, until the budget is spent."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    low, high = 0.0, 1e12
    for _ in range(200):
        level = (low + high) / 2
        total = sum(min(2 * sizes[s], level * weight[s]) for s in names)
        low, high = (level, high) if total < 1.5 * sum(sizes.values()) else (low, level)
    return {s: min(2 * sizes[s], low * weight[s]) for s in names}


def test_targets():
    r = random.Random(1)
    for _ in range(50):
        sizes = {s: r.randint(0, 10 ** r.randint(0, 5)) for s in ["a", "b", "c", "dd", "é", None][: r.randint(1, 6)]}
        got, want = targets(sizes, (3, 1, 2), 1.5, 2.0), brute_targets(sizes)
        assert got == pytest.approx(want, abs=1e-3)
    assert targets({}, (3, 1, 2), 1.5, 2.0) == {}


def test_mix(spark):
    data = rows()
    df = spark.createDataFrame([(*x, 1, 1) for x in data], SCHEMA).repartition(3)
    got = mix_sources(df).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mix_sources(df.repartition(5)).collect()), key=str)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    total, of, taken = Counter(), {i: (s, size(t)) for i, t, s in data}, defaultdict(int)
    for _, t, s in data:
        total[s] += size(t)
    want = brute_targets({s: total[s] for _, _, s in data})
    assert len(got) == len(data)
    for x in got:
        s, n = of[x.doc_id]
        assert (x.size, x.source_size) == (n, total[s]) and x.target == pytest.approx(want[s], abs=1e-3)
        assert x.taken in (0, n, 2 * n)
        taken[s] += x.taken
    assert all(abs(taken[s] - want[s]) <= 120 for s in total)
    assert Counter(x.doc_id for x in mixed(df).collect()) == Counter({x.doc_id: 0 for x in got}) + Counter(
        [x.doc_id for x in got for _ in range(x.taken // x.size if x.size else 0)]
    ) + Counter(x.doc_id for x in mixed(df).collect() if of[x.doc_id][1] == 0)


def test_larger_share_takes_a_superset(spark):
    df = spark.createDataFrame([(*x, 1, 1) for x in rows()], SCHEMA)
    less, more = ({x.doc_id: x.taken for x in mix_sources(df, share=s).collect()} for s in (0.6, 0.9))
    assert all(more[i] >= n for i, n in less.items()) and sum(more.values()) > sum(less.values())


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert mix_sources(df).count() == 0 and mixed(df).count() == 0
    nothing = spark.createDataFrame([(1, None, "a", 0, 0), (2, "", None, 0, 0)], SCHEMA)
    assert [(x.size, x.source_size, x.target, x.taken) for x in mix_sources(nothing).collect()] == [(0, 0, 0.0, 0)] * 2


def test_columns_of_any_name_stay(spark):
    rows = [(i, f"w{i} x y", "ab"[i % 2]) for i in range(40)]
    names = ("_source", "_times", "_copies", "_cut", "_again", "_target", "again", "row", "place")
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({n: F.lit(n) for n in names})
    out = mixed(df).collect()
    assert out and all(r[n] == n for r in out for n in names) and mixed(df).columns == df.columns
    assert mixed(df.limit(0)).count() == 0
