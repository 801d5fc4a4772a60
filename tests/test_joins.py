"""As-of and interval joins, levels and sketches against plain loops."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from reportmill.operators import asof, rollup

DAY = dt.datetime(2024, 1, 1)


def times(r, n, keys):
    return [(r.choice(keys), r.choice([None] + [DAY + dt.timedelta(hours=r.randrange(24 * 200))] * 30), i) for i in range(n)]


@pytest.mark.parametrize("width,within", [(30 * 86400, None), (3600, None), (86400, 5 * 86400), (10**9, 0)])
def test_asof_against_a_loop(spark, width, within):
    r = random.Random(1)
    left, right = times(r, 300, ["a", "b", None, "only left"]) + [("hot", DAY, i) for i in range(150)], times(r, 200, ["a", "b", None, "only right"]) + [("hot", DAY, i) for i in range(90)]
    a = spark.createDataFrame(left, "key string, at timestamp, v long").repartition(3)
    b = spark.createDataFrame(right, "key string, at timestamp, v long").repartition(3)
    got = asof.asof_join(a, b, ["key"], "at", "at", ["v", "at"], width, within)
    assert got.columns == ["key", "at", "v", "right_v", "right_at"]
    want = []
    for k, t, v in left:
        found = [(x, w) for q, x, w in right if None not in (k, t, x) and q == k and x <= t and (within is None or (t - x).total_seconds() <= within)]
        last, w = max(found, default=(None, None))
        want.append((k, t, v, w, last))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str) and sum(w[3] is not None for w in want) > 20


def test_asof_of_nothing(spark):
    a = spark.createDataFrame([("a", DAY.date(), 1)], "key string, day date, v long")
    b = spark.createDataFrame([], "key string, day date, price double")
    assert [r.price for r in asof.asof_join(a, b, ["key"], "day", "day", ["price"]).collect()] == [None]
    assert asof.asof_join(a.limit(0), b, ["key"], "day", "day", ["price"]).count() == 0


def test_blocks_are_the_interval(spark):
    ends = [(0, 0), (0, 7), (1, 6), (5, 5), (-3, 4), (-100, 1000), (3, 2), (None, 3), (7, 8), (2**39, 2**39 + 5)]
    rows = spark.createDataFrame(ends, "s long, e long").select("s", "e", asof.blocks(F.col("s"), F.col("e")).alias("b")).collect()
    for r in rows:
        got = sorted(x - 2**asof.REACH for b in r.b for x in range(b.block << b.level, (b.block + 1) << b.level))
        assert got == (list(range(r.s, r.e + 1)) if None not in (r.s, r.e) else []) and len(r.b) <= 2 * 12


def test_intervals_against_a_loop(spark):
    r = random.Random(2)
    points = [(r.choice("ab"), r.randrange(-50, 400), i) for i in range(300)] + [(None, 3, 900), ("a", None, 901)] + [("hot", 5, 1000 + i) for i in range(60)]
    spans = [(r.choice("abc"), s := r.randrange(-60, 390), s + r.choice([-2, 0, 1, 7, 150]), i) for i in range(80)] + [(None, 0, 9, 90), ("a", None, 5, 91), ("hot", -10**9, 10**9, 92)]
    p, q = spark.createDataFrame(points, "k string, x long, p long").repartition(3), spark.createDataFrame(spans, "k string, s long, e long, q long")
    got = sorted((x.p, x.q) for x in asof.interval_join(p, q, ["k"], F.col("x"), F.col("s"), F.col("e")).collect())
    want = sorted((i, j) for k, x, i in points for k2, s, e, j in spans if None not in (k, x, s) and k == k2 and s <= x <= e)
    assert got == want and len(want) > 300
    assert asof.interval_join(p, q.limit(0), ["k"], F.col("x"), F.col("s"), F.col("e")).count() == 0
    with pytest.raises(ValueError):
        asof.interval_join(p, p, ["k"], F.col("x"), F.col("x"), F.col("x"))
    plan = asof.interval_join(p, q, ["k"], F.col("x"), F.col("s"), F.col("e"))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_cube_tells_sums_from_nulls(spark):
    df = spark.createDataFrame([("a", None), ("a", "x"), (None, "x")], "p string, q string")
    got = {(r.p, r.q, r.level): r.n for r in rollup.cube_counts(df, {"p": F.col("p"), "q": F.col("q")}, n=F.count(F.lit(1))).collect()}
    assert got == {("a", None, 0): 1, ("a", "x", 0): 1, (None, "x", 0): 1, ("a", None, 1): 2, (None, None, 1): 1, (None, None, 2): 1, (None, "x", 2): 2, (None, None, 3): 3}
    sets = rollup.grouping_sets(df, [("p",), ("q",)], n=F.count(F.lit(1))).collect()
    assert {(r.p, r.q, r.level): r.n for r in sets} == {k: v for k, v in got.items() if k[2] in (1, 2)}


def test_sketches_merge_within_their_bound(spark):
    df = spark.range(60_000).select((F.col("id") % 20).alias("g"), F.pmod(F.xxhash64("id"), F.lit(20_000)).alias("v"))
    sketches = rollup.distinct_sketches(df, ["g"], "v")
    for cut in (1, 7, 20):
        exact = df.filter(F.col("g") < cut).select("v").distinct().count()
        got = rollup.merged_distinct(sketches.filter(F.col("g") < cut), []).first().n_approx
        assert abs(got - exact) <= 4 * 1.04 / 64 * exact
    none = spark.createDataFrame([(1, None)], "g long, v long")
    assert rollup.merged_distinct(rollup.distinct_sketches(none, ["g"], "v"), ["g"]).first().n_approx == 0
