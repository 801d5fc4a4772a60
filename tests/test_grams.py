"""The gram index against comparing every pair, and its plan."""

import random

import pytest

from reportmill.operators.grams import GramIndex
from reportmill.operators.prices import resolve_tickers


def brute(texts, symbols, equal_first=True):
    out = {}
    for t in texts:
        has = [(c is None, c or "", n) for n, c in symbols if n is not None and t is not None and t in n]
        equal = [x for x in has if x[2] == t and equal_first]
        out[t] = (lambda x: (x[2], None if x[0] else x[1]))(min(equal or has)) if has else (None, None)
    return out


@pytest.fixture(scope="module")
def listing():
    r = random.Random(1)
    syllables = ["ab", "ba", "aa", "삼성", "전자", "é", "b", " "]
    symbols = [("".join(r.choice(syllables) for _ in range(r.randrange(1, 6))), f"{i:04d}") for i in range(300)]
    symbols += [("same", str(9000 - i)) for i in range(150)] + [(None, "1"), ("", "2"), ("no code", None), ("a%_\\d", "77")]  # a third share a name
    texts = [n[a:b] for n, _ in symbols[:200] for a, b in ((0, 1), (1, 3), (0, 3), (1, 5), (0, 9))]
    texts += ["", None, "zzz", "zzzz", "abzz", "ame", "same", "sameabab", "no co", "%_\\", "a%_\\", "....", "x" * 500, "삼성전자", " "]
    return symbols, texts


def test_against_all_pairs(spark, listing):
    symbols, texts = listing
    s = spark.createDataFrame(symbols, "name string, code string").repartition(3)
    asked = spark.createDataFrame([(t,) for t in [*texts, *texts[:50]]], "name_asked string")
    got = resolve_tickers(asked, s).collect()
    assert len(got) == len(set(texts)) and {r.name_asked: (r.name, r.code) for r in got} == brute(set(texts), symbols)


@pytest.mark.parametrize("size", [1, 2, 4])
def test_gram_sizes(spark, listing, size):
    symbols, texts = listing
    s, asked = spark.createDataFrame(symbols, "name string, code string"), spark.createDataFrame([(t,) for t in texts], "text string")
    got = {r.text: (r.name, r.code) for r in GramIndex.of(s, size).containing(asked).collect()}
    assert got == {t: x for t, x in brute(set(texts), symbols, equal_first=False).items() if x != (None, None)}


def test_a_stored_index(spark, listing, tmp_path):
    symbols, _ = listing
    s = spark.createDataFrame(symbols, "name string, code string")
    asked = spark.createDataFrame([("ame",), ("삼성전자",), ("q",)], "name_asked string")
    index = GramIndex.of(s).save(str(tmp_path))
    want = {r.name_asked: r.code for r in resolve_tickers(asked, s).collect()}
    assert {r.name_asked: r.code for r in resolve_tickers(asked, s, GramIndex.read(spark, str(tmp_path))).collect()} == want == {r.name_asked: r.code for r in resolve_tickers(asked, s, index).collect()}


def test_no_pair_of_all_with_all(spark, listing):
    symbols, texts = listing
    s, asked = spark.createDataFrame(symbols, "name string, code string"), spark.createDataFrame([(t,) for t in texts], "name_asked string")
    for limit in ("-1", "10m"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        try:
            plan = resolve_tickers(asked, s)._jdf.queryExecution().executedPlan().toString()
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_empty(spark):
    s, asked = spark.createDataFrame([], "name string, code string"), spark.createDataFrame([("a",)], "name_asked string")
    assert [tuple(r) for r in resolve_tickers(asked, s).collect()] == [("a", None, None)]
    assert resolve_tickers(asked.limit(0), s).count() == 0
