"""Operator 11 against brute force in whole numbers."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from reportmill.llm import divergence
from reportmill.llm.divergence import source_divergence

SCHEMA = "doc_id long, text string, lang string, source string, term string, value long"
SMALL = {c: c + 32 for c in range(65, 91)}


def brute(rows, least=3, top=200):
    docs = [(t or "", g or "", s or "") for _, t, g, s in rows]
    terms = [(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t.translate(SMALL)), g, s) for t, g, s in docs]
    df, groups, count = defaultdict(Counter), defaultdict(set), defaultdict(Counter)
    for ts, g, s in terms:
        df[g].update(set(ts))
        groups[g].add(s)
        count[g, s].update(ts)
        count[g].update(ts)
    out = []
    for g, sources in groups.items():
        kept = [t for t, n in df[g].items() if n >= least]

        def shares(c):
            total = sum(c[t] for t in kept) + len(kept)  # noqa: B023
            return {t: 1 + 10**9 * (c[t] + 1) // total for t in kept}  # noqa: B023

        p, q = {s: shares(count[g, s]) for s in sources}, shares(count[g])
        for s in sources:
            pair = [(o, sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept)) for o in sources if o != s]
            term = [(t, (p[s][t] - q[t]) ** 2 // q[t]) for t in kept if count[g, s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pair, None), ("term", term, top)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(g, s, part, i, v, r) for r, (i, v) in enumerate(items[:most], 1)]
    return sorted(out)


def documents(n=150):
    r = random.Random(4)
    some = ["The", "the", "tHE", "Été", "été", "İx", "日本", "a1b", "x-y", "ﬁ", "q" * 300, "\U0001f600z", "\x00n\x7f"]
    some += ["w" + chr(97 + i) + chr(97 + j) for i in range(9) for j in range(9)]
    rows = []
    for i in range(n):
        lang, source = r.choice(["en", "en", "de", None, ""]), "hot" if i % 3 == 0 else r.choice(["s1", "S1", "é", None, "", "s2"])
        k = r.randrange(60)
        rows.append((i, " ".join(r.choice(some[: 5 + 10 * len(source or "")]) for _ in range(k)), lang, source))
    rows += [(1000, None, "en", "s9"), (1001, "", "fr", "s1"), (1002, "1 2 3", "fr", "s2"), (1003, "only one", "it", "s1"), (7, rows[7][1], *rows[7][2:]), (7, rows[7][1], *rows[7][2:]), (None, "word " * 3000, "en", "hot")]
    return rows


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("top", [200, 5])
def test_against_brute_force(spark, top):
    rows = documents()
    got = sorted(tuple(x) for x in source_divergence(table(spark, rows), top_terms=top).collect())
    want = brute(rows, top=top)
    assert got == want and {w[2] for w in want} == {"pair", "term"} and ("fr", "s1", "pair", "s2", 0, 1) in want


def test_sql_is_the_same(spark):
    rows = documents(60)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", rows)
    assert sorted(con.execute(f"SELECT lang, source, part, item, value, rank FROM ({divergence.SQL})").fetchall()) == brute(rows)


def test_one_source_one_document_and_none(spark):
    rows = [(1, "a b c", "en", "s"), (2, "a b", "en", "s"), (3, "a", "en", "s")]
    assert [tuple(x) for x in source_divergence(table(spark, rows)).collect()] == brute(rows) == []
    assert source_divergence(spark.createDataFrame([], SCHEMA)).count() == 0
    only = [(1, None, None, None)]
    assert source_divergence(table(spark, only)).count() == len(brute(only)) == 0


def test_shares_of_large_counts(spark):
    """Beyond what a product by 1e9 holds."""
    n = [(10**15, 3 * 10**15 + 7), (1, 1), (10**12 + 1, 10**12 + 1), (1, 9 * 10**14)]
    got = spark.createDataFrame(n, "n long, t long").select(divergence.share(divergence.F.col("n"), divergence.F.col("t")).alias("p")).collect()
    assert [x.p for x in got] == [1 + 10**9 * a // b for a, b in n]
