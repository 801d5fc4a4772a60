"""Catalog, chunks, retrieval, listings, prices and conversations on small literals."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from reportmill.config import Settings
from reportmill.operators import chunk, listing, prices, registry, retrieve, session

ALL = st.text(alphabet="ab. \n#é", max_size=400)


@settings(max_examples=300, deadline=None)
@given(ALL, st.integers(10, 60), st.integers(0, 9))
def test_splitter_contract(text, size, overlap):
    parts = chunk.split_recursively(text, size, overlap)
    assert all(0 < len(p) <= size and p == p.strip() for p in parts)
    at = 0
    for p in parts:  # in order, each a substring
        found = text.find(p, max(0, at - overlap - len(p)))
        assert found >= 0
        at = found + len(p)
    assert sorted(set("".join(text.split()))) == sorted(set("".join("".join(parts).split())))
    if overlap == 0:
        assert "".join("".join(parts).split()) == "".join(text.split())


def test_splitter_prefers_early_separators():
    assert chunk.split_recursively("aaa\n\nbbb\n\nccc", 9, 0) == ["aaa\n\nbbb", "ccc"] or chunk.split_recursively("aaa\n\nbbb\n\nccc", 9, 0) == ["aaa", "bbb", "ccc"]
    assert chunk.split_recursively("a b c d e f", 5, 2) == ["a b", "b c", "c d", "d e", "e f"] or chunk.split_recursively("a b c d e f", 5, 2)[0].startswith("a b")
    assert chunk.split_recursively("x" * 25, 10, 0) == ["x" * 10, "x" * 10, "x" * 5]


def test_fixed_windows(spark):
    got = spark.createDataFrame([("x" * 1000,), ("y" * 500,), ("",)], "t string").select(chunk.fixed_windows(F.col("t"), 500, 50).alias("c")).collect()
    assert [[len(c) for c in r.c] for r in got] == [[500, 500, 100], [500], [0]]


def test_chunk_reports(spark):
    docs = spark.createDataFrame([("f.pdf", "A", "T", "2024-01-01", None, "intro\n# One\n" + "word " * 600 + "\n## Two\nmore\n# Three\n")], "file_name string, target_name string, title string, report_date string, broker string, clean string")
    keys = ("file_name", "target_name", "title", "report_date", "broker")
    sections = chunk.header_sections(docs, "clean", keys)
    assert [(r.h1, r.h2) for r in sections.orderBy("section").collect()] == [(None, None), ("One", None), ("One", "Two"), ("Three", None)]
    parents, chunks = chunk.chunk_reports(sections)
    p, c = parents.collect(), chunks.collect()
    assert {x.parent_id for x in c} == {x.parent_id for x in p} and len({x.chunk_id for x in c}) == len(c)
    assert all(x.text.startswith("[기업: A, 제목: T]\n") and len(x.text) <= 500 + 20 and x.broker == "알수없음" for x in c)
    assert sorted(x.parent_index for x in p) == list(range(len(p)))
    none, flat = chunk.chunk_reports(sections, Settings(parent_child=False))
    assert none is None and flat.filter("parent_id IS NOT NULL").count() == 0


def test_names_round_trip(spark):
    rows = [("company", "2024-02-21", "A_B", "K/B", "x" * 60), ("economy", "2024-02-21", "null", "C", "week_ly?")]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string, e string").select(registry.build_file_name(*map(F.col, "abcde")).alias("file_name"))
    got = registry.parse_names(df).orderBy("report_type").collect()
    assert [(r.report_type, r.target_name, r.broker, r.title) for r in got] == [("company", "A-B", "KB", "x" * 50 + "..."), ("economy", "null", "C", "week-ly")]


def test_registry_is_idempotent(spark, tmp_path):
    store = registry.Registry(spark, str(tmp_path))
    names = spark.createDataFrame([(n,) for n in ("company_2024-02-21_A_B_T.pdf", "company_2024-02-21_A_B_T.pdf", "company_2024-02-22_A_B_T.pdf", "bad.pdf")], "file_name string")
    assert store.register(names) == (2, 1)
    assert store.register(names) == (0, 3)
    store.mark(names.limit(1))
    store.mark(names.limit(1))
    assert store.reports().filter("is_embedded").count() == 1 and registry.pending(store.reports()).count() == 1
    store.reset()
    assert registry.pending(store.reports()).count() == 2
    assert [r.file_name for r in registry.by_target(store.reports(), "a").collect()] == ["company_2024-02-22_A_B_T.pdf", "company_2024-02-21_A_B_T.pdf"]
    assert registry.by_dates(store.reports(), "2024-02-22", "2024-02-29").count() == 1


def test_targets_fold_ascii_letters_alone(spark):
    df = spark.createDataFrame([(t, "2024-01-01", t) for t in ("Éclair", "éclair", "ACME Co", "a%b", "a\\b", None)], "target_name string, report_date string, file_name string")
    found = lambda text: {r.target_name for r in registry.by_target(df, text).collect()}
    assert found("É") == {"Éclair"} and found("é") == {"éclair"} and found("CLAIR") == {"Éclair", "éclair"} and found("acme") == {"ACME Co"}
    assert found("a%b") == {"a%b", "a\\b"} and found("a_b") == {"a%b", "a\\b"} and found("\\") == {"a\\b"} and found("zz") == set()


def test_knn_is_exact(spark):
    r = np.random.default_rng(0)
    v = r.normal(size=(60, 8)).round(1)
    rows = [(i, [float(x) for x in row]) for i, row in enumerate(np.concatenate([v, v[:5]]))]
    df = spark.createDataFrame([*rows, (99, None)], "chunk_id long, embedding array<double>").repartition(3)
    asked = df.filter("chunk_id < 10 OR chunk_id = 99").withColumnRenamed("chunk_id", "query_id")
    for block in (4096, 3):
        got = retrieve.knn(asked, df, 4, block=block).orderBy("query_id", "rank").collect()
        for q in range(10):
            d = [(round(sum((a - b) ** 2 for a, b in zip(rows[q][1], row)), 6), i) for i, row in rows]
            assert [(round(x.score, 6), x.chunk_id) for x in got if x.query_id == q] == sorted(d)[:4]
    assert retrieve.knn(asked.limit(0), df).count() == 0 and retrieve.knn(asked, df.limit(0)).count() == 0


def test_passages(spark):
    rows = [(0, i + 1, p, f"t{i}") for i, p in enumerate(["A", "A", "B", None, "C", None])]
    hits = spark.createDataFrame(rows, "query_id long, rank int, parent_id string, text string")
    kept = retrieve.one_per_parent(hits)
    assert sorted(r.rank for r in kept.collect()) == [1, 3, 4, 5, 6]
    parents = spark.createDataFrame([("A", "whole A"), ("C", "")], "parent_id string, content string")
    top = retrieve.top_passages(retrieve.with_parent_text(kept, parents))
    assert [(r.place, r.rank, r.text) for r in top.orderBy("place").collect()] == [(1, 1, "whole A"), (2, 3, "t2"), (3, 4, "t3")]


def test_listing(spark):
    rows = [("company", 0, i, d, "u") for i, d in enumerate(["2024-02-22", "2024-02-21", "2024-02-20", "2024-02-22"])] + [("industry", 1, 0, "2024-02-23", None), ("industry", 1, 1, "2024-02-22", "u")]
    df = spark.createDataFrame(rows, "category string, category_order int, pos long, d string, pdf_url string").withColumn("report_dt", F.col("d").cast("date"))
    assert sorted((r.category, r.pos) for r in listing.since(df, "2024-02-21").collect()) == [("company", 0), ("company", 1), ("industry", 1)]
    assert sorted((r.category, r.pos) for r in listing.since(df).collect()) == [("company", 0), ("industry", 1)]
    assert listing.latest_day(df, "2024-02-22").first().latest_date == "2024-02-22"
    assert listing.latest_day(df, "2024-02-19").first().latest_date is None
    assert listing.latest_day(df, "2024-12-31").first().latest_date == "2024-02-23"
    files = spark.createDataFrame([("a",), ("b",), ("a",)], "file_name string")
    assert tuple(listing.crawl_count(files, files.filter("file_name = 'b'")).first()) == (2, 1)


def test_prices(spark):
    symbols = spark.createDataFrame([("AB", "2"), ("ABC", "3"), ("XBX", "1")], "name string, code string")
    asked = spark.createDataFrame([("ABC",), ("B",), ("Z",), ("A.",)], "name_asked string")
    assert {r.name_asked: r.code for r in prices.resolve_tickers(asked, symbols).collect()} == {"ABC": "3", "B": "1", "Z": None, "A.": None}
    p = spark.createDataFrame([("t", f"2024-01-{d:02d}", float(d)) for d in (1, 3, 10, 11, 12, 13, 14, 15, 16)], "ticker string, d string, close double").withColumn("trade_date", F.col("d").cast("date")).drop("d")
    got = prices.recent_prices(p, "2024-01-15")
    assert [r.close for r in got.collect()] == [11.0, 12.0, 13.0, 14.0, 15.0]
    status, shown = prices.price_answer("AB", "2", got)
    assert status == "found" and "close | trade_date" in shown and shown.count("2024-01-") == 5
    assert prices.price_answer("AB", "2", got, 3)[1].endswith("(+2)")
    assert [prices.price_answer("AB", *x)[0] for x in ((None, None), ("2", got.limit(0)))] == ["unknown", "empty"]


def test_sessions(spark):
    h = spark.createDataFrame([("a", i, "user" if i % 2 == 0 else "AI", f"m{i}") for i in range(4)], "thread_id string, seq long, role string, text string")
    assert session.history_text(session.last_entries(h)).first().history == "[AI]\nm1\n\n[user]\nm2\n\n[AI]\nm3"
    turns = spark.createDataFrame([("a", "q", "x", False), ("b", "q2", "y", False), ("b", "q3", "z", True)], "thread_id string, question string, answer string, used_tool boolean")
    after = session.append(h, turns)
    assert sorted((r.thread_id, r.seq, r.text) for r in after.collect())[4:] == [("a", 4, "q"), ("a", 5, "x"), ("b", 0, "q2"), ("b", 1, "y")]
    asked = spark.createDataFrame([("a", "why?"), ("c", "new")], "thread_id string, question string")
    shown = {r.thread_id: r.rewritten_query for r in session.rewrite(asked, h, lambda q, past: F.concat(q, F.lit("!"))).collect()}
    assert shown == {"a": "why?!", "c": "new"}
    assert {r.rewritten_query for r in session.rewrite(asked, h, lambda q, past: F.lit("  ")).collect()} == {"why?", "new"}


@pytest.mark.parametrize("name,value,want", [("REPORTMILL_TEST_LIMIT", "0", None), ("REPORTMILL_TEST_LIMIT", "7", 7)])
def test_settings(name, value, want):
    assert Settings.from_env({name: value}).test_limit == want
    assert Settings.from_env({"REPORTMILL_PARENT_CHILD": "false"}).parent_child is False
