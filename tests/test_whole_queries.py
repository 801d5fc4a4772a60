"""Queries over every row they have to ask for, on small tables."""

import pytest

from reportmill import queries
from reportmill.operators.retrieve import HashingEmbedder


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("small"))
    vectors = [(i, [float(i), 1.0], i % 2) for i in range(151)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    texts = [(i, f"the text of {i} " + "word " * 300 + f"end {i}", "en", f"s{i % 3}", 1500) for i in range(101)]
    spark.createDataFrame(texts, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    parts = [(i, f"part name {i:03}") for i in range(120)]
    spark.createDataFrame(parts, "p_partkey long, p_name string").write.parquet(f"{path}/part.parquet")
    return path


@pytest.mark.parametrize("name", ["topk", "filtered", "dedup_parent", "expand_parent", "context", "hit_report", "rerank_overlap"])
def test_searches_ask_every_fiftieth(spark, small, name):
    rows = queries.QUERIES[f"knn_{name}"](spark, small).collect()
    assert {r.query_id for r in rows} == {0, 50, 100, 150}
    assert not any(cut in queries.SQL[f"knn_{name}"] for cut in ("vec_id < 10", "1, 60", "% 4 <>", "% 9 <>"))


def test_whole_parents(spark, small):
    texts = {r.vec_id: r.text for r in queries.knn_expand_parent(spark, small).collect()}
    assert texts[50].endswith("end 10") and texts[100].endswith("end 20") and texts[0] == "chunk 0"
    context = {r.query_id: r.context for r in queries.knn_context(spark, small).collect()}
    assert "end 10" in context[50] and "알수없음" not in context[50] and "알수없음" in context[150]


def test_embed_search_asks_every_fiftieth(spark, small):
    """Against a plain loop over all documents."""
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    vectors = dict(zip(texts, HashingEmbedder()(list(texts.values()), "retrieval_document").astype(float), strict=True))
    want = {q: min((round(float(((vectors[q] - v) ** 2).sum()), 6), i) for i, v in vectors.items()) for q in (0, 50, 100)}
    assert {r.query_id: (round(r.score, 6), r.doc_id) for r in queries.embed_search(spark, small).collect()} == want


def test_every_part_name(spark, small):
    rows = {r.name_asked: r.code for r in queries.ticker_resolve(spark, small).collect()}
    assert len(rows) == 120 + len({f"part name {i:03}"[2:-1] for i in range(120)}) + 1
    assert all(rows[f"part name {i:03}"] == str(i) for i in range(120)) and rows["no such name"] is None


def test_every_window_under_its_prefix(spark, small):
    rows = [r for r in queries.chunk_context_prefix(spark, small).collect() if r.doc_id == 7]
    first = {r.chunk_index: r.chunk.split("\n", 1) for r in rows}
    text = spark.read.parquet(f"{small}/documents.parquet").filter("doc_id = 7").first().text
    assert len({r.chunk_id for r in rows}) == len(rows) == 4 and {x[0][:4] for x in first.values()} == {"[기업:"[:4]}
    assert first[0][1] + "".join(first[i][1][50:] for i in range(1, 4)) == text
