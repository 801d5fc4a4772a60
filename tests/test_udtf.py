"""The splitter from SQL, and the chunk queries against plain loops."""

import pytest

from reportmill import queries
from reportmill.functions import udtf
from reportmill.operators import chunk

TEXTS = ["", None, "a b. c\n\nd " * 300, "x" * 5000, "one", "word " * 2000 + "\n" + "é" * 700, " \n "]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs"))
    spark.createDataFrame([(i, t, "k") for i, t in enumerate(TEXTS)], "doc_id long, text string, source string").repartition(2).write.parquet(f"{path}/documents.parquet")
    return path


def test_table_functions_are_the_splitter(spark, docs):
    udtf.register(spark)
    d = spark.read.parquet(f"{docs}/documents.parquet")
    d.createOrReplaceTempView("udtf_docs")
    want = sorted(map(tuple, chunk.recursive_chunks(d.select("doc_id", "text"), "text", 200, 20).select("doc_id", "chunk_index", "chunk").collect()))
    assert len(want) > 50
    assert sorted(map(tuple, spark.sql("SELECT d.doc_id, c.* FROM udtf_docs d, LATERAL split_text(d.text, 200, 20) c").collect())) == want
    for partitioned in ("", " PARTITION BY (source)"):
        out = spark.sql(f"SELECT * FROM split_table(TABLE(udtf_docs){partitioned}, 'text', 200, 20)")
        assert out.columns == ["doc_id", "source", "chunk_index", "chunk"]
        assert sorted(map(tuple, out.select("doc_id", "chunk_index", "chunk").collect())) == want
    for bad in ("'none', 200, 20", "'chunk', 200, 20"):
        with pytest.raises(Exception, match="no column"):
            spark.sql(f"SELECT * FROM split_table(TABLE(udtf_docs), {bad})")
    spark.catalog.dropTempView("udtf_docs")


def test_stats_are_those_of_a_loop(spark, docs):
    want = {}
    for i, t in enumerate(TEXTS):
        parents = [p for p in chunk.split_recursively(t, 2000, 200)] if t else []
        children = [c for p in parents for c in chunk.split_recursively(p, 500, 50)]
        if children:
            want[i] = (len(parents), len(children), max(map(len, children)))
    for name in ("chunk_recursive_stats", "chunk_udtf_stats"):
        assert {r.doc_id: (r.n_parents, r.n_children, r.longest) for r in queries.QUERIES[name](spark, docs).collect()} == want


def test_sections_of_many_headings(spark):
    """In time that grows with the text: some seconds for 40,000 headings."""
    text = "\n".join(f"{'#' * (i % 3 + 1)} t{i}\nline {i}" for i in range(40_000))
    df = spark.createDataFrame([(1, "k", text), (2, "j", None), (3, "j", " \n"), (4, "r", "# a \r\nx\n####  b\n#c\n## \n ")], "doc_id long, content string, text string")
    rows = chunk.header_sections(df.withColumnRenamed("content", "key"), "text", ("doc_id", "key"))
    got = rows.collect()
    assert rows.columns == ["doc_id", "key", "section", "h1", "h2", "h3", "content"]
    assert sum(r.doc_id == 1 for r in got) == 40_000
    last = max((r for r in got if r.doc_id == 1), key=lambda r: r.section)
    assert (last.h1, last.h2, last.h3) == ("t39999", None, None) and last.content == "# t39999\nline 39999"
    assert [(r.section, r.h1, r.h2, r.content) for r in got if r.doc_id == 4] == [(1, "a", None, "# a \r\nx\n####  b\n#c"), (2, "a", "", "## \n ")]
    assert not any(r.doc_id in (2, 3) for r in got)
