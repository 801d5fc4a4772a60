"""What keeps large tables within time and memory: the same results by less work."""

import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from reportmill.functions import text as X
from reportmill.operators import chunk, registry, retrieve
from reportmill.plans import sqlguard


def seconds(df):
    began = time.time()
    df.write.format("noop").mode("overwrite").save()
    return time.time() - began


def plain_strip(c):
    return F.regexp_replace(c, f"^{X.SPACE}+|{X.SPACE}+$", "")


def test_strip_is_no_regex(spark):
    odd = spark.createDataFrame([(a + "x" + b + "y" + c,) for a in ("", X.BLANKS, " \n") for b in ("", "\u2003 ", "é") for c in ("", "\r\n", "\u0085\u2029", X.BLANKS)] + [(X.BLANKS,), ("",), (None,)], "t string")
    assert odd.filter(~X.strip(F.col("t")).eqNullSafe(plain_strip(F.col("t")))).count() == 0
    assert odd.filter(~X.rstrip(F.col("t")).eqNullSafe(F.regexp_replace("t", f"{X.SPACE}+$", ""))).count() == 0
    long = spark.range(40).select(F.repeat(F.lit("some words "), 20_000).alias("t")).cache()
    long.count()
    seconds(long.select(X.strip(F.col("t"))))
    assert 3 * seconds(long.select(X.strip(F.col("t")))) < seconds(long.select(plain_strip(F.col("t"))))


def test_phrases_and_counts_beyond_ascii(spark):
    rows = [("가나 STOCK DATA",), ("é 가",), ("plain",), ("",), (None,), ("힣" * 9,), ("주요주주 é",)]
    df = spark.createDataFrame(rows, "t string")
    assert df.filter(~X.hangul(F.col("t")).eqNullSafe(F.regexp_count("t", F.lit(X.HANGUL)))).count() == 0
    assert [r[0] for r in df.select(X.contains_any(F.col("t"), ("STOCK DATA", "주주", "é"))).collect()] == [True, True, False, False, None, False, True]
    assert [r[0] for r in df.select(X.contains_any(F.col("t"), ("STOCK DATA", "주주", "é"), X.hangul(F.col("t")))).collect()] == [True, True, False, False, None, False, True]


@pytest.mark.parametrize(("patterns", "anchored"), [((r"^(a|b)\s*[|:]", r"^\(x|^y"), True), ((r"^a|b",), False), (("a", "^b"), False), ((r"^((a)|b)|c",), False)])
def test_any_of_is_anchored_only_where_each_is(spark, patterns, anchored):
    assert X.any_of(patterns, "(?i)").startswith("(?i)^") == anchored
    plain = "(?i)" + "|".join(f"(?:{p})" for p in patterns)
    df = spark.createDataFrame([(x,) for x in ("a:", "A |", "b", "xb", "y", " (x", "(x", "c", "xc", "")], "t string")
    assert df.filter(F.col("t").rlike(plain) != F.col("t").rlike(X.any_of(patterns, "(?i)"))).count() == 0


def plain_name(title):
    t = F.translate(plain_strip(F.regexp_replace(title, r'[\\/:*?"<>|]', "")), "_", "-")
    return F.concat(F.concat_ws("_", F.lit("a_2024-01-01_b_c"), F.when(F.length(t) > 50, F.concat(t.substr(1, 50), F.lit("..."))).otherwise(t)), F.lit(".pdf"))


def test_names_of_long_titles_are_cheap(spark):
    name = registry.build_file_name(F.lit("a"), F.lit("2024-01-01"), F.lit("b"), F.lit("c"), F.col("t"))
    titles = [x + "w_?" * n + y for x in ("", " " * 300, "?" * 210 + " ") for n in (0, 24, 25, 26, 66, 67, 100) for y in ("", " " * 400, " " * 400 + "end", "😀" * 60)]
    odd = spark.createDataFrame([(t,) for t in titles] + [(None,)], "t string")
    assert odd.filter(~name.eqNullSafe(plain_name(F.col("t")))).count() == 0
    long = spark.range(40).select(F.repeat(F.lit("some words "), 20_000).alias("t")).cache()
    long.count()
    seconds(long.select(name))
    assert 3 * seconds(long.select(name)) < seconds(long.select(plain_name(F.col("t"))))


def test_a_join_by_one_value_is_cut(spark, monkeypatch):
    monkeypatch.setitem(sqlguard.PIECES, "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "4k")
    monkeypatch.setitem(sqlguard.PIECES, "spark.sql.adaptive.advisoryPartitionSizeInBytes", "4k")
    monkeypatch.setitem(sqlguard.PIECES, "spark.sql.autoBroadcastJoinThreshold", "-1")
    r = spark.range(0, 1200, 1, 12).select(F.sha2(F.col("id").cast("string"), 256).alias("file_name"), F.lit("b").alias("broker"))
    before = spark.conf.getAll
    out = sqlguard.run(spark, "SELECT a.file_name, b.file_name AS other FROM reports a JOIN reports b ON a.broker = b.broker AND a.file_name < b.file_name", r)
    sizes = out.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert sum(sizes) == 1200 * 1199 // 2 and max(sizes) < sum(sizes) / 8
    assert spark.conf.getAll == before and "reports" not in [t.name for t in spark.catalog.listTables()]


def test_search_holds_few_distances():
    rng = np.random.default_rng(1)
    q, v = rng.random((600, 8)), rng.random((40_000, 8))
    v[1000:3000] = v[0]  # many equal vectors
    q[0] = v[0]
    side = lambda name, x, keys: pa.table({name: pa.array(keys), "v": pa.array(list(x), pa.list_(pa.float64()))})
    keys = np.arange(len(v))[::-1]
    queries, chunks = side("q", q, np.arange(len(q))), side("c", v, keys)
    tracemalloc.start()
    found = retrieve.nearest(5, "q", "c")(queries, chunks).to_pydict()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20
    rows = list(zip(found["q"], found["c"], found["score"], strict=True))
    for i in (0, 1, 599):
        d = ((v - q[i]) ** 2).sum(axis=1)
        want = [int(keys[j]) for j in np.lexsort((keys, np.round(d, 6)))[:5]]
        assert [c for _, c, _ in sorted((r for r in rows if r[0] == i), key=lambda r: (round(r[2], 6), r[1]))][:5] == want
    assert len([r for r in rows if r[0] == 0 and r[2] == 0]) == 5


def test_chunks_of_few_texts_at_once():
    batch = pa.record_batch({"doc_id": pa.array(range(1000)), "text": pa.array([None if i % 9 == 0 else f"word {i} " * 60 for i in range(1000)])})
    out = list(chunk.chunks_of_batches("text", 100, 10, "n", "chunk")(iter([batch])))
    assert len(out) == 4 and max(len(set(b.column("doc_id").to_pylist())) for b in out) <= chunk.ROWS
    got = pa.Table.from_batches(out).to_pydict()
    want = [(i, n, c) for i, t in zip(*batch.to_pydict().values(), strict=True) for n, c in enumerate(chunk.split_recursively(t, 100, 10) if t else [])]
    assert list(zip(got["doc_id"], got["n"], got["chunk"], strict=True)) == want
