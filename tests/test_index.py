"""Replacing rows by key, and the clustered index against a scan of all vectors."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from reportmill.operators import retrieve, vector_index
from reportmill.operators.vector_index import NOWHERE, VectorIndex
from reportmill.sources import store

SCHEMA = "k string, v int, p int"


def files(path):
    return {os.path.relpath(os.path.join(d, f), path): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def test_replace_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda *r: spark.createDataFrame(list(r), SCHEMA)
    state = lambda: sorted(map(tuple, store.read_table(spark, path, SCHEMA).collect()))
    put = lambda df, owners=None: store.replace_rows(spark, path, SCHEMA, df, owners or df.select("k"), "k", "p")
    assert state() == []
    assert put(rows(("a", 1, 0), ("a", 2, 1), ("b", 3, 1), ("c", 4, 2), ("c", 4, 2))) == [0, 1, 2]
    before = files(path)
    assert put(rows(("a", 9, 1), ("d", 5, 1))) == [0, 1]  # a's row in 0 goes, and so does the partition
    assert state() == [("a", 9, 1), ("b", 3, 1), ("c", 4, 2), ("c", 4, 2), ("d", 5, 1)]
    after = files(path)
    assert {f: t for f, t in after.items() if f.startswith("p=2")} == {f: t for f, t in before.items() if f.startswith("p=2")}
    assert not any(f.startswith("p=0") for f in after)
    put(rows(("a", 9, 1), ("d", 5, 1)))
    assert state() == [("a", 9, 1), ("b", 3, 1), ("c", 4, 2), ("c", 4, 2), ("d", 5, 1)]
    assert put(rows(), rows(("c", 0, 0)).select("k")) == [2] and [r[0] for r in state()] == ["a", "b", "d"]
    assert put(rows()) == []


IDS = "chunk_id long, file_name string, embedding array<double>"


@pytest.fixture(scope="module")
def vectors():
    r = np.random.default_rng(3)
    centres = 20 * r.normal(size=(12, 6))
    v = np.concatenate([centres[i % 12] + r.normal(size=6) for i in range(600)]).reshape(600, 6).round(2)
    rows = [(i, f"f{i % 40}", [float(x) for x in v[i]]) for i in range(600)]
    return rows + [(1000 + i, "copies", [float(x) for x in v[5]]) for i in range(300)]  # a third are one vector


def scan(df, asked, k):
    return sorted((r.query_id, r.rank, r.chunk_id, round(r.score, 6)) for r in retrieve.knn(asked, df, k).collect())


def found(index, asked, k, **how):
    return sorted((r.query_id, r.rank, r.chunk_id, round(r.score, 6)) for r in index.search(asked, k, **how).collect())


def test_index_is_exact_and_reads_few_clusters(spark, vectors, tmp_path):
    df = spark.createDataFrame([*vectors, (5000, "f1", None), (5001, "f1", [1.0])], IDS).repartition(4)
    index = VectorIndex(spark, str(tmp_path / "rows"), IDS)
    index.put(df)
    asked = df.filter("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), "embedding")
    for k, how in ((5, {}), (1, {"block": 2, "group": 50}), (400, {})):
        assert found(index, asked, k, **how) == scan(df, asked, k)
    one = asked.filter("query_id = 50")
    assert found(index, one, 5) == scan(df, one, 5) and 0 < len(index.reads) <= len(index.centroids) // 3
    plan = index.rows(sorted(index.reads))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cluster" in plan
    assert {r.chunk_id for r in index.rows([NOWHERE]).collect()} == {5000, 5001}
    far = spark.createDataFrame([(1, [1e3] * 6), (2, [0.0] * 6), (3, None), (4, [1.0])], "query_id long, embedding array<double>")
    assert found(index, far, 5) == scan(df.filter("chunk_id <> 5001"), far, 5)


def test_batches_go_to_their_clusters(spark, vectors, tmp_path):
    df = spark.createDataFrame(vectors, IDS)
    index = VectorIndex(spark, str(tmp_path / "rows"), IDS)
    asked = df.filter("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), "embedding")
    assert found(index, asked, 5) == []
    index.put(df.filter("chunk_id % 2 = 0"))
    centroids = index.centroids.copy()
    again = VectorIndex(spark, str(tmp_path / "rows"), IDS)  # another session
    again.put(df.filter("file_name <> 'f1'"), df.select("file_name"))
    assert (again.centroids == centroids).all()
    assert found(again, asked, 5) == scan(df.filter("file_name <> 'f1'"), asked, 5)
    before = files(str(tmp_path / "rows"))
    moved = spark.createDataFrame([(7000, "f2", vectors[0][2])], IDS)
    touched = again.put(moved)
    assert found(again, asked, 5) == scan(df.filter("file_name NOT IN ('f1', 'f2')").unionByName(moved), asked, 5)
    untouched = {f: t for f, t in before.items() if int(f.split("/")[0].split("=")[1]) not in touched}
    assert untouched and untouched.items() <= files(str(tmp_path / "rows")).items()


def test_rebuilt_for_what_has_grown(spark, vectors, tmp_path):
    df = spark.createDataFrame(vectors, IDS)
    index, other = VectorIndex(spark, str(tmp_path / "rows"), IDS), VectorIndex(spark, str(tmp_path / "rows"), IDS)
    asked = df.filter("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), "embedding")
    assert found(other, asked, 3) == []
    index.put(df.filter("chunk_id < 9"))
    index.put(df.filter("chunk_id >= 9 AND file_name <> 'f1'"), df.filter("chunk_id >= 9").select("file_name"))
    want = scan(index.rows().select("chunk_id", "embedding"), asked, 3)
    assert len(index.centroids) == 3 and found(other, asked, 3) == want
    index.rebuild(20)
    assert len(index.centroids) == 20 and found(index, asked, 3) == want


def test_bounds_hold_under_rounding():
    r = np.random.default_rng(1)
    v, c = 1e4 + r.normal(size=(50, 32)), 1e4 + r.normal(size=(9, 32))
    square, off = vector_index.squares(v, c)
    exact = ((v[:, None] - c[None]) ** 2).sum(axis=2)
    assert (np.abs(square - exact) <= off).all()


def test_an_index_of_nothing(spark, tmp_path):
    index = VectorIndex(spark, str(tmp_path / "rows"), IDS)
    none = spark.createDataFrame([(1, "f", None)], IDS)
    index.put(none)
    asked = spark.createDataFrame([(1, [1.0])], "query_id long, embedding array<double>")
    assert index.search(asked).count() == 0 and index.rows().count() == 1
    index.put(spark.createDataFrame([(2, "g", [1.0])], IDS))
    assert [r.chunk_id for r in index.search(asked).collect()] == [2]
    assert index.fetch(index.search(asked), ["file_name"]).first().file_name == "g"
