"""What operator 7 has on disk at once: shuffles go with the table they made, texts of candidates are dealt out in rounds."""

import random
import time
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from reportmill.llm import common, components, fuzzy_lines
from reportmill.llm.fuzzy_lines import line_dedup


def shuffles(spark):
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = manager.getAllFiles()
    files = [files.apply(k) for k in range(files.size())]
    return {f.getName(): f.length() for f in files if f.getName().startswith("shuffle_")}


def test_shuffles_of_a_written_table_are_removed(spark):
    kept = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    kept.collect()  # a shuffle of the caller's
    before = shuffles(spark)
    out = common.written(kept.join(spark.range(9).toDF("k"), "k").groupBy("k").agg(F.max("count").alias("n")), "shuffled")
    for _ in range(100):
        if not (left := shuffles(spark).keys() - before.keys()):
            break
        time.sleep(0.1)
    assert not left
    assert spark.conf.get(common.CLEANUP, "false") == "false"
    assert out.count() == 7 and kept.count() == 7


def documents(spark):
    """Random lines of few words, which share bands, some with a word changed, and near copies."""
    r = random.Random(5)
    vocabulary = ["".join(r.choice("abdefgiklmnoprtu") for _ in range(r.randint(2, 5))) for _ in range(30)]
    lines = [" ".join(r.choice(vocabulary) for _ in range(r.randint(3, 60))) for _ in range(150)]
    rows = []
    for _ in range(100):
        some = [r.choice(lines).split() for _ in range(r.randint(1, 5))]
        for words in some:
            if r.random() < 0.6:
                words[r.randrange(len(words))] = r.choice(vocabulary)
        rows.append("\n".join(" ".join(w) for w in some))
    return spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)


def recorded(monkeypatch):
    tables = {}

    def written(df, name, real=components.written):
        out = real(df, name)
        tables.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(components, "written", written)
    return tables


def test_rounds_change_no_result(spark, monkeypatch):
    docs = documents(spark)
    rows = lambda: sorted(map(tuple, line_dedup(docs).collect()), key=str)
    want, tables = rows(), recorded(monkeypatch)
    assert sum(x[2] for x in want) > 50
    monkeypatch.setattr(fuzzy_lines, "ROUND", 1)
    assert rows() == want
    assert len(tables["verified"]) > 3
    assert max(tables["verified"][:-1]) < tables["verified"][-1] == sum(tables["verified"][:-1])  # the last is all of them


def test_open_groups_are_settled_in_rounds(spark, monkeypatch):
    class Neighbours:  # links are those of nodes that follow each other
        def __init__(self, rows):
            self.node = rows.column("node").to_numpy()

        def may(self, key, x, y):
            return np.ones(len(x), bool)

        def links(self, x, y):
            return np.abs(self.node[x] - self.node[y]) == 1

    monkeypatch.setattr(components, "BLOCK", 3)
    open_ = spark.createDataFrame([(k, n, n) for k in (1, 2) for n in range(40)], "key long, node long, g long")
    tables = recorded(monkeypatch)
    for most, rounds in ((None, 0), (10**6, 0), (200, 2 * 40 * 14 // 200 + 1)):
        found = {(x.a, x.b) for x in components.settled(open_, open_.select("node").distinct(), Neighbours, most).collect()}
        assert found == {(n, n + 1) for n in range(39)}
        assert len(tables.get("settled", [])) == rounds + (rounds > 0)
    assert components.settled(open_.limit(0), open_.select("node").distinct(), Neighbours, 200).count() == 0


def test_no_table_stays_but_what_the_result_reads(spark):
    path = Path(common.shared_dir(spark).removeprefix("file://"))
    before = set(path.iterdir())
    out = line_dedup(documents(spark))
    assert {p.name.rsplit("-", 1)[0] for p in set(path.iterdir()) - before} <= {"gone", "links", "components"}
    assert out.count() == 100


def test_a_stage_of_the_pipeline_leaves_no_texts_in_shuffles(spark):
    docs = documents(spark).select("doc_id", "text", F.lit("en").alias("lang"), F.lit("src0").alias("source"))
    docs = common.written(corpus_pipeline.documents(docs), "documents")
    before, size = shuffles(spark), docs.agg(F.sum("n_chars")).first()[0]
    out = common.written(corpus_pipeline.dedup_lines(spark, docs, ""), "line_dedup")
    for _ in range(100):
        left = sum(n for name, n in shuffles(spark).items() if name not in before)
        if left < size / 4:
            break
        time.sleep(0.1)
    assert left < size / 4  # counts and the like
    assert 0 < out.count() < 100
