"""Threads that last, their stream, models in workers, the guard's view, and the engine over them."""

import os
import random
import threading

import pytest
from pyspark.sql import functions as F

from reportmill.config import Settings
from reportmill.operators.model import Model, answered, scored
from reportmill.operators.session import last_entries
from reportmill.operators.threads import Threads
from reportmill.plans import sqlguard
from reportmill.plans.engine import Engine
from reportmill.sources import store
from reportmill.streaming import conversations as C

TURN = "thread_id string, question string, answer string, used_tool boolean"


def plan_size(df):
    return df._jdf.queryExecution().analyzed().toString().count("\n")


def test_a_hundred_turns(spark, tmp_path):
    threads = Threads(spark, str(tmp_path / "h"))
    say = lambda s, *turns: s.say(spark.createDataFrame([(*t, False) for t in turns], TURN))
    sizes = set()
    for i in range(100):
        say(threads, ("a", f"q{i}", f"a{i}"), *([("b", f"x{i}", None)] if i % 10 == 0 else []))
        sizes.add(plan_size(threads.entries("a")))
    assert len(sizes) == 1 and sizes.pop() < 40
    again = Threads(spark, str(tmp_path / "h"))  # a restart
    got = [(r.seq, r.role, r.text) for r in again.entries("a").orderBy("seq").collect()]
    assert got == [(2 * i + j, role, f"{t}{i}") for i in range(100) for j, (role, t) in enumerate((("사용자", "q"), ("AI", "a")))]
    again.compact()
    assert again.entries().count() == 220 and len([f for f in os.listdir(tmp_path / "h") if f.endswith(".parquet")]) <= 4
    again.clear("a")
    assert again.entries("a").count() == 0 and again.entries("b").count() == 20
    say(again, ("a", "new", "yes"))
    assert [r.text for r in last_entries(again.entries("a")).orderBy("seq").collect()] == ["new", "yes"]
    assert {r.thread_id: r.name for r in again.names().collect()} == {"a": "new...", "b": "x0..."}
    again.say(spark.createDataFrame([("c", "price?", "9", True)], TURN))
    assert again.entries("c").count() == 0 and again.new() != again.new()


def test_stream_of_entries(spark, tmp_path):
    """In several runs and any order, against a plain loop; a run without new files changes nothing."""
    r = random.Random(1)
    rows = [(r.choice([1, 2, 3, None]), r.choice([None, *range(50)]), r.choice(["user", "AI"]), r.choice([None, "x", "y\n", " z"])) for _ in range(200)] + [(9, i, "user", f"t{i}") for i in range(120)]
    r.shuffle(rows)
    path, done = str(tmp_path / "in"), []
    for lo in range(0, len(rows), 110):
        done += rows[lo : lo + 110]
        spark.createDataFrame(rows[lo : lo + 110], C.ENTRIES).repartition(3).write.mode("append").parquet(path)
        stream = spark.readStream.schema(C.ENTRIES).option("maxFilesPerTrigger", 2).parquet(path)
        C.keep_conversations(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(200)
        want = {}
        for t in {x[0] for x in done} - {None}:
            own = sorted((s, role, text is not None, text or "") for k, s, role, text in done if k == t and s is not None)
            want[t] = (len(own), own[-1][0], "".join(f"[{role}]\n{text}\n\n" for _, role, _, text in own[-3:]).strip())
        assert {x.thread_id: (x.n_entries, x.last_seq, x.history) for x in C.states_of(spark, str(tmp_path / "out")).collect()} == want
    C.keep_conversations(spark.readStream.schema(C.ENTRIES).parquet(path), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(200)
    assert {x.thread_id for x in C.states_of(spark, str(tmp_path / "out")).collect()} == set(want)


def counting(path, ask):
    """A model that leaves a file in path for each start."""

    def start():
        import uuid

        open(os.path.join(path, f"start-{os.getpid()}-{uuid.uuid4().hex}"), "w").close()
        return ask

    return start


def test_one_start_a_worker(spark, tmp_path):
    def ask(prompts):
        if "bad" in prompts:
            raise ValueError("no")
        return [p.upper() for p in prompts]

    model = Model("upper", counting(str(tmp_path), ask), batch=7)
    df = spark.range(400).repartition(9).select("id", F.when(F.col("id") % 11 == 0, None).when(F.col("id") == 5, "bad").otherwise(F.concat(F.lit("p"), F.col("id"))).alias("p"))
    for _ in range(2):
        rows = {r.id: r for r in answered(df, F.col("p"), model).collect()}
        assert rows[5].answer is None and rows[5].answer_error == "ValueError: no" and rows[11].answer is None and rows[11].answer_error is None
        assert all(r.answer == f"P{i}" for i, r in rows.items() if i % 11 and i != 5)
    starts = os.listdir(tmp_path)
    assert 1 <= len(starts) == len({s.split("-")[1] for s in starts})  # no worker starts it twice, in two plans of nine tasks
    length = Model("length", counting(str(tmp_path), lambda pairs: [float(len(q + t)) for q, t in pairs]))
    got = scored(df.filter("id < 12"), F.lit("q"), F.col("p"), length).collect()
    assert {r.id: r.score for r in got} == {i: None if i % 11 == 0 else 4.0 if i == 5 else float(2 + len(str(i))) for i in range(12)}


def test_the_guard_gives_the_view_back(spark):
    mine, reports = spark.range(3).withColumnRenamed("id", "own"), spark.createDataFrame([("B",)], "broker string")
    mine.createOrReplaceTempView("reports")
    try:
        assert [r.broker for r in sqlguard.run(spark, "SELECT broker FROM reports", reports).collect()] == ["B"]
        with pytest.raises(Exception, match="UNRESOLVED_COLUMN"):
            sqlguard.run(spark, "SELECT none FROM reports", reports)
        assert spark.table("reports").columns == ["own"] and spark.table("reports").count() == 3
    finally:
        spark.catalog.dropTempView("reports")
    sqlguard.run(spark, "SELECT broker FROM reports", reports)
    assert not spark.catalog.tableExists("reports")
    got = {}

    def one(i):
        got[i] = sqlguard.run(spark, "SELECT n FROM reports", spark.createDataFrame([(i,)], "n int")).first().n

    at_once = [threading.Thread(target=one, args=(i,)) for i in range(6)]
    [t.start() for t in at_once], [t.join() for t in at_once]
    assert got == {i: i for i in range(6)}


TEXT = "# Outlook for chips\n\nRevenue of memory chips grew strongly in the last quarter of the year.\n"


@pytest.fixture
def folder(tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    for i in range(6):
        (d / f"company_2024-02-2{i}_Acme{i}_BrokerA_Chips.pdf").write_text(TEXT + f"\nThe company number {i} sold more of them than ever before.\n")
    return d


def test_a_changed_file_replaces_its_text(spark, folder, tmp_path):
    calls = str(tmp_path / "calls")
    os.mkdir(calls)

    def extract(content):
        import uuid

        open(os.path.join(calls, uuid.uuid4().hex), "w").close()
        return content.decode().split("\f")

    engine = Engine(spark, str(tmp_path / "out"), Settings(test_limit=None))
    engine.register(str(folder))
    assert {r.status: r.n for r in engine.ingest(str(folder), extractor=extract).collect()} == {"success": 6}
    assert len(os.listdir(calls)) == 6 and engine.observed["characters"] > 600
    size, before = engine.index.rows().count(), engine.parents().count()
    (folder / "company_2024-02-21_Acme1_BrokerA_Chips.pdf").write_text("# Outlook for ships\n\nOrders of container ships fell to nothing in this year, says the yard.\n")
    (folder / "company_2024-02-22_Acme2_BrokerA_Chips.pdf").write_text(" ")
    os.remove(folder / "company_2024-02-23_Acme3_BrokerA_Chips.pdf")
    engine.registry.reset()
    parts = {d: os.stat(os.path.join(tmp_path, "out", "parents", d)).st_mtime_ns for d in os.listdir(tmp_path / "out" / "parents") if "=" in d}
    assert {r.status: r.n for r in engine.ingest(str(folder), extractor=extract).collect()} == {"success": 4, "failed": 1, "missing": 1}
    assert len(os.listdir(calls)) == 11
    text = {r.file_name: r.content for r in engine.parents().collect()}
    assert "container ships" in text["company_2024-02-21_Acme1_BrokerA_Chips.pdf"] and "chips" not in text["company_2024-02-21_Acme1_BrokerA_Chips.pdf"]
    kept = f"bucket={spark.range(1).select(store.bucket_of(F.lit('company_2024-02-23_Acme3_BrokerA_Chips.pdf')).alias('b')).first().b}"
    others = {f"bucket={spark.range(1).select(store.bucket_of(F.lit(n)).alias('b')).first().b}" for n in text if "Acme3" not in n}
    if kept not in others:
        assert os.stat(os.path.join(tmp_path, "out", "parents", kept)).st_mtime_ns == parts[kept]
    assert engine.parents().count() == before and engine.index.rows().count() == size
    assert "container ships" in engine.ask("orders of container ships").prompt
    starts = str(tmp_path / "starts")
    os.mkdir(starts)
    layout = Model("layout", counting(starts, lambda content: content.decode().split("\f")))
    engine.registry.reset()
    assert {r.status: r.n for r in engine.ingest(str(folder), extractor=layout).collect()} == {"success": 4, "failed": 1, "missing": 1}
    assert 1 <= len(os.listdir(starts)) == len({s.split("-")[1] for s in os.listdir(starts)})
    engine.reset()
    assert engine.parents().count() == 0 and engine.ask("x").text.startswith("죄송합니다")


def test_threads_and_prices_of_the_engine(spark, folder, tmp_path):
    symbols = spark.createDataFrame([("Acme Chips", "001"), ("Acme", "002"), ("Zeta Holdings", "003")], "name string, code string")
    days = [("003", f"2024-01-{d:02d}", float(d)) for d in range(1, 21)] + [("002", "2024-01-05", 7.0)]
    prices = spark.createDataFrame(days, "ticker string, d string, close double").select("ticker", F.col("d").cast("date").alias("trade_date"), "close")
    engine = Engine(spark, str(tmp_path / "out"), symbols=symbols, prices=prices, tool=lambda q: q.rpartition("price of ")[2] if "price of " in q else None)
    answer = engine.ask("what is the price of Zeta")
    assert answer.used_tool and answer.price_status == "found" and "`003`" in answer.text and [f"2024-01-{d}" in answer.text for d in (15, 16, 20)] == [False, True, True]
    assert engine.ask("the price of Nobody").price_status == "unknown"
    assert engine.history.count() == 0  # tool answers are no history
    first = engine.thread
    engine.ask("how many reports are there")
    second = engine.new_thread()
    engine.ask("list of reports")
    engine.switch_thread(first)
    engine.ask("how many again")
    assert {r.thread_id: r["count"] for r in engine.history.groupBy("thread_id").count().collect()} == {first: 4, second: 2}
    engine.clear_thread()
    assert {r.thread_id for r in engine.history.collect()} == {second}


def test_many_questions_in_one_plan(spark, folder, tmp_path):
    starts = str(tmp_path / "starts")
    os.mkdir(starts)

    def ask(prompts):
        def one(p):
            if "SQL:" in p:
                return "```sql\nSELECT title FROM reports\n```"
            if "vectordb" in p:
                return " RDB " if "titles" in p else "vectordb"
            return "rewritten " + p.split("[질문]\n")[1].split("\n")[0] if "[이전 대화]" in p else "answer to " + p.split("[질문]\n")[1].split("\n")[0]

        return [one(p) for p in prompts]

    engine = Engine(spark, str(tmp_path / "out"), Settings(test_limit=None), workers=Model("many", counting(starts, ask)))
    with pytest.raises(ValueError):
        Engine(spark, str(tmp_path / "other")).ask_many(spark.createDataFrame([], "query_id long, thread_id string, question string"))
    engine.register(str(folder))
    asked = spark.createDataFrame([(i, "t" if i == 1 else f"u{i}", "titles?" if i % 3 == 0 else f"memory chips {i}") for i in range(12)], "query_id long, thread_id string, question string")
    assert {r.answer for r in engine.ask_many(asked.filter("query_id % 3 = 1")).collect()} == {"죄송합니다. 이 질문과 이어지는 대목이 등록된 리포트에 없습니다."}
    engine.ingest(str(folder))
    engine.threads.say(spark.createDataFrame([("t", "before", "yes", False)], TURN))
    rows = {r.query_id: r for r in engine.ask_many(asked).collect()}
    assert len(rows) == 12 and all(rows[i].route == "rdb" and rows[i].answer == "SELECT title FROM reports" for i in range(0, 12, 3))
    assert rows[1].rewritten_query == "rewritten memory chips 1" and rows[1].answer == "answer to rewritten memory chips 1"
    assert all(rows[i].answer == f"answer to memory chips {i}" and "Revenue" in rows[i].prompt for i in (2, 4, 5, 7))
    assert len(os.listdir(starts)) == len({s.split("-")[1] for s in os.listdir(starts)})
    assert engine.ask("x", sql=rows[0].answer).rows.count() == 6
