"""The engine from files to answers, the SQL guard, the stream, and the driver's contract."""

import pytest

import __spark_entry__ as entry_module
from reportmill.config import Settings
from reportmill.plans import sqlguard
from reportmill.plans.engine import Engine
from reportmill.queries import STATEMENTS
from reportmill.streaming.ingest import register_stream

TEXT = "# Outlook for chips\n\nRevenue of memory chips grew strongly in the last quarter of the year.\n\n# Risks are described here\n\nWeak demand for phones could slow the growth of the company next year.\n"


@pytest.fixture
def folder(tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    (d / "company_2024-02-21_Acme_BrokerA_Chips and memory.pdf").write_text(TEXT + "\f" + "Compliance Notice\nnothing below is read")
    (d / "industry_2024-02-22_Cars_BrokerB_Cars+more.PDF").write_text("Car makers sold more electric cars in February than in the whole year before.")
    (d / "economy_2024-02-23_null_BrokerB_Empty.pdf").write_text("  \n ")
    (d / "notes.txt").write_text("x")
    return str(d)


def test_ingest_and_ask(spark, folder, tmp_path):
    engine = Engine(spark, str(tmp_path / "out"), Settings(test_limit=None))
    assert engine.ask("memory chips revenue").text.startswith("죄송합니다")
    assert engine.register(folder) == (3, 0) and engine.register(folder) == (0, 3)
    assert {r.status: r.n for r in engine.ingest(folder).collect()} == {"success": 2, "failed": 1}
    stored = spark.read.parquet(str(tmp_path / "out" / "chunks"))
    n = stored.count()
    assert n and stored.filter("text LIKE '%nothing below%'").count() == 0
    engine.registry.reset()
    engine.ingest(folder)
    assert spark.read.parquet(str(tmp_path / "out" / "chunks")).count() == n
    answer = engine.ask("revenue of memory chips")
    assert answer.route == "vectordb" and "memory chips" in answer.prompt and answer.hits.first().target_name == "Acme"
    answer = engine.ask("x", sql="```sql\nSELECT broker, count(*) AS n FROM reports GROUP BY broker\n```")
    assert {r.broker: r.n for r in answer.rows.collect()} == {"BrokerA": 1, "BrokerB": 2}
    assert engine.ask("x", sql="DROP TABLE reports").rejected.reason == "kind"
    assert engine.ask("how many reports are there").route == "rdb"
    assert engine.history.count() == 10


def test_model(spark, folder, tmp_path):
    said = []

    def model(prompt):
        said.append(prompt)
        return " RDB " if "rdb라고" in prompt or "rdb" in prompt and "vectordb" in prompt else "SELECT title FROM reports" if "SQL:" in prompt else "an answer"

    engine = Engine(spark, str(tmp_path / "out"), Settings(), model=model)
    engine.register(folder)
    answer = engine.ask("titles?")
    assert answer.route == "rdb" and answer.text == "an answer" and answer.rows.count() == 3


def test_stream(spark, folder, tmp_path):
    engine = Engine(spark, str(tmp_path / "out"))
    for _ in range(2):
        register_stream(spark, folder, engine.registry, str(tmp_path / "checkpoint")).awaitTermination(120)
    assert engine.registry.reports().count() == 3


@pytest.mark.parametrize("sql,verdict", STATEMENTS)
def test_guard(spark, sql, verdict):
    rejected = sqlguard.check(spark, sql)
    assert (rejected.reason if rejected else "accept") == verdict


@pytest.mark.parametrize(
    "sql",
    [
        "SELECT * FROM reports WHERE 1 IN (SELECT 1 FROM (SELECT * FROM secret) x)", "SELECT (SELECT max(a) FROM t2) FROM reports", "SELECT * FROM reports TABLESAMPLE (1 ROWS), LATERAL (SELECT * FROM s)",
        "SELECT reflect('java.lang.System', 'getenv')", "SELECT * FROM reports JOIN csv.`/etc/passwd` p", "SELECT upper(java_method('a','b'))", "CREATE TABLE reports AS SELECT 1", "SELECT input_file_name() FROM reports", "CACHE TABLE reports",
        "SELECT * FROM json_tuple('a')", "FROM reports SELECT TRANSFORM (title) USING 'cat' AS x", "DESCRIBE reports", "TRUNCATE TABLE reports", "UPDATE reports SET title = 1",
    ],
)
def test_guard_refuses(spark, sql):
    assert sqlguard.check(spark, sql) is not None


def test_guard_refuses_registered_functions(spark):
    own = spark.newSession()  # functions belong to a session
    own.udf.register("leak", lambda: "x")
    own.udf.register("upper", lambda x: "x")
    assert sqlguard.check(own, "SELECT leak() FROM reports").reason == "function"
    assert sqlguard.check(own, "SELECT upper(title) FROM reports").reason == "function"
    assert sqlguard.check(own, "SELECT lower(title) FROM reports") is None and sqlguard.check(spark, "SELECT upper(title) FROM reports") is None


def test_contract(spark):
    queries, oracles = entry_module.queries(), entry_module.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 55
    df = entry_module.entry(spark)
    assert df.count() > 0 and df.columns == ["broker", "n_reports", "latest_date", "n_targets", "latest_title"]
