"""Ingestion and questions, as one engine over a folder of tables."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.rules import DEFAULT, Rules
from ..functions.text import clean_document, cleaning_error, fill, strip, without_fences
from ..operators import chunk, retrieve, session
from ..operators.grams import GramIndex
from ..operators.model import Model, answered, scored
from ..operators.prices import price_answer, recent_prices, resolve_tickers
from ..operators.registry import Registry, pending
from ..operators.threads import Threads
from ..operators.vector_index import VectorIndex
from ..schema import CHUNKS, PARENTS
from ..sources import files, store
from . import sqlguard

log = logging.getLogger(__name__)

ANSWER_FROM_TEXT = "[자료]\n{context}\n\n[질문]\n{question}\n\n위 자료만으로 답하고 출처를 밝히세요.\n답변:"
ANSWER_FROM_TABLE = "[조회 결과]\n{result}\n\n[질문]\n{question}\n\n답변:"
WRITE_SQL = "테이블 reports(report_type, report_date, target_name, title, broker)에 대한 SELECT 문 하나만 쓰세요.\n[질문]\n{question}\nSQL:"
CHOOSE_ROUTE = "질문에 reports 테이블만으로 답할 수 있으면 rdb, 본문이 필요하면 vectordb라고 쓰세요.\n[질문]\n{question}"
REWRITE = "[이전 대화]\n{history}\n\n[질문]\n{question}\n\n대화 없이도 뜻이 통하는 질문 한 줄로 다시 쓰세요."
NOTHING_FOUND = "죄송합니다. 이 질문과 이어지는 대목이 등록된 리포트에 없습니다."
NO_INDEX = "죄송합니다. 아직 색인된 리포트가 없습니다. 먼저 리포트를 등록해 주세요."


#: Rows of a result that a prompt holds; where there are more it says so. Answer.rows has them all.
SHOWN = 1000


@dataclass
class Answer:
    """What the engine found: the rows, the prompt for a language model, and its text where there is a model."""

    route: str
    question: str
    rewritten: str
    rows: DataFrame | None = None
    prompt: str | None = None
    text: str | None = None
    hits: DataFrame | None = None
    rejected: sqlguard.Rejected | None = None
    used_tool: bool = False
    price_status: str | None = None


class Engine:
    """model: from a prompt to a text. Without one, questions go by keywords and answers stay prompts and rows.

    workers: a model that tasks start for themselves; ask_many and reranking use it. prices(ticker, trade_date, ..) and
    the listing symbols(name, code) answer what `tool` makes of a question: the name of a company whose prices are asked
    for, or None.
    """

    def __init__(
        self, spark: SparkSession, path: str, settings: Settings | None = None, embedder: retrieve.Embedder | None = None, model: Callable[[str], str] | None = None, rules: Rules = DEFAULT,
        workers: Model | None = None, scorer: Model | None = None, symbols: DataFrame | None = None, prices: DataFrame | None = None, tool: Callable[[str], str | None] | None = None,
    ):
        self.spark, self.path = spark, path.rstrip("/")
        self.settings = settings or Settings.from_env()
        self.embedder, self.model, self.rules = embedder or retrieve.HashingEmbedder(), model, rules
        self.workers, self.scorer, self.prices, self.tool = workers, scorer, prices, tool
        self.registry = Registry(spark, f"{self.path}/catalog")
        self.index = VectorIndex(spark, f"{self.path}/chunks", CHUNKS + ", embedding array<float>")
        self.threads = Threads(spark, f"{self.path}/history")
        self.thread = "main"
        self._symbols, self._names = symbols, None

    def register(self, folder: str) -> tuple[int, int]:
        return self.registry.register(files.report_files(self.spark, folder).select("file_name"))

    def ingest(self, folder: str, limit: int | None = None, extractor: files.Extractor | Model = files.plain_pages, fallback: files.Extractor | Model | None = None) -> DataFrame:
        """Extract, clean, split, embed and store what is registered and pending; status, n of the files.

        One distributed job over all files; a file that fails has an error and does not stop the others. Each file is
        extracted and cleaned once, and that job counts what succeeds and fails. Parents and chunks of a file replace
        those of an earlier run; partitions without one of these files stay as they are.
        """
        limit = self.settings.test_limit if limit is None else limit
        todo = pending(self.registry.reports(), limit)
        present = files.report_files(self.spark, folder).select("file_name")
        texts = files.extract_texts(self.spark, folder, extractor, fallback, only=todo.select("file_name"))
        read = todo.join(texts, "file_name")
        cleaned = read.withColumn("clean", clean_document(F.col("text"), self.rules))
        judged = cleaned.withColumn("error", F.coalesce("error", cleaning_error(F.col("text"), F.col("clean"))))
        seen = Observation("ingest")
        judged = judged.select("file_name", "target_name", "title", "report_date", "broker", "clean", "error").observe(
            seen, F.count_if(F.col("error").isNull()).alias("success"), F.count_if(F.col("error").isNotNull()).alias("failed"), F.coalesce(F.sum(F.length("clean")), F.lit(0)).alias("characters")
        )
        judged = store.kept(judged, "judged")
        self.observed = dict(seen.get)
        good = judged.filter("error IS NULL")
        keys = ("file_name", "target_name", "title", "report_date", "broker")
        sections = chunk.header_sections(good.select(*keys, "clean"), "clean", keys)
        parents, chunks = chunk.chunk_reports(sections, self.settings)
        owners = good.select("file_name")
        if parents is not None:
            parents = parents.withColumn("bucket", store.bucket_of(F.col("file_name")))
            store.replace_rows(self.spark, f"{self.path}/parents", PARENTS + ", bucket int", parents, owners, "file_name", "bucket")
        self.index.put(chunks.withColumn("embedding", retrieve.embed(F.col("text"), self.embedder)), owners)
        self.registry.mark(owners)
        self.observed["missing"] = todo.join(present, "file_name", "left_anti").count()
        store.remove(self.spark, judged.kept_in)
        log.info("ingest: %s", self.observed)
        return self.spark.createDataFrame([(s, self.observed[s]) for s in ("success", "failed", "missing") if self.observed[s]], "status string, n long")

    def parents(self) -> DataFrame:
        return store.read_table(self.spark, f"{self.path}/parents", PARENTS)

    def reset(self) -> None:
        """Forget all chunks and what is embedded; reports stay registered."""
        self.registry.reset()
        self.index.drop()
        store.remove(self.spark, f"{self.path}/parents")

    def search(self, questions: DataFrame) -> DataFrame:
        """Passages (query_id, place, rank, score, text, ...) for questions(query_id, question), all in one plan."""
        s = self.settings
        asked = questions.withColumn("embedding", retrieve.embed(F.col("question"), self.embedder, "retrieval_query"))
        columns = [f.name for f in self.index.rows().schema if f.name not in ("embedding", "distance", "cluster")]
        hits = self.index.fetch(self.index.search(asked, s.fetch_k), columns).drop("cluster")
        hits = retrieve.with_parent_text(retrieve.one_per_parent(hits), self.parents())
        if self.scorer:
            return retrieve.top_passages(scored(hits.join(questions, "query_id"), F.col("question"), F.col("text"), self.scorer), s.passages, order=F.col("score").desc_nulls_last()).drop("question")
        if s.rerank:
            return retrieve.rerank(hits.join(questions, "query_id"), F.col("question"), F.col("text"), s.passages).drop("question")
        return retrieve.top_passages(hits, s.passages)

    # ---- threads -----------------------------------------------------------------------------------------------------

    def new_thread(self) -> str:
        """A thread of its own for what is asked next."""
        self.thread = self.threads.new()
        return self.thread

    def switch_thread(self, thread_id: str) -> None:
        self.thread = thread_id

    def clear_thread(self, thread_id: str | None = None) -> None:
        """What is asked next in the thread knows nothing of what was said in it."""
        self.threads.clear(thread_id or self.thread)

    @property
    def history(self) -> DataFrame:
        return self.threads.entries()

    # ---- questions ---------------------------------------------------------------------------------------------------

    def ask(self, question: str, thread_id: str | None = None, sql: str | None = None) -> Answer:
        """Answer from the catalog or from the documents, and from prices where the tool asks for these. sql takes the
        place of a model that writes it."""
        thread_id = thread_id or self.thread
        rewritten = self._rewrite(question, thread_id)
        route = "rdb" if sql else self._route(rewritten)
        out = Answer(route, question, rewritten)
        if route == "rdb":
            self._from_catalog(out, sql)
        else:
            self._from_documents(out)
        name = self.tool(rewritten) if self.tool else None
        if name:
            self._from_prices(out, name)
        turn = self.spark.createDataFrame([(thread_id, question, out.text, out.used_tool)], "thread_id string, question string, answer string, used_tool boolean")
        self.threads.say(turn)
        return out

    def ask_many(self, questions: DataFrame) -> DataFrame:
        """questions(query_id, thread_id, question) with rewritten_query, route, prompt, answer and error, in one plan.

        The model runs in the workers: it rewrites where a thread has a history, chooses the route, and answers questions
        for the documents from their passages. For those of the catalog the answer is the statement that the model
        writes, which ask(question, sql=answer) runs behind the guard. The turns become part of no thread.
        """
        if not self.workers:
            raise ValueError("ask_many needs a model in the workers")
        past = session.history_text(session.last_entries(self.history, self.settings.history_entries))
        asked = questions.select("query_id", "thread_id", "question").join(past, "thread_id", "left")
        known = F.coalesce(F.col("history"), F.lit("")) != ""
        asked = answered(asked, F.when(known, fill(REWRITE, history=F.col("history"), question=F.col("question"))), self.workers, "said")
        asked = asked.withColumn("rewritten_query", F.coalesce(F.nullif(strip(F.col("said")), F.lit("")), "question")).drop("said", "said_error", "history")
        asked = answered(asked, fill(CHOOSE_ROUTE, question=F.col("rewritten_query")), self.workers, "said")
        asked = store.kept(asked.withColumn("route", F.when(F.col("said").isNull(), session.FALLBACK_ROUTE).otherwise(session.normal_route(F.col("said")))).drop("said", "said_error"), "routed")
        catalog, rest = session.branches(asked)
        catalog = catalog.withColumn("prompt", fill(WRITE_SQL, question=F.col("rewritten_query")))
        passages = self.search(rest.select("query_id", F.col("rewritten_query").alias("question")))
        rest = rest.join(retrieve.context(passages), "query_id", "left")
        rest = rest.withColumn("prompt", F.when(F.col("context").isNotNull(), fill(ANSWER_FROM_TEXT, context=F.col("context"), question=F.col("rewritten_query")))).drop("context")
        out = answered(catalog.unionByName(rest), F.col("prompt"), self.workers)
        text = F.when(F.col("route") == "rdb", without_fences(F.col("answer"))).when(F.col("prompt").isNull(), NOTHING_FOUND).otherwise(F.col("answer"))
        return out.withColumn("answer", text).withColumnRenamed("answer_error", "error")

    def _from_prices(self, out: Answer, name: str) -> None:
        """The listing is indexed once for an engine; of prices only the ticker's last days are read."""
        out.used_tool = True
        if self._symbols is None or self.prices is None:
            out.price_status, out.text = price_answer(name, None, None)
            return
        if self._names is None:
            self._names = GramIndex.of(self._symbols).save(f"{self.path}/symbols")
        asked = self.spark.createDataFrame([(name,)], "name_asked string")
        code = resolve_tickers(asked, self._symbols, self._names).first().code
        rows = None
        if code is not None:
            own = self.prices.filter(F.col("ticker") == code)
            last = own.agg(F.max("trade_date").cast("string")).first()[0]
            rows = recent_prices(own, last, self.settings.price_days, self.settings.price_rows) if last else own
        out.price_status, out.text = price_answer(name, code, rows)

    def _value(self, column: Column) -> str:
        return self.spark.range(1).select(column.alias("v")).first().v

    def _rewrite(self, question: str, thread_id: str) -> str:
        if not self.model:
            return question
        past = session.history_text(session.last_entries(self.threads.entries(thread_id), self.settings.history_entries)).first()
        if not past:
            return question
        return self.model(self._value(fill(REWRITE, history=F.lit(past.history), question=F.lit(question)))).strip() or question

    def _route(self, question: str) -> str:
        if not self.model:
            return self._value(session.keyword_route(F.lit(question)))
        try:
            said = self.model(self._value(fill(CHOOSE_ROUTE, question=F.lit(question))))
        except Exception:
            log.warning("no route; the documents are searched", exc_info=True)
            return session.FALLBACK_ROUTE
        return self._value(session.normal_route(F.lit(said)))

    def _from_catalog(self, out: Answer, sql: str | None) -> None:
        if sql is None and self.model:
            sql = self.model(self._value(fill(WRITE_SQL, question=F.lit(out.rewritten))))
        if sql is None:
            out.rows = self.registry.reports()
            return
        try:
            out.rows = sqlguard.run(self.spark, self._value(without_fences(F.lit(sql))), self.registry.reports())
        except sqlguard.SqlRejected as e:
            out.rejected, out.text = e.rejected, sqlguard.REFUSAL
            return
        rows = out.rows.limit(SHOWN + 1).toPandas()
        shown = rows.head(SHOWN).to_string(index=False) + ("\n(...)" if len(rows) > SHOWN else "")
        out.prompt = self._value(fill(ANSWER_FROM_TABLE, result=F.lit(shown), question=F.lit(out.rewritten)))
        out.text = self.model(out.prompt) if self.model else None

    def _from_documents(self, out: Answer) -> None:
        if not files.exists(self.spark, f"{self.path}/chunks"):
            out.text = NO_INDEX
            return
        questions = self.spark.createDataFrame([(0, out.rewritten)], "query_id long, question string")
        passages = store.kept(self.search(questions), "passages")  # of one question
        found = retrieve.context(passages).first()
        if not found:
            out.text = NOTHING_FOUND
            return
        out.rows, out.hits = passages, retrieve.hit_report(passages)
        out.prompt = self._value(fill(ANSWER_FROM_TEXT, context=F.lit(found.context), question=F.lit(out.rewritten)))
        out.text = self.model(out.prompt) if self.model else None
