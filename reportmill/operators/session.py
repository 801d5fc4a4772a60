"""Conversations: history, threads, routes."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip

ROUTES = ("rdb", "vectordb", "stock_price")
FALLBACK_ROUTE = "vectordb"
CATALOG_WORDS = ("목록", "개수", "몇 개", "몇 건", "발간일", "제목", "최근 리포트", "how many", "list of", "latest report")


def last_entries(history: DataFrame, n: int = 3, thread: str = "thread_id", seq: str = "seq") -> DataFrame:
    """Each thread's last n entries (a question and its answer are two)."""
    last = Window.partitionBy(thread).orderBy(F.col(seq).desc())
    return history.withColumn("_n", F.row_number().over(last)).filter(F.col("_n") <= n).drop("_n")


def history_text(history: DataFrame, thread: str = "thread_id", seq: str = "seq", role: str = "role", text: str = "text") -> DataFrame:
    """thread, history: [role], line break, text, blank line for each entry in order, trimmed."""
    entry = F.struct(F.col(seq).alias("s"), F.concat(F.lit("["), F.col(role), F.lit("]\n"), F.coalesce(F.col(text), F.lit("")), F.lit("\n\n")).alias("t"))
    texts = F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["t"])
    return history.groupBy(thread).agg(strip(F.array_join(texts, "")).alias("history"))


def thread_names(history: DataFrame, asks: str = "user", size: int = 15, thread: str = "thread_id", seq: str = "seq", role: str = "role", text: str = "text") -> DataFrame:
    """thread, name: the beginning of the thread's first question, and dots."""
    first = F.min_by(text, seq)
    return history.filter(F.col(role) == asks).groupBy(thread).agg(F.concat(first.substr(1, size), F.lit("...")).alias("name"))


def normal_route(route: Column) -> Column:
    r = F.lower(strip(route))
    return F.when(r.isin(*ROUTES), r).otherwise(FALLBACK_ROUTE)


def keyword_route(question: Column) -> Column:
    """An offline stand-in for a classifier: questions about the catalog itself go to it."""
    asked = [F.lower(question).contains(w) for w in CATALOG_WORDS]
    hit = asked[0]
    for a in asked[1:]:
        hit = hit | a
    return F.when(hit, "rdb").otherwise(FALLBACK_ROUTE)


def branches(routed: DataFrame, route: str = "route") -> tuple[DataFrame, DataFrame]:
    """The turns for the catalog, and all others."""
    catalog = F.coalesce(F.col(route) == "rdb", F.lit(False))
    return routed.filter(catalog), routed.filter(~catalog)


def next_entries(upto: DataFrame, turns: DataFrame, ask_role: str = "사용자", answer_role: str = "AI", tools: bool = False) -> DataFrame:
    """thread_id, seq, role, text: a question and an answer for each of turns(thread_id, question, answer, used_tool).

    upto(thread_id, _last) has the last number of each thread with entries. Turns that were answered by a tool are left
    out, unless tools is set.
    """
    kept = turns if tools else turns.filter(~F.coalesce(F.col("used_tool"), F.lit(False)))
    nth = F.row_number().over(Window.partitionBy("thread_id").orderBy("question", "answer"))
    numbered = kept.withColumn("_n", nth).join(upto, "thread_id", "left").withColumn("_at", F.coalesce(F.col("_last"), F.lit(-1)) + 2 * F.col("_n") - 1)
    pair = F.array(
        F.struct(F.col("_at").cast("long").alias("seq"), F.lit(ask_role).alias("role"), F.col("question").alias("text")),
        F.struct((F.col("_at") + 1).cast("long").alias("seq"), F.lit(answer_role).alias("role"), F.col("answer").alias("text")),
    )
    return numbered.select("thread_id", F.explode(pair).alias("e")).select("thread_id", "e.*")


def append(history: DataFrame, turns: DataFrame, ask_role: str = "사용자", answer_role: str = "AI", tools: bool = False) -> DataFrame:
    """history with the entries of turns, once: a conversation that goes on is kept by threads.Threads."""
    upto = history.groupBy("thread_id").agg(F.max("seq").alias("_last"))
    return history.select("thread_id", "seq", "role", "text").unionByName(next_entries(upto, turns, ask_role, answer_role, tools))


def text_of_entries(roles: Iterable[str], texts: Iterable[str | None]) -> str:
    """history_text of one thread's entries, in a worker."""
    return "".join(f"[{r}]\n{t or ''}\n\n" for r, t in zip(roles, texts, strict=True)).strip()


def rewrite(questions: DataFrame, history: DataFrame, rewriter: Callable[[Column, Column], Column] | None = None, n: int = 3) -> DataFrame:
    """questions(thread_id, question) with rewritten_query: the question itself without history, rewriter or its output."""
    texts = history_text(last_entries(history, n))
    joined = questions.join(texts, "thread_id", "left")
    new = rewriter(F.col("question"), F.col("history")) if rewriter else F.lit(None).cast("string")
    new = F.when(F.coalesce(F.col("history"), F.lit("")) != "", F.nullif(strip(new), F.lit("")))
    return joined.withColumn("rewritten_query", F.coalesce(new, "question"))
