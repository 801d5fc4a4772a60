"""Conversations that last: their entries in a table by thread, read for the last few and never carried in a plan."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import HISTORY
from ..sources.store import kept, read_table, remove
from . import session

#: The role of the entry that ends what came before it in a thread.
CLEARED = "cleared"


class Threads:
    """The conversations under path. A call's plan is as large for the thousandth turn as for the first."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _all(self) -> DataFrame:
        return read_table(self.spark, self.path, HISTORY)

    def new(self) -> str:
        """The id of a thread without entries."""
        return uuid.uuid4().hex

    def entries(self, thread_id: str | None = None) -> DataFrame:
        """thread_id, seq, role, text of one thread or of all, since they were cleared last."""
        rows = self._all()
        rows = rows if thread_id is None else rows.filter(F.col("thread_id") == thread_id)
        ends = rows.filter(F.col("role") == CLEARED).groupBy("thread_id").agg(F.max("seq").alias("_end"))
        left = rows.join(ends, "thread_id", "left").filter(F.col("_end").isNull() | (F.col("seq") > F.col("_end")))
        return left.select("thread_id", "seq", "role", "text")

    def say(self, turns: DataFrame, tools: bool = False) -> None:
        """Append a question and an answer for each of turns(thread_id, question, answer, used_tool), of many threads at once."""
        upto = self._all().join(turns.select("thread_id").distinct(), "thread_id", "left_semi").groupBy("thread_id").agg(F.max("seq").alias("_last"))
        self._append(session.next_entries(upto, turns, tools=tools))

    def clear(self, thread_id: str) -> None:
        """The thread goes on without what was said so far."""
        last = self._all().filter(F.col("thread_id") == thread_id).agg((F.coalesce(F.max("seq"), F.lit(-1)) + 1).alias("seq"))
        self._append(last.select(F.lit(thread_id).alias("thread_id"), "seq", F.lit(CLEARED).alias("role"), F.lit(None).cast("string").alias("text")))

    def _append(self, entries: DataFrame) -> None:
        entries.select("thread_id", F.col("seq").cast("long").alias("seq"), "role", "text").coalesce(1).write.mode("append").parquet(self.path)

    def names(self, asks: str = "사용자", size: int = 15) -> DataFrame:
        """thread_id, name of the threads that can be switched to."""
        return session.thread_names(self.entries(), asks, size)

    def compact(self) -> None:
        """The many small files of single turns as few; entries before a clearing go."""
        held = kept(self.entries(), "threads")
        held.repartition("thread_id").sortWithinPartitions("thread_id", "seq").write.mode("overwrite").parquet(self.path)
        remove(self.spark, held.kept_in)
