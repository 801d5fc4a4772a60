"""The state of conversations, kept by a stream of their entries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.session import text_of_entries
from ..sources.store import bucket_of, read_table, replace_rows

ENTRIES = "thread_id long, seq long, role string, text string"
STATE = "thread_id long, n_entries long, last_seq long, history string"
STORED = STATE + ", bucket int"
_HELD = "n long, seqs array<long>, roles array<string>, texts array<string>"


def place(entry: tuple) -> tuple:
    """Entries go by seq, those of one seq by role and text, nulls first."""
    seq, role, text = entry
    return seq, role is not None, role or "", text is not None, text or ""


def combined(n: int):
    """Of each thread in an Arrow batch its last n entries, the first of them with the number of all: however long a thread
    is, no more than that goes on from a batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch.dropna(subset=["thread_id", "seq"])
            if not len(batch):
                continue
            kept = batch.sort_values(["thread_id", "seq", "role", "text"], na_position="first", kind="stable").groupby("thread_id").tail(n).copy()
            counts = batch.groupby("thread_id").size()
            kept["n"] = kept["thread_id"].map(counts).where(~kept["thread_id"].duplicated(), 0)
            yield kept[["thread_id", "seq", "role", "text", "n"]]

    return run


def conversation_states(entries: DataFrame, n: int = 3) -> DataFrame:
    """A stream of STATE from a stream of ENTRIES: a row for each thread with new entries, its number of entries so far, the
    last seq and the text of its last n entries. Entries may come in any order; those without thread or seq don't count."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        total, *held = state.get if state.exists else (0, [], [], [])
        held = list(zip(*held, strict=True))
        for frame in frames:
            seqs, roles, texts, counts = (frame[c].astype(object).where(frame[c].notna(), None).tolist() for c in ("seq", "role", "text", "n"))
            total += sum(counts)
            held = sorted([*held, *zip(map(int, seqs), roles, texts, strict=True)], key=place)[-n:]
        seqs, roles, texts = map(list, zip(*held, strict=True))
        state.update((total, seqs, roles, texts))
        yield pd.DataFrame({"thread_id": [key[0]], "n_entries": [total], "last_seq": [seqs[-1]], "history": [text_of_entries(roles, texts)]})

    few = entries.select("thread_id", "seq", "role", "text").mapInPandas(combined(n), ENTRIES + ", n long")
    return few.groupBy("thread_id").applyInPandasWithState(update, STATE, _HELD, "update", GroupStateTimeout.NoTimeout)


def keep_conversations(entries: DataFrame, path: str, checkpoint: str, n: int = 3, buckets: int = 16) -> StreamingQuery:
    """Bring the table of states under path up to date with all entries that are new, then stop.

    Each batch replaces its threads' rows and writes no other partition; a batch that is repeated after a failure gives
    the same rows. Runs go on where the checkpoint ends.
    """
    spark = entries.sparkSession

    def store(batch: DataFrame, _: int) -> None:
        rows = batch.withColumn("bucket", bucket_of(batch["thread_id"], buckets))
        replace_rows(spark, path, STORED, rows, None, "thread_id", "bucket")

    states = conversation_states(entries, n)
    return states.writeStream.outputMode("update").foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def states_of(spark, path: str) -> DataFrame:
    return read_table(spark, path, STORED).drop("bucket")
