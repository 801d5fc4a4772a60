"""Best-fit packing planned on a histogram of lengths.

Only counts per length reach the driver: at most one number per length up to the sequence length. Best-fit decreasing
runs over these counts and gives groups of equal sequences. Documents then take the planned slots by their rank within
their length, which is found without a sort: the number within a task's pieces of that length plus the counts of the tasks
before it. Pieces and their ids are written once and not shuffled.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, written

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, task int, nth long"
#: Counts by length and task are sent to all tasks up to so many rows, some 24 MB; beyond that they are joined by a shuffle.
SENT = 1 << 20
#: Texts that may be treated differently by two implementations of one vocabulary go to the slower one.
PLAIN = re.compile(r"[\x00-ɏ]*")
_kept: dict = {}


def encoder(tokenizer: str, ranks: str | None):
    """A function from text to ids, as `tokenizers` gives them for the vocabulary file `tokenizer`.

    With `ranks`, the same vocabulary as ranks, plain texts are encoded with tiktoken, some four times faster.
    """
    if (tokenizer, ranks) not in _kept:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        slow = Tokenizer.from_file(tokenizer)
        special = [t.content for t in slow.get_added_tokens_decoder().values()]
        fast = None
        if ranks:
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            fast = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary

        def encode(text: str) -> list[int]:
            if fast and PLAIN.fullmatch(text) and not any(s in text for s in special):
                return fast(text)
            return slow.encode(text, add_special_tokens=False).ids

        _kept[tokenizer, ranks] = encode
    return _kept[tokenizer, ranks]


def token_pieces(docs: DataFrame, size: int, tokenizer: str, ranks: str | None, end: int, ids: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task, used = encoder(tokenizer, ranks), TaskContext.get().partitionId(), [0] * (size + 1)
        for batch in slices(batches, 1):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tokens = np.array([*encode(text or ""), end], "<u4")
                at, piece = 0, 0
                while at < len(tokens):
                    n = (len(tokens) % size or size) if at == 0 else size
                    data = tokens[at : at + n].tobytes()
                    rows.append((doc_id, piece, at, n, zlib.crc32(data), data if ids else None, task, used[n]))
                    used[n] += 1
                    at, piece = at + n, piece + 1
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64())
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids", "task", "nth"]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


def best_fit(counts: dict[int, int], size: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Groups (number of equal sequences, [(length, how many)]) by best-fit decreasing over counts.

    Each step places as many items of one length as fit in the fullest open sequences that have room, a whole group of
    equal sequences at a time, which is what best fit does item by item.
    """
    room: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {size: []}
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            fit = min((r for r, groups in room.items() if r >= length and groups), default=None)
            if fit is None:
                each = size // length
                n, fit, items = max(1, left // each), size, []
                m = n
            else:
                m, items = room[fit].pop()
                each = fit // length
                n = min(m, max(1, left // each))
            take = min(each, left)
            if m > n:
                room[fit].append((m - n, items))
            room.setdefault(fit - take * length, []).append((n, [*items, (length, take)]))
            left -= n * take
    return [g for groups in room.values() for g in groups]


def slots(groups: list[tuple[int, list[tuple[int, int]]]]) -> np.ndarray:
    """Rows (length, first rank, how many a sequence, first sequence, offset), by length and rank."""
    rows, used, sequence = [], {}, 0
    for n, items in groups:
        offset = 0
        for length, each in items:
            rows.append((length, used.get(length, 0), each, sequence, offset))
            used[length] = used.get(length, 0) + n * each
            offset += length * each
        sequence += n
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(docs: DataFrame, tokenizer: str, ranks: str | None = None, size: int = 2048, end: int = 0, ids: bool = True) -> DataFrame:
    """The pieces of docs(doc_id, text) with their sequence_id and offset there.

    A document is its ids and then `end`; a null or empty text is `end` alone. Documents longer than `size` are cut into
    pieces of `size` ids, the first of which may be shorter. ids holds little-endian unsigned 32-bit ids, or null with
    ids=False. Repeated rows and rows without doc_id are packed like any other; an empty table gives an empty result.
    """
    pieces = written(token_pieces(docs, size, tokenizer, ranks, end, ids), "pieces")
    sums = pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    found = sums.groupBy("length").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("tasks")).collect()  # at most `size` rows
    plan = pieces.sparkSession.sparkContext.broadcast(slots(best_fit({r.length: r.n for r in found}, size)))  # grows with `size` alone, not with the rows
    # a piece's rank within its length: its number within its task, and the pieces of the tasks before; no piece moves
    upto = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0))).drop("n")
    before = F.broadcast(before) if sum(r.tasks for r in found) <= SENT else before
    ranked = pieces.join(before, ["length", "task"]).withColumn("rank", F.col("nth") + F.col("before"))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        """Only lengths and ranks go to Python; ids stay where they are."""
        table, length, rank = plan.value, length.to_numpy(np.int64), rank.to_numpy(np.int64)
        at = table[np.searchsorted(table[:, 0] << 44 | table[:, 1], length << 44 | rank, "right") - 1] if len(table) else np.zeros((len(rank), 5), np.int64)
        number, nth = (rank - at[:, 1]) // at[:, 2], (rank - at[:, 1]) % at[:, 2]
        return pd.DataFrame({"sequence_id": at[:, 3] + number, "offset": at[:, 4] + nth * length})

    placed = ranked.withColumn("_p", place("length", "rank"))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "ids", "_p.sequence_id", "_p.offset")
