"""Suffix-array dedup by prefix-free parsing.

Grams whose rolling hash is divisible by a number are triggers: texts are parsed into phrases that end at a trigger, and
what follows a phrase there, as deep as a window, is its continuation in the parse. The dictionary holds each different
phrase with continuation once, the parse where they occur, in corpus order; copies are settled by the parse alone.
Dictionary and parse are dealt out by trigger. In a bucket two arrays are sorted: the phrases' suffixes (as reversed
phrases, so that all phrases that share a suffix of any length are neighbours) and the continuations. A window is a
suffix of a phrase and a beginning of its continuation, so windows are equal where both arrays put them together; the
two ranks give the order of the windows, and the parse gives the corpus order of equal ones, of which the first stays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices
from .repeats import Rule, cover, repeated

OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def sorted_strings(data: np.ndarray, start: np.ndarray, size: np.ndarray, step: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The rank of each string data[start], data[start + step], ... of `size` bytes among all, sorted as deep as `depth`;
    and in that order, how much each shares with the one before (the longest common prefixes of the array)."""
    wide = -(-depth // 8) * 8
    text = np.zeros((len(start), wide), np.uint8)
    for i in range(depth):
        on = np.flatnonzero(size > i)
        text[on, i] = data[start[on] + step * i]
    order = np.lexsort(text.view(">u8").T[::-1])
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    same = text[order][1:] == text[order][:-1]
    common = np.where(same.all(axis=1), wide, same.argmin(axis=1))
    return rank, np.append(-1, common)


def window_ranks(data: np.ndarray, first: np.ndarray, trigger: np.ndarray, window: int) -> np.ndarray:
    """Numbers of the windows of phrases, one phrase after the other, the same for equal ones.

    The phrase that begins at first[i] has its trigger so many bytes on. A window that begins `left` bytes before the
    trigger is a suffix of the phrase and the first window - left bytes from the trigger on; its rank among those with
    the same `left` follows from the two sorted arrays.
    """
    size = np.diff(first)
    n = np.maximum(size - window + 1, 0)
    out, at = np.zeros(n.sum(), np.int64), np.cumsum(n) - n
    if not len(out):
        return out
    middle = first[:-1] + trigger
    suffix, shared = sorted_strings(data, middle - 1, trigger, -1, window)
    after, common = sorted_strings(data, middle, first[1:] - middle, 1, window)
    used = 0
    for left in range(int(trigger.max()) + 1):
        on = np.flatnonzero((trigger >= left) & (trigger - left < n))
        if len(on):
            key = (np.cumsum(shared < left)[suffix[on]] << 32) | np.cumsum(common < window - left)[after[on]]
            different, number = np.unique(key, return_inverse=True)
            out[at[on] + trigger[on] - left] = used + number
            used += len(different)
    return out


def suffix_dedup(docs: DataFrame, window: int = 100, gram: int = 32, texts: bool = True, hot: int = 20_000, modulus: int = 48) -> DataFrame:
    """Per row of docs(doc_id, text): its UTF-8 bytes, those removed and in how many runs, and the remaining bytes.

    A byte goes if it is covered by a `window`-byte string that also starts earlier: in a document with a smaller
    doc_id, or earlier in the same one. A null text is empty; rows without doc_id come after all others; rows that
    repeat a doc_id with the same text have equal results. Other columns are ignored. texts=False leaves kept null.
    """
    rule = Rule("byte", window, min(gram, window), True, window_ranks, hot, modulus)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            gone, (data, offsets, *_) = cover(rule, batch)
            before = np.concatenate([[0], np.cumsum(gone)])
            begins = gone.copy()
            begins[1:] &= ~gone[:-1]
            edge = offsets[:-1][np.diff(offsets) > 0]
            begins[edge] = gone[edge]
            spans = np.concatenate([[0], np.cumsum(begins)])
            kept, at = data[~gone].tobytes(), offsets - before[offsets]
            parts = [kept[a:b] for a, b in zip(at, at[1:], strict=False)]
            columns = [batch.column(0), pa.array(np.diff(offsets)), pa.array(np.diff(before[offsets])), pa.array(np.diff(spans[offsets]))]
            columns += [pa.array([hashlib.sha256(p).hexdigest() for p in parts], pa.string()), pa.array(parts, pa.binary()) if texts else pa.nulls(len(parts), pa.binary())]
            yield pa.record_batch(columns, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return repeated(rule, docs).mapInArrow(run, OUT)
