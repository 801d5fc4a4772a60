"""Substring dedup by factors against indexed blocks of phrases, after Relative Lempel-Ziv parsing.

The corpus itself is the reference. It is cut into phrases at word grams that a hash picks, so that any window of
`window` words lies in one phrase, and a reference block is a bucket of phrases, indexed by trigger. A document's
phrases are looked up in the blocks that could hold them. Phrases that an earlier document has are factors, which grow
phrase by phrase; at a factor's boundaries, the windows of phrases that are not there as a whole are looked up one by
one in the block's index of windows. What factors and windows cover are the duplicate spans. This differs from a greedy
parse in that factors end at phrase ends and all blocks answer at once; the spans that it gives are the same.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import mix, prefix_sums, slices, span_hash
from .repeats import Rule, cover, repeated

OUT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string, spans array<struct<start:int,end:int>>"


def window_index(words: np.ndarray, first: np.ndarray, trigger: np.ndarray, window: int) -> np.ndarray:
    """A block's index: the number of each window of its phrases among the different ones."""
    n = np.maximum(np.diff(first) - window + 1, 0)
    starts = np.arange(n.sum()) + np.repeat(first[:-1] - (np.cumsum(n) - n), n)
    return np.unique(mix(span_hash(prefix_sums(words), starts, starts + window)), return_inverse=True)[1]


def substring_dedup(docs: DataFrame, window: int = 13, gram: int = 5, texts: bool = True, hot: int = 20_000) -> DataFrame:
    """Per row of docs(doc_id, text): its words, those removed, the kept words joined by one space, and the removed spans.

    A word goes if it is covered by `window` consecutive words of its document that also start in a document with a
    smaller doc_id. A null text has no words; rows without doc_id come after all others; rows that share a doc_id are
    one document, none earlier than the other, so repeated rows have equal results. Other columns are ignored.
    texts=False leaves kept and spans null.
    """
    rule = Rule("word", window, min(gram, window), False, window_index, hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            gone, (data, offsets, _, start, end, first) = cover(rule, batch)
            kept = ~gone
            # Bytes that stay: those of kept words, and the separator after each, made a space.
            change = np.zeros(len(data) + 2, np.int32)
            change[start[kept]] += 1
            change[end[kept]] -= 1
            stay = np.cumsum(change)[:-1] > 0
            row = np.repeat(np.arange(len(first) - 1), np.diff(first))
            w = np.flatnonzero(kept)
            more = w[:-1][row[w[1:]] == row[w[:-1]]]
            out = np.append(data, np.uint8(32))
            out[end[more]] = 32
            stay[end[more]] = True
            at = np.concatenate([[0], np.cumsum(stay[: len(data)])])[offsets]
            out = out[:-1][stay[: len(data)]].tobytes()
            removed = np.concatenate([[0], np.cumsum(gone)])[first]
            removed = np.diff(removed)
            parts = [out[a:b] for a, b in zip(at, at[1:], strict=False)]
            columns = [batch.column(0), pa.array(np.diff(first)), pa.array(removed), pa.array([hashlib.sha256(p).hexdigest() for p in parts])]
            if texts:
                flags = np.zeros(len(gone) + 2, np.int8)
                flags[1:-1] = gone
                spans = []
                for r in range(batch.num_rows):
                    f = np.diff(flags[first[r] + 1 : first[r + 1] + 1], prepend=np.int8(0), append=np.int8(0))
                    spans.append([{"start": int(a), "end": int(b)} for a, b in zip(np.flatnonzero(f == 1), np.flatnonzero(f == -1), strict=True)])
                columns += [pa.array([p.decode() for p in parts], pa.string()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]
            else:
                columns += [pa.nulls(batch.num_rows, pa.string()), pa.nulls(batch.num_rows, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]
            yield pa.record_batch(columns, ["doc_id", "n_words", "n_removed", "kept_sha256", "kept", "spans"])

    return repeated(rule, docs).mapInArrow(run, OUT)
