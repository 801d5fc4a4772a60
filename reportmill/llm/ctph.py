"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash of the last seven bytes ends a chunk wherever its low bits are all set, so boundaries move with the text.
Each chunk gives one of 64 characters; a signature has 64 at most. A fingerprint has the block size, the signature at
that size and at twice that size. Fingerprints of equal or neighbouring block sizes compare by edit distance.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, mix, order_key, partitions, prefix_sums, slices, span_hash

LETTERS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
MOST, WINDOW, RUN = 64, 7, 4
OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def block_sizes(n: np.ndarray) -> np.ndarray:
    """The smallest power of two, 4 at least, of which fifty make up the text."""
    return 1 << np.maximum(2, np.ceil(np.log2(np.maximum(n, 1) / 50)).astype(np.int64))


def signatures(c: np.ndarray, offsets: np.ndarray, cut: np.ndarray) -> list[bytes]:
    """A letter a chunk, for the chunks of each row that end before the cuts, and its rest."""
    n = len(offsets) - 1
    row = np.searchsorted(offsets, cut, "left") - 1  # a cut at a row's end belongs to it
    nth = np.arange(len(cut)) - np.searchsorted(row, row)
    cut, row = cut[nth < MOST - 1], row[nth < MOST - 1]
    filled = np.flatnonzero(np.diff(offsets) > 0)
    ends = np.unique(np.concatenate([cut, offsets[1:][filled]]))
    starts = np.concatenate([offsets[:1], ends[:-1]]) if len(ends) else ends
    letters = LETTERS[(mix(span_hash(c, starts, ends)) >> U64(58)).astype(np.int64)].tobytes()
    at = np.searchsorted(ends, offsets, "right")
    return [letters[at[i] : at[i + 1]] for i in range(n)]


def fingerprints(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[bytes], list[bytes]]:
    """Block size and both signatures of each row of bytes."""
    size = block_sizes(np.diff(offsets))
    h = np.zeros(len(data), np.uint32)
    for j in range(WINDOW):
        h[j:] += data[: max(0, len(data) - j)].astype(np.uint32) * np.uint32(pow(0x01000193, j + 1, 1 << 32))
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(12)
    mask = np.repeat((size - 1).astype(np.uint32), np.diff(offsets))
    cut = np.flatnonzero((h & mask) == mask)
    row = np.searchsorted(offsets, cut, "right") - 1
    cut = cut[cut - offsets[row] >= WINDOW - 1]
    twice = cut[(h[cut] & (2 * mask[cut] + 1)) == 2 * mask[cut] + 1]
    c = prefix_sums(data.astype(U64) + U64(1))
    return size, signatures(c, offsets, cut + 1), signatures(c, offsets, twice + 1)


def padded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    n = np.array([len(t) for t in texts], np.int64)
    out = np.full((len(texts), MOST), 255, np.uint8)
    if n.sum():
        code = np.full(256, 255, np.uint8)
        code[LETTERS] = np.arange(64)
        out[np.arange(MOST) < n[:, None]] = code[np.frombuffer(b"".join(texts), np.uint8)]
    return out, n


def likeness(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """1 - edit distance / longer length for pairs of signatures; 0 for long ones without a common run of RUN letters.

    Myers' bit-parallel edit distance, a column of all pairs at a time.
    """
    (x, n), (y, m) = padded(a), padded(b)
    rows, one = np.arange(len(a)), U64(1)
    match = np.zeros((len(a), 256), U64)
    for i in range(MOST):
        match[rows, x[:, i]] |= one << U64(i)
    match[:, 255] = 0
    top = np.maximum(n - 1, 0).astype(U64)
    pv, mv, score = np.full(len(a), ~U64(0)), np.zeros(len(a), U64), n.copy()
    for j in range(int(m.max(initial=0))):
        eq = match[rows, y[:, j]]
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv), pv & xh
        on = m > j
        score += np.where(on, ((ph >> top) & one).astype(np.int64) - ((mh >> top) & one).astype(np.int64), 0)
        ph, mh = (ph << one) | one, mh << one
        pv, mv = mh | ~(xv | ph), ph & xv
    score = np.where(n == 0, m, score)
    out = 1 - score / np.maximum(np.maximum(n, m), 1)
    grams = [sum(t[:, i : MOST - RUN + 1 + i].astype(np.int64) << (6 * i) for i in range(RUN)) for t in (x, y)]
    inside = [np.arange(MOST - RUN + 1) <= (k - RUN)[:, None] for k in (n, m)]
    left, right = np.where(inside[0], grams[0], -1), np.where(inside[1], grams[1], -2)
    common = np.zeros(len(a), bool)
    for i in range(MOST - RUN + 1):
        common |= (left[:, i : i + 1] == right).any(axis=1)
    return np.where(common | (np.minimum(n, m) < 2 * RUN), out, 0.0)


def compare(a: tuple, b: tuple) -> np.ndarray:
    """The likeness of fingerprints row by row, at compatible block sizes."""
    (s, a1, a2), (t, b1, b2) = a, b
    out = np.zeros(len(s))
    for which, left, right in ((s == t, a1, b1), (s == t, a2, b2), (s == 2 * t, a1, b2), (t == 2 * s, a2, b1)):
        at = np.flatnonzero(which)
        if len(at):
            out[at] = np.maximum(out[at], likeness([left[i] for i in at], [right[i] for i in at]))
    return out


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def shown(f: tuple) -> list[str]:
    return [f"{s}:{a.decode()}:{b.decode()}" for s, a, b in zip(*f, strict=True)]


def with_next(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, text, bucket, tail) in ascending order within buckets of a range of ids; the last row of a bucket
    is the first of the next one (after the last: the first of all) with tail set, so any row's successor follows it."""
    parts = partitions(docs.sparkSession)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    d = d.withColumn("ord", order_key(F.col("doc_id"), F.col("text")))
    edges = sorted(set(d.stat.approxQuantile("ord", [i / parts for i in range(1, parts)], 0.2 / parts))) if parts > 1 else []
    upto = F.size(F.filter(F.lit(edges), lambda e: e <= F.col("ord").cast("double"))) if edges else F.lit(0)
    d = d.withColumn("bucket", upto.cast("int"))
    first = sorted((r.bucket, r.ord) for r in d.groupBy("bucket").agg(F.min("ord").alias("ord")).collect())  # one row a bucket
    if not first:
        return d.withColumn("tail", F.lit(0))
    before = {first[i][0]: first[i - 1][0] for i in range(len(first))}
    heads = d.filter(F.col("ord").isin([o for _, o in first])).groupBy("bucket", "ord").agg(F.min("text").alias("text"))
    back = F.element_at(F.create_map(*[F.lit(x) for kv in before.items() for x in kv]), F.col("bucket"))
    heads = heads.select(F.lit(None).cast("long").alias("doc_id"), "text", "ord", back.alias("bucket"), F.lit(1).alias("tail"))
    both = d.withColumn("tail", F.lit(0)).unionByName(heads)
    return both.repartitionById(max(b for b, _ in first) + 1, "bucket").sortWithinPartitions("bucket", "tail", "ord", "text")


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Per row of docs(doc_id, text): its fingerprint, that of its edited text, and its likeness to it and to the next row.

    The edited text has its last floor(n/2) code points replaced by the first as many (or all) of the next document in
    ascending order of doc_id; after the last comes the first. Rows that share a doc_id go by their text, rows without
    one come last, by a hash of their text. A null text is empty. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple] = []
        for batch in slices(batches, 1, 2 << 20):
            rows = kept + list(zip(*(batch.column(i).to_pylist() for i in (0, 1, 4)), strict=True))
            kept = rows[-1:]
            yield from report(rows)

    def report(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        own = fingerprints(*joined([t.encode() for _, t, _ in rows]))
        at = [i for i in range(len(rows) - 1) if not rows[i][2]]
        if not at:
            return
        edited = []
        for i in at:
            half = len(rows[i][1]) // 2
            edited.append((rows[i][1][: len(rows[i][1]) - half] + rows[i + 1][1][:half]).encode())
        pick = lambda n: (own[0][n], [own[1][i] for i in n], [own[2][i] for i in n])
        mine, after, new = pick(at), pick([i + 1 for i in at]), fingerprints(*joined(edited))
        yield pa.record_batch(
            [
                pa.array([rows[i][0] for i in at], pa.int64()), pa.array([len(rows[i][1]) for i in at], pa.int64()), pa.array([hashlib.sha256(e).hexdigest() for e in edited]),
                pa.array(shown(mine)), pa.array(shown(new)), pa.array(compare(mine, new)), pa.array(compare(mine, after)),
            ],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    return with_next(docs).select("doc_id", "text", "ord", "bucket", "tail").mapInArrow(run, OUT)
