"""Exact top-k search with vector-approximation files.

The approximation file holds a byte a component: the cell of each component, as wide a power of two as the vector's
largest component asks for. Its exact vectors lie beside it in a column that the scan doesn't read. Blocks of queries
scan groups of cells for an upper bound of every score; the vectors with the highest bounds of all groups are then read
exactly, in the order of bounds and ids. A query is done when its k-th score is beyond the bound of the first vector
left; the others scan again for four times as many.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, written

#: Bits of a cell number, with its sign; components that are quantised at once; queries that are scanned at once.
BITS, CHUNK, ASKED = 8, 1 << 22, 64
CELLS = "vec_id long, dim int, shift int, cells binary, whole binary"
BOUNDS = "query long, vec_id long, row long, bound double"
SCORES = "query long, query_id long, vec_id long, score long"


def usable(vector: Column) -> Column:
    """No null and no component that is null or not finite."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))


def cells(whole: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cell numbers of vectors that lie end to end, each of its size, and the bits that each vector's cells leave out."""
    magnitude = np.append(np.maximum(whole, ~whole), 0)
    first = np.cumsum(size) - size
    largest = np.where(size > 0, np.maximum.reduceat(magnitude, first) if len(size) else magnitude[:0], 0)
    shift = np.maximum(np.frexp(largest.astype(np.float64))[1] - (BITS - 1), 0).astype(np.int64)
    return (whole >> np.repeat(shift, size)).astype(np.int8), shift


def quantised(scale: float):
    """Rows (vec_id, embedding) to CELLS; whole holds the components of floor(scale * x) as longs."""

    def binary(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
        ends = (offsets * values.itemsize).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(values))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(1).cast(pa.large_list(pa.float64()))
            sizes = np.diff(vectors.offsets.to_numpy())
            part = (np.cumsum(sizes) - sizes) // CHUNK
            for at in np.split(np.arange(batch.num_rows), np.flatnonzero(np.diff(part)) + 1):
                if not len(at):
                    continue
                scaled = np.floor(vectors.slice(at[0], len(at)).flatten().to_numpy(zero_copy_only=False) * scale)
                if (np.abs(scaled) >= 2.0**62).any():
                    raise OverflowError("a scaled component is beyond a long")
                whole, size = scaled.astype(np.int64), sizes[at]
                cell, shift = cells(whole, size)
                offsets = np.append(0, np.cumsum(size))
                columns = [batch.column(0).slice(at[0], len(at)), pa.array(size, pa.int32()), pa.array(shift, pa.int32()), binary(cell, offsets), binary(whole, offsets)]
                yield pa.record_batch(columns, ["vec_id", "dim", "shift", "cells", "whole"])

    return run


def matrix(column: pa.Array | pa.ChunkedArray, dim: int, dtype: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), dim)


def bounds(queries: np.ndarray, cell: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """An upper bound of each score (query, vector) from the cells of the vectors alone, as a whole number.

    It is the score itself where cells are of width one, unless numbers are beyond a double's.
    """
    width = np.exp2(shift.astype(np.float64)) - 1
    middle = cell * (width + 1)[:, None] + width[:, None] / 2
    q = queries.astype(np.float64)
    rounding = np.abs(middle).max(axis=1, initial=0) * (cell.shape[1] + 64) * 2.0**-50
    return np.floor(q @ middle.T + np.abs(q).sum(axis=1)[:, None] * (width / 2 + rounding) + 0.25)


def scan(m: int):
    """The m vectors of a group with the highest bounds for each query of a block, of equal bounds those of smaller ids."""

    def run(q: pa.Table, c: pa.Table) -> pa.Table:
        out: list[list] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
        if q.num_rows and c.num_rows:
            c = c.sort_by("vec_id")
            dim = c.column("dim")[0].as_py()
            cell, shift = matrix(c.column("cells"), dim, "i1"), c.column("shift").to_numpy()
            ids, row = c.column("vec_id").to_numpy(), c.column("row").to_numpy()
            asked, query, own = matrix(q.column("asked"), dim, "<i8"), q.column("query").to_numpy(), q.column("query_id").to_numpy()
            for lo in range(0, len(asked), ASKED):
                for i, bound in enumerate(bounds(asked[lo : lo + ASKED], cell, shift), lo):
                    other = ids != own[i]
                    left = bound[other]
                    least = np.partition(left, len(left) - m)[len(left) - m] if m < len(left) else -np.inf
                    above = np.flatnonzero(other & (bound > least))
                    at = np.append(above, np.flatnonzero(other & (bound == least))[: m - len(above)])
                    for column, x in zip(out, (np.full(len(at), query[i]), ids[at], row[at], bound[at]), strict=True):
                        column.append(x)
        return pa.table([np.concatenate(x) for x in out], ["query", "vec_id", "row", "bound"])

    return run


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of x and y; an error where one is beyond a long."""
    if not x.size or float(np.abs(x).max()) * float(np.abs(y).max()) * x.shape[1] < 2.0**62:
        return (x * y).sum(axis=1)
    exact = [sum(a * b for a, b in zip(p, q, strict=True)) for p, q in zip(x.tolist(), y.tolist(), strict=True)]
    if any(not -(1 << 63) <= s < 1 << 63 for s in exact):
        raise OverflowError("a score is beyond a long")
    return np.array(exact, np.int64)


def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (query, query_id, vec_id, dim, asked, whole) to SCORES."""
    for batch in batches:
        score, dims = np.zeros(batch.num_rows, np.int64), batch.column(3).to_numpy()
        for dim in np.unique(dims):
            at = np.flatnonzero(dims == dim)
            asked, whole = (matrix(batch.column(c).take(pa.array(at)), dim, "<i8") for c in (4, 5))
            score[at] = products(whole, asked)
        yield pa.record_batch([*batch.columns[:3], pa.array(score)], ["query", "query_id", "vec_id", "score"])


def approximated(vectors: DataFrame, scale: float) -> DataFrame:
    """Rows of CELLS of the vectors that take part."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return v.filter(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).mapInArrow(quantised(scale), CELLS)


def few_copies(file: DataFrame, k: int) -> DataFrame:
    """The rows that can be among the k best of any query: of equal vectors, k of each id and 2 * k in all, by id.

    A query leaves out one id, so k rows are left to it wherever there were so many.
    """
    each = file.withColumn("n", F.row_number().over(Window.partitionBy("whole", "vec_id").orderBy("vec_id"))).filter(F.col("n") <= k)
    return each.withColumn("n", F.row_number().over(Window.partitionBy("whole").orderBy("vec_id"))).filter(F.col("n") <= 2 * k).drop("n")


def top_k(vectors: DataFrame, every: int = 50, k: int = 5, scale: float = 256.0, block: int = 2048, group: int = 32768, first: int = 4) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of vectors(vec_id, embedding) whose vec_id is divisible by `every`,
    its k highest inner products of floor(scale * x) with the other rows, ties to the smaller vec_id; all, if fewer.

    Rows without vec_id, and vectors that are null or hold a null or not finite component, take no part; nor
    do vectors of another length than the query's. Rows with the query's own vec_id are not its candidates. Repeated
    query rows count once; other repeated rows each count. A scaled component of 2**62 or more, and a score that is no
    long, are errors. An empty table gives no rows; other columns are ignored. A task scans up to some `block` queries
    over some `group` vectors; first * k exact vectors are read for each query at first.
    """
    asked = approximated(vectors.filter(F.col("vec_id").cast("long") % every == 0), scale)
    asked = asked.select(F.col("vec_id").alias("query_id"), "dim", F.col("whole").alias("asked")).distinct()
    open_ = written(asked.withColumn("query", F.monotonically_increasing_id()), "queries")
    file = written(few_copies(approximated(vectors, scale), k).withColumn("row", F.monotonically_increasing_id()), "approximations")
    groups, m = max(1, math.ceil(file.count() / group)), first * k
    rounds: list[DataFrame] = []
    while (n := open_.count()) or not rounds:
        blocks = max(1, math.ceil(n * m / (first * k) / block))
        left = open_.withColumn("b", F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int")).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        right = file.select("row", "vec_id", "dim", "shift", "cells", F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int").alias("g"))
        right = right.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        near = left.groupBy("b", "g", "dim").cogroup(right.groupBy("b", "g", "dim")).applyInArrow(scan(m + 1), BOUNDS)
        order = Window.partitionBy("query").orderBy(F.desc("bound"), "vec_id", "row")
        near = written(near.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= m + 1), "bounds")
        read = near.filter(F.col("n") <= m).join(file.select("row", "whole"), "row").join(open_, "query")
        score = read.select("query", "query_id", "vec_id", "dim", "asked", "whole").mapInArrow(scored, SCORES)
        best = score.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))).filter(F.col("rank") <= k)
        beyond = near.filter(F.col("n") == m + 1).select("query", F.col("bound").alias("next_bound"), F.col("vec_id").alias("next_id"))
        last = (F.col("score") > F.col("next_bound")) | ((F.col("score") == F.col("next_bound")) & (F.col("vec_id") <= F.col("next_id")))
        done = F.max((F.col("rank") == k) & last).over(Window.partitionBy("query"))
        rounds.append(written(best.join(beyond, "query", "left").withColumn("done", F.col("next_bound").isNull() | done), "best"))
        forget(near)
        again = open_.join(rounds[-1].filter(~F.col("done")).select("query").distinct(), "query")
        m *= 4
        if again.isEmpty():
            break
        again = written(again, "queries")
        forget(open_)
        open_ = again
    found = rounds[0]
    for more in rounds[1:]:
        found = found.unionByName(more)
    forget(file, open_)
    return found.filter("done").select("query_id", "rank", "vec_id", "score")


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""
