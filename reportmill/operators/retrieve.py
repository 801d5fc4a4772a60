"""Vector search over chunks, and passages from its hits."""

from __future__ import annotations

import zlib
from collections.abc import Callable
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Distances that a task holds at once, and pairs of vectors.
CELLS, PAIRS = 1 << 20, 1 << 15


class Embedder(Protocol):
    def __call__(self, texts: list[str], task: str) -> np.ndarray: ...


class HashingEmbedder:
    """An offline stand-in for a model: hashed word counts of unit length."""

    def __init__(self, size: int = 64):
        self.size = size

    def __call__(self, texts: list[str], task: str) -> np.ndarray:
        out = np.zeros((len(texts), self.size), np.float32)
        for i, text in enumerate(texts):
            for word in (text or "").lower().split():
                h = zlib.crc32(word.encode())
                out[i, h % self.size] += 1 if h >> 31 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def embed(text: Column, embedder: Embedder, task: str = "retrieval_document") -> Column:
    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(list(embedder(texts.tolist(), task)))

    return run(text)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def knn(queries: DataFrame, chunks: DataFrame, k: int = 5, query_id: str = "query_id", chunk_id: str = "chunk_id", vector: str = "embedding", block: int = 4096, group: int = 65_536) -> DataFrame:
    """query_id, chunk_id, score, rank: each query's k nearest chunks by squared distance, ties to the smaller chunk.

    Queries are numbered into blocks and chunks into groups; a task compares a block with a group and gives the k best
    of it for each query (all ties with the last), so what is shuffled on is some k rows a query and group, not the
    product. Neither passes through the driver. Rows without a vector take no part, nor chunks of another length.
    """
    q = queries.select(F.col(query_id).alias("q"), F.col(vector).cast("array<double>").alias("v")).filter("v IS NOT NULL").withColumn("dim", F.size("v"))
    c = chunks.select(F.col(chunk_id).alias("c"), F.col(vector).cast("array<double>").alias("v")).filter("v IS NOT NULL").withColumn("dim", F.size("v"))
    blocks, groups = max(1, -(-q.count() // block)), max(1, -(-c.count() // group))
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = q.withColumn("b", F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int")).withColumn("g", numbers(groups))
    right = c.withColumn("g", F.pmod(F.xxhash64("c"), F.lit(groups)).cast("int")).withColumn("b", numbers(blocks))
    types = f"`{query_id}` {q.schema['q'].dataType.simpleString()}, `{chunk_id}` {c.schema['c'].dataType.simpleString()}, score double"
    found = left.groupBy("b", "g", "dim").cogroup(right.groupBy("b", "g", "dim")).applyInArrow(nearest(k, query_id, chunk_id), types)
    best = Window.partitionBy(query_id).orderBy(F.round("score", 6), chunk_id)
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def nearest(k: int, query_id: str, chunk_id: str) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def matrix(rows: pa.Table) -> np.ndarray:
        flat = rows.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        return flat.reshape(rows.num_rows, -1 if len(flat) else 0)

    def run(queries: pa.Table, chunks: pa.Table) -> pa.Table:
        at, near, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        if queries.num_rows and chunks.num_rows:
            held, v = matrix(queries), matrix(chunks)
            square, own = np.einsum("ij,ij->i", held, held)[:, None], np.einsum("ij,ij->i", v, v)
            n, strip = min(k, len(v)), max(1, CELLS // len(v))
            order = np.empty(len(v), np.int64)  # places of the chunks by their key
            order[pc.sort_indices(chunks.column("c"))] = np.arange(len(v))
            parts = []
            for lo in range(0, len(held), strip):
                some = held[lo : lo + strip]
                about = some @ v.T
                about *= -2
                about += own
                about += square[lo : lo + strip]
                # a margin for rounding, of the sums and of the score: whatever may be among the k best
                edge = np.partition(about, n - 1, axis=1)[:, n - 1 : n] + 2e-6 + 1e-12 * (square[lo : lo + strip] + own.max())
                parts.append([x + [lo, 0, 0][i] for i, x in enumerate(first_of_equal(k, some, v, order, *np.nonzero(about <= edge)))])
            at, near, score = (np.concatenate(x) for x in zip(*parts, strict=True))
        return pa.table({query_id: queries.column("q").take(pa.array(at)), chunk_id: chunks.column("c").take(pa.array(near)), "score": pa.array(score)})

    return run


def first_of_equal(k: int, queries: np.ndarray, v: np.ndarray, order: np.ndarray, at: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(at, near, score) of the candidates (at, near); of a query's with one score only the k first in order."""
    score = np.concatenate([np.zeros(0), *(((queries[at[i : i + PAIRS]] - v[near[i : i + PAIRS]]) ** 2).sum(axis=1) for i in range(0, len(at), PAIRS))])
    by = np.lexsort((order[near], score, at))
    at, near, score = at[by], near[by], score[by]
    place = np.arange(len(at))
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (score[1:] != score[:-1])
    kept = place - np.maximum.accumulate(np.where(new, place, 0)) < k
    return at[kept], near[kept], score[kept]


def one_per_parent(hits: DataFrame, query_id: str = "query_id", parent: str = "parent_id") -> DataFrame:
    """The best hit of each parent; hits without one all stay. Ranks keep their gaps."""
    first = Window.partitionBy(query_id, parent).orderBy("rank")
    return hits.withColumn("_n", F.row_number().over(first)).filter(F.col(parent).isNull() | (F.col("_n") == 1)).drop("_n")


def with_parent_text(hits: DataFrame, parents: DataFrame, text: str = "text", parent: str = "parent_id", content: str = "content") -> DataFrame:
    """The parent's content in place of the chunk's text, where there is such a parent with any."""
    p = parents.select(F.col(parent).alias("_p"), F.nullif(F.col(content), F.lit("")).alias("_content"))
    joined = hits.join(p, F.col(parent) == F.col("_p"), "left")
    return joined.withColumn(text, F.coalesce("_content", text)).drop("_p", "_content")


def top_passages(hits: DataFrame, n: int = 3, query_id: str = "query_id", order: Column | None = None) -> DataFrame:
    """The first n passages of each query, renumbered as place; rank stays."""
    best = Window.partitionBy(query_id).orderBy(*([order] if order is not None else []), "rank")
    return hits.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= n)


def overlap_score(query: Column, text: Column) -> Column:
    """An offline stand-in for a cross-encoder: the share of the query's different words that the text has."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != ""))
    return F.size(F.array_intersect(words(query), words(text))) / F.greatest(F.size(words(query)), F.lit(1))


def rerank(hits: DataFrame, query: Column, text: Column, n: int = 3, scorer: Callable[[Column, Column], Column] = overlap_score, query_id: str = "query_id") -> DataFrame:
    """The n passages of highest score, ties to the better rank; the score replaces the distance."""
    return top_passages(hits.withColumn("score", F.round(scorer(query, text), 6)), n, query_id, F.col("score").desc())


def source_line(place: Column, target: Column, day: Column, title: Column) -> Column:
    return F.concat(
        F.lit("["), place.cast("string"), F.lit("] "), F.coalesce(target, F.lit("알수없음")), F.lit(" ("), F.coalesce(day, F.lit("날짜없음")), F.lit(") - "), F.coalesce(title, F.lit("제목없음"))
    )


def context(passages: DataFrame, query_id: str = "query_id") -> DataFrame:
    """query_id, context: a query's passages(place, text, target_name, report_date, title) in order, each under its source."""
    block = F.concat(
        F.lit("\n--- 문서 "), F.col("place").cast("string"), F.lit(" ---\n[출처: "), source_line(F.col("place"), F.col("target_name"), F.col("report_date"), F.col("title")),
        F.lit("]\n"), F.col("text"), F.lit("\n"),
    )
    texts = F.transform(F.array_sort(F.collect_list(F.struct("place", block.alias("b")))), lambda x: x["b"])
    return passages.groupBy(query_id).agg(F.array_join(texts, "").alias("context"))


def hit_report(passages: DataFrame, query_id: str = "query_id") -> DataFrame:
    dash = lambda c: F.coalesce(c, F.lit("-")).alias(c)
    return passages.select(query_id, F.col("place").alias("rank"), dash("target_name"), dash("report_date"), dash("broker"), dash("file_name"), F.coalesce("score", F.lit(0.0)).alias("score"))
