"""Splitting cleaned text into linked chunks."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Settings

SEPARATORS = ("\n\n", "\n", ". ", " ", "")
#: Texts whose chunks a worker holds at once.
ROWS = 256
UNKNOWN_BROKER = "알수없음"


def header_sections(docs: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Sections of a markdown text: keys, section, h1..h3, content. A heading opens a section and stays in its text.

    A heading of a level clears the deeper ones. Blank sections go. Each text is split within its own row in one pass over
    its lines, so rows that share their keys stay apart; keys may have any names.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    rows = docs.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col(text).cast("string").alias("_text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = [list(_sections(t)) if t else [] for t in batch["_text"]]
            out = batch.loc[batch.index.repeat([len(p) for p in parts]), names].reset_index(drop=True)
            yield pd.concat([out, pd.DataFrame([x for p in parts for x in p], columns=["section", "h1", "h2", "h3", "content"])], axis=1)

    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]
    found = rows.mapInPandas(run, ", ".join([*schema, "section long, h1 string, h2 string, h3 string, content string"]))
    return found.select(*[F.col(n).alias(k) for k, n in zip(keys, names, strict=True)], "section", "h1", "h2", "h3", "content")


HEADING = re.compile("(#{1,3}) +([^\n\r\x85\u2028\u2029]*)[\r\x85\u2028\u2029]?")


def _sections(text: str) -> Iterator[tuple[int, str | None, str | None, str | None, str]]:
    """(section, h1, h2, h3, content) of a text, in one pass over its lines."""
    path: list[str | None] = [None, None, None]
    section, held = 0, []
    for line in text.split("\n"):
        found = HEADING.fullmatch(line)
        if found:
            if "".join(held).strip(" "):
                yield section, *path, "\n".join(held)
            section, held = section + 1, []
            level = len(found[1])
            path = [*path[: level - 1], found[2].strip(" "), *[None] * (3 - level)]
        held.append(line)
    if "".join(held).strip(" "):
        yield section, *path, "\n".join(held)


def fixed_windows(text: Column, size: int, overlap: int) -> Column:
    """Windows of `size` characters, each `size - overlap` after the one before, up to the first that reaches the end."""
    step = size - overlap
    last = F.greatest(F.ceil((F.length(text) - size) / F.lit(step)), F.lit(0)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(text, i * step + 1, F.lit(size)))


def split_recursively(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of at most `size` characters, in order, each a trimmed substring of the text.

    The text is cut before the first separator that it holds; only pieces that are too long are cut by the next ones.
    Neighbours are joined while they fit, what is trimmed at a chunk's ends not counted, and a chunk begins with the
    last whole pieces of the one before it that together have at most `overlap` characters. No character but white space
    is lost.
    """
    out: list[str] = []
    held: list[str] = []
    for piece in _pieces(text, size, separators):
        if held and len("".join([*held, piece]).strip()) > size:
            out.append("".join(held))
            while held and (len("".join(held).strip()) > overlap or len("".join([*held, piece]).strip()) > size):
                held.pop(0)
        held.append(piece)
    out.append("".join(held))
    return [c for c in (x.strip() for x in out) if c]


def _pieces(text: str, size: int, separators: tuple[str, ...]) -> list[str]:
    at = next((i for i, s in enumerate(separators) if s == "" or s in text), None)
    if at is None or separators[at] == "":
        return [text[i : i + size] for i in range(0, len(text), size)] if len(text) > size else [text] if text else []
    s = separators[at]
    first, *others = text.split(s)
    out = []
    for p in [first, *(s + o for o in others)]:
        if len(p.strip()) > size:
            out += _pieces(p, size, separators[at + 1 :])
        elif p:
            out.append(p)
    return out


def recursive_chunks(df: DataFrame, text: str, size: int, overlap: int, index: str = "chunk_index", out: str = "chunk") -> DataFrame:
    """The other columns of df with a row for each chunk of its text column, numbered from 0.

    Arrow batches go to Python once; the text itself doesn't come back with every chunk of it.
    """
    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != text]
    return df.mapInArrow(chunks_of_batches(text, size, overlap, index, out), ", ".join([*schema, f"{index} int, {out} string"]))


def chunks_of_batches(text: str, size: int, overlap: int, index: str, out: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """recursive_chunks in a worker, which holds the chunks of ROWS texts at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [c for c in batch.schema.names if c != text]
            for lo in range(0, batch.num_rows, ROWS):
                rows = batch.slice(lo, ROWS)
                texts = rows.column(text)
                parts = [split_recursively(t, size, overlap) if t else [] for t in texts.to_pylist()]
                at = pa.array([i for i, p in enumerate(parts) for _ in p], pa.int64())
                numbers, found = pa.array([i for p in parts for i in range(len(p))], pa.int32()), pa.array([c for p in parts for c in p], texts.type)
                yield pa.RecordBatch.from_arrays([*(rows.column(c).take(at) for c in columns), numbers, found], names=[*columns, index, out])

    return run


def chunk_id(*parts: Column) -> Column:
    """A key that a repeated run gives again, so that appending is idempotent."""
    return F.sha2(F.concat_ws("\u0001", *[p.cast("string") for p in parts]), 256)


def context_prefix(target: Column, title: Column) -> Column:
    return F.concat(F.lit("[기업: "), target, F.lit(", 제목: "), title, F.lit("]\n"))


def chunk_reports(sections: DataFrame, settings: Settings = Settings()) -> tuple[DataFrame | None, DataFrame]:
    """Parents (None in flat mode) and chunks of sections(file_name, target_name, title, report_date, broker, section, h1, h2, h3, content)."""
    s = settings
    meta = ("file_name", "target_name", "title", "report_date", "broker")
    sections = sections.withColumn("broker", F.coalesce("broker", F.lit(UNKNOWN_BROKER)))
    keep = (*meta, "section", "h1", "h2", "h3")
    size = s.parent_size if s.parent_child else s.flat_size
    first = recursive_chunks(sections.select(*keep, "content"), "content", size, int(size * s.overlap), "part", "piece")
    order = F.struct("section", "part")
    nth = F.row_number().over(Window.partitionBy("file_name").orderBy(order)) - 1
    if not s.parent_child:
        flat = first.withColumn("child_index", nth)
        return None, _chunks(flat.withColumn("parent_id", F.lit(None).cast("string")), "piece")
    parents = first.withColumn("parent_index", nth).withColumn("parent_id", chunk_id(F.col("file_name"), F.col("parent_index")))
    children = recursive_chunks(parents, "piece", s.child_size, int(s.child_size * s.overlap), "child_index", "child")
    metadata = F.to_json(F.struct("parent_id", *meta, F.struct("h1", "h2", "h3").alias("headers")))
    stored = parents.select("parent_id", "parent_index", F.col("piece").alias("content"), "file_name", metadata.alias("metadata"))
    return stored, _chunks(children, "child")


def _chunks(df: DataFrame, text: str) -> DataFrame:
    key = chunk_id(F.coalesce("parent_id", "file_name"), F.col("child_index"))
    return df.select(
        key.alias("chunk_id"), "parent_id", "child_index", "file_name", "target_name", "title", "report_date", "broker", "h1", "h2", "h3",
        F.concat(context_prefix(F.col("target_name"), F.col("title")), F.col(text)).alias("text"),
    )
