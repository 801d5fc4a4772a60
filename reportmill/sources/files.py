"""Report files, and text out of them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.model import Model

#: From a file's bytes to the texts of its pages.
Extractor = Callable[[bytes], list[str]]
FILES = "path string, modificationTime timestamp, length long"


def report_files(spark: SparkSession, folder: str) -> DataFrame:
    """file_name, path, length of the PDF files of a folder, whatever the case of their ending. No content is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").load(folder)
    return files.select(file_name(F.col("path")).alias("file_name"), "path", "length")


def file_name(path: Column) -> Column:
    """The last part of a file's path, as it was before it became a URL."""
    return F.url_decode(F.replace(F.element_at(F.split(path, "/"), -1), F.lit("+"), F.lit("%2B")))


def plain_pages(content: bytes) -> list[str]:
    """The stand-in extractor: UTF-8 text with form feeds between pages."""
    return content.decode("utf-8").split("\f")


def extract_texts(spark: SparkSession, folder: str, primary: Extractor | Model = plain_pages, fallback: Extractor | Model | None = None, pattern: str = "*.[pP][dD][fF]", only: DataFrame | None = None) -> DataFrame:
    """file_name, text, error of each file: its pages, each followed by a blank line. only(file_name): no other files.

    The fallback is tried where the primary extractor fails and leaves nothing. A file that both fail on, or without
    text, has an error instead of a text. Files go to Python one Arrow batch at a time. An extractor that is costly to
    start, such as a layout model, comes as a Model: each worker starts it once.
    """

    def text_of(content: bytes) -> tuple[str | None, str | None]:
        error = None
        for extractor in [primary, *([fallback] if fallback else [])]:
            try:
                extract = extractor.running() if isinstance(extractor, Model) else extractor
                text = "".join(page + "\n\n" for page in extract(content))
            except Exception as e:
                error = f"{type(e).__name__}: {e}"
                continue
            return (text, None) if text.strip() else (None, "no text")
        return None, error

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [text_of(bytes(c)) for c in batch["content"]]
            yield pd.DataFrame({"file_name": batch["path"], "text": [t for t, _ in found], "error": [e for _, e in found]})

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select(file_name(F.col("path")).alias("path"), "content")
    if only is not None:
        files = files.join(only.select(F.col("file_name").alias("path")), "path", "left_semi")
    return files.mapInPandas(run, "file_name string, text string, error string")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder or file is there, in any file system that Spark reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def stored_size(spark: SparkSession, path: str) -> DataFrame:
    """One row: n_files and n_bytes of a stored table, from the file system's metadata."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.agg(F.count(F.lit(1)).alias("n_files"), F.coalesce(F.sum("length"), F.lit(0)).alias("n_bytes"))


def symbols(spark: SparkSession, path: str) -> DataFrame:
    """The symbol listing (name, code); an empty one where it cannot be read."""
    if not exists(spark, path):
        return spark.createDataFrame([], "name string, code string")
    return spark.read.parquet(path).select("name", "code")

