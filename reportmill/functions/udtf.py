"""The recursive splitter as table functions for SQL.

    SELECT d.doc_id, c.* FROM documents d, LATERAL split_text(d.text, 2000, 200) c
    SELECT * FROM split_table(TABLE(documents), 'text', 2000, 200)
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..operators.chunk import split_recursively

CHUNK = "chunk_index int, chunk string"


@udtf(returnType=CHUNK)
class SplitText:
    """A row for each chunk of a text; none for null or an empty one."""

    def eval(self, text: str, size: int, overlap: int) -> Iterator[tuple]:
        yield from enumerate(split_recursively(text, size, overlap) if text else ())


@udtf
class SplitTable:
    """The table's other columns and a row for each chunk of the column that is named. The table may be partitioned, or not."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, column: AnalyzeArgument, size: AnalyzeArgument, overlap: AnalyzeArgument) -> AnalyzeResult:
        if column.value not in rows.dataType.fieldNames():
            raise ValueError(f"the table has no column {column.value}")
        if clash := {"chunk_index", "chunk"} & set(rows.dataType.fieldNames()):
            raise ValueError(f"the table has {sorted(clash)} already")
        return AnalyzeResult(StructType([f for f in rows.dataType.fields if f.name != column.value]).add("chunk_index", IntegerType()).add("chunk", StringType()))

    def eval(self, rows: Row, column: str, size: int, overlap: int) -> Iterator[tuple]:
        text = rows[column]
        others = [rows[c] for c in rows.__fields__ if c != column]
        for i, chunk in enumerate(split_recursively(text, size, overlap) if text else ()):
            yield (*others, i, chunk)


def register(spark: SparkSession) -> None:
    """split_text and split_table for the session's SQL."""
    spark.udtf.register("split_text", SplitText)
    spark.udtf.register("split_table", SplitTable)
