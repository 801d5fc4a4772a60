"""Registering report files as they arrive (an extension: batches are the rule)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.registry import Registry

FILES = "path string, modificationTime timestamp, length long, content binary"


def register_stream(spark: SparkSession, folder: str, registry: Registry, checkpoint: str) -> StreamingQuery:
    """Register all files that are new since the last run, then stop. Restarts and repeated batches insert nothing twice."""
    names = (
        spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", "*.[pP][dD][fF]").load(folder)
        .select(F.url_decode(F.replace(F.element_at(F.split("path", "/"), -1), F.lit("+"), F.lit("%2B"))).alias("file_name"))
    )

    def store(batch: DataFrame, _: int) -> None:
        registry.register(batch)

    return names.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
