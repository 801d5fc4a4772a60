"""Tables that batches are put into: whole partitions replaced by key, and tables that a job keeps for its own steps."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table under path, with the columns of schema; an empty one where nothing has been stored yet."""
    empty = spark.createDataFrame([], schema)
    try:
        return spark.read.schema(schema).parquet(path).select(*empty.columns)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return empty


def bucket_of(key: Column, n: int = 64) -> Column:
    """The partition of a key, the same in every run. n belongs to the table: another n asks for the table to be written anew."""
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


def replace_rows(spark: SparkSession, path: str, schema: str, batch: DataFrame, owners: DataFrame | None, key: str, partition: str) -> list[int]:
    """Put the rows of batch in place of all that the table has for the keys of owners(key); the partitions rewritten.

    The table is partitioned by a column of whole numbers. Only partitions that hold such a key or get a row are written
    again, by dynamic partition overwrite; files of all others stay as they are. Keys in owners without a row in batch
    lose their rows; without owners, the keys are those of the batch. The batch is computed once. A repeated call with the same rows changes nothing but file names.

    Not atomic over partitions: after a failure, calling again completes it.
    """
    staged = kept(batch, "staged")
    old, keys = read_table(spark, path, schema), (staged if owners is None else owners).select(key).distinct()
    number = lambda df: {r[0] for r in df.select(partition).distinct().collect()}  # noqa: E731  at most one a partition
    fresh = number(staged)
    touched = sorted(fresh | number(old.join(keys, key, "left_semi")))
    left = old.filter(F.col(partition).isin(touched)).join(keys, key, "left_anti")
    emptied = set(touched) - fresh - number(left)
    new = left.unionByName(staged.select(*old.columns)).hint("rebalance", partition)
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
    for n in emptied:  # dynamic overwrite leaves a partition alone that gets no row
        remove(spark, f"{path}/{partition}={n}")
    remove(spark, staged.kept_in)
    return touched


def shared_dir(spark: SparkSession, _own: dict = {}) -> str:  # noqa: B006
    """The folder of spark.checkpoint.dir, which driver and executors share; a local session without one gets its own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _own.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="reportmill-"))


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again, so that nothing computes it twice; remove(kept_in) when done."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.kept_in = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
