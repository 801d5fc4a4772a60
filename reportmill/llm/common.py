"""What the operators share: the shared folder, text buffers, 64-bit hashes and packed rows.

Hot spots work on Arrow buffers with numpy inside Spark tasks. Spark plans, partitions and shuffles
everything; a task only ever holds one slice of a batch, or one bucket of a packed shuffle.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
BASE = int(0x9E3779B97F4A7C15)
INVERSE = pow(BASE, -1, 1 << 64)

#: A word is a maximal run without these ASCII separators: space and \x09 to \x0D.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession, _own: dict = {}) -> str:  # noqa: B006
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Where it is unset, a local session gets a folder of its own for its tables. A cluster does not: other machines
    would not see it, so that is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _own:
        _own[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="reportmill-")
    return _own[sc.applicationId]


#: With it Spark removes the shuffle files of an execution as it ends, not when the driver's garbage is next collected.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: it cuts the lineage, and a lost executor loses nothing of it.

    Nothing reads the shuffles of the write after it, so they are removed with it.
    """
    conf, path = df.sparkSession.conf, f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def forget(*tables: DataFrame) -> None:
    """Remove tables of written() that nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def order_key(doc_id: Column, text: Column) -> Column:
    """A long that orders documents by doc_id; those without one follow all others, by a hash of their text."""
    late = F.shiftrightunsigned(F.xxhash64(text), 2).bitwiseOR(F.lit(1 << 62))
    return F.coalesce(doc_id.cast("long"), late)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, in place."""
    h ^= h >> U64(33)
    h *= U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(33)
    h *= U64(0xC4CEB9FE1A85EC53)
    h ^= h >> U64(33)
    return h


def powers(n: int, base: int = BASE, _kept: dict = {}) -> np.ndarray:  # noqa: B006
    """base**0 .. base**(n-1) modulo 2**64."""
    if base not in _kept or len(_kept[base]) < n:
        p = np.full(max(n, 1 << 18), U64(base))
        p[0] = 1
        _kept[base] = np.multiply.accumulate(p)
    return _kept[base][:n]


def prefix_sums(u: np.ndarray) -> np.ndarray:
    """Polynomial prefix hashes: span_hash() takes the hash of any span from them."""
    c = np.zeros(len(u) + 1, U64)
    np.cumsum(u * powers(len(u)), out=c[1:])
    return c


def span_hash(c: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return (c[end] - c[start]) * powers(len(c), INVERSE)[start]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column, end to end, and the offset of each row; null is empty."""
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string()).cast(pa.large_binary())
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list<long> column, end to end, and the offset of each row; a null list is empty."""
    column = column.cast(pa.large_list(pa.int64()))
    if column.null_count:
        column = pa.array([x or [] for x in column.to_pylist()], pa.large_list(pa.int64()))
    offsets = np.concatenate([[0], np.cumsum(np.diff(column.offsets.to_numpy()))]).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), offsets


def slices(batches: Iterator[pa.RecordBatch], column: int, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in record batches whose text column holds about `limit` bytes at most, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.diff(utf8(batch.column(column))[1])
        part = (np.cumsum(size) - size) // limit
        for at in np.split(np.arange(batch.num_rows), np.flatnonzero(np.diff(part)) + 1):
            yield batch.slice(at[0], len(at))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word in the bytes, and the number of the first word of each row (and of none after)."""
    inside = np.ones(len(data) + 2, bool)
    inside[0] = inside[-1] = False
    inside[1:-1] = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    start = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
    end = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
    at = np.searchsorted(start, offsets)
    return start, end, at


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, block: int = 1 << 18) -> np.ndarray:
    """A 64-bit hash of each word."""
    out = np.empty(len(start), U64)
    lo = 0
    while lo < len(start):
        hi = max(lo + 1, int(np.searchsorted(end, start[lo] + block)))
        base = start[lo]
        c = prefix_sums(data[base : end[hi - 1]].astype(U64) + U64(1))
        out[lo:hi] = span_hash(c, start[lo:hi] - base, end[lo:hi] - base)
        lo = hi
    return mix(out)


ROUTED = "route long, kind int, blob binary"


def routed(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    route, kind, blob = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.record_batch([pa.array(route, pa.int64()), pa.array(kind, pa.int32()), pa.array(blob, pa.binary())], ["route", "kind", "blob"])


def dealt(df: DataFrame) -> DataFrame:
    """Rows of ROUTED, those of a route together."""
    return df.repartition(partitions(df.sparkSession), "route").sortWithinPartitions("route")


def by_route(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[int, list[bytes]]]:
    """The blobs of each route by kind, from rows of ROUTED that arrive sorted by route."""
    route, held = None, {}
    for batch in batches:
        for r, kind, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if r != route and held:
                yield held
                held = {}
            route = r
            held.setdefault(kind, []).append(blob)
    if held:
        yield held


def planes(records: np.ndarray) -> bytes:
    """Records byte plane by byte plane, which shuffle compression likes; records() undoes it."""
    return np.ascontiguousarray(records.view(np.uint8).reshape(len(records), -1).T).tobytes()


def records(blob: bytes, dtype: np.dtype) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(dtype.itemsize, -1).T).view(dtype)[:, 0]


def grouped(route: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The different routes, and the places of each."""
    order = np.argsort(route, kind="stable")
    cut = np.flatnonzero(np.diff(route[order])) + 1
    parts = np.split(order, cut) if len(route) else []
    return np.array([route[p[0]] for p in parts], np.int64), parts


def gather(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the spans end to end, and where each ends there."""
    size = (end - start).astype(np.int64)
    ends = np.cumsum(size)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)
    return data[at], ends
