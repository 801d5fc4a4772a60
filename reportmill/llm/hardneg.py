"""Hard negatives by distributed radix selection.

Every anchor has a few positives, and each pair of them a window of scores in which its negatives lie. Blocks of anchors
scan groups of vectors; for each window a group counts its scores by their highest digit, from the window's upper end
and only as far as k of them. The sums over all groups show the digit of the k-th score; where too many rows share it,
the scan is repeated inside that digit for the next one. At last only rows at or above the bound found are gathered.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, partitions, written
from .vafile import usable

#: Bits of a digit; anchors whose scores are held at once.
DIGIT, AT_ONCE = 8, 64
FOUND = "anchor long, window int, vec_id long, row long, score long"
COUNTS = "anchor long, window int, digit int, n long"
#: Scaled components are below this.
WIDEST = 2.0**62


def matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def exact_scores(a: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products of whole vectors, exactly; an error where one is beyond a long."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(v).max(initial=0)) * a.shape[1]
    if most < 1 << 53:
        return (a.astype(np.float64) @ v.T.astype(np.float64)).astype(np.int64)
    if most < 1 << 62:
        return a @ v.T
    out = a.astype(object) @ v.T.astype(object)
    if any(not -(1 << 63) <= x < 1 << 63 for x in out.ravel()):
        raise OverflowError("a score is beyond a long")
    return out.astype(np.int64)


def first(score: np.ndarray, ids: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Of the places `at`, those of the k highest scores, ties to the smaller id."""
    if len(at) > k:
        least = np.partition(score[at], len(at) - k)[len(at) - k]
        above, equal = at[score[at] > least], at[score[at] == least]
        equal = equal[np.argpartition(ids[equal], k - len(above) - 1)[: k - len(above)]] if len(equal) > k - len(above) else equal
        at = np.append(above, equal)
    return at


def scan(anchors: DataFrame, rows: DataFrame, n_anchors: int, n_rows: int, group: int, block: int, work: Callable, schema: str) -> DataFrame:
    """What work(anchor, score, ids, labels) yields for each anchor and group of rows, as columns after the anchor's number.

    Each row goes to one group, for every block of anchors; each anchor to one block, for every group. Groups and blocks
    are dealt out by the hash of row numbers, so neither labels nor copies gather anywhere.
    """
    tasks = partitions(rows.sparkSession)
    groups = max(1, math.ceil(n_rows / group), min(tasks, math.ceil(n_rows / 4096)))
    blocks = max(1, math.ceil(n_anchors / block), min(math.ceil(n_anchors / AT_ONCE), tasks // groups))
    names = [x.split()[0] for x in schema.split(", ")]
    types = [{"long": pa.int64(), "int": pa.int32()}[x.split()[1]] for x in schema.split(", ")]

    def run(a: pa.Table, c: pa.Table) -> pa.Table:
        parts: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in names]
        if a.num_rows and c.num_rows:
            c = c.sort_by([("vec_id", "ascending"), ("row", "ascending")])
            dim = c.column("dim")[0].as_py()
            v, ids, labels, row = matrix(c.column("whole"), dim), *(c.column(x).to_numpy() for x in ("vec_id", "label", "row"))
            asked, every = matrix(a.column("whole"), dim), a.drop_columns(["whole"]).to_pylist()
            for lo in range(0, len(asked), AT_ONCE):
                for anchor, score in zip(every[lo : lo + AT_ONCE], exact_scores(asked[lo : lo + AT_ONCE], v), strict=True):
                    for columns in work(anchor, score, ids, labels, row):
                        n = max(len(x) for x in columns if isinstance(x, np.ndarray))
                        for part, x in zip(parts, (anchor["anchor"], *columns), strict=True):
                            part.append(x if isinstance(x, np.ndarray) else np.full(n, x))
        return pa.table([pa.array(np.concatenate(p), t) for p, t in zip(parts, types, strict=True)], names)

    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = anchors.withColumn("b", F.pmod(F.xxhash64("anchor"), F.lit(blocks)).cast("int")).withColumn("g", numbers(groups))
    right = rows.withColumn("g", F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int")).withColumn("b", numbers(blocks))
    return left.groupBy("b", "g", "dim").cogroup(right.groupBy("b", "g", "dim")).applyInArrow(run, schema)


def positives_of(k: int) -> Callable:
    """The k best rows of the anchor's own label in a group."""

    def work(anchor, score, ids, labels, row):
        at = first(score, ids, np.flatnonzero((labels == anchor["label"]) & (ids != anchor["anchor_id"])), k)
        if len(at):
            yield 0, ids[at], row[at], score[at]

    return work


def digits_of(anchor, score, ids, labels, row):
    """The counts of each open window's digits in a group, as far as they can matter."""
    score = score[(labels != anchor["label"]) & (ids != anchor["anchor_id"])]
    for w in anchor["windows"]:
        inside = w["hi"] - score[(score >= w["lo"]) & (score <= w["hi"])]
        if len(inside):
            n = np.bincount(inside >> w["shift"])
            digit = np.flatnonzero(n)
            n = n[digit]
            few = int(np.searchsorted(np.cumsum(n), w["need"])) + 1  # those after the group's own k-th aren't the k-th of all
            yield w["window"], digit[:few], n[:few]


def gathered(k: int) -> Callable:
    """The k best rows of a group in each window."""

    def work(anchor, score, ids, labels, row):
        other = np.flatnonzero((labels != anchor["label"]) & (ids != anchor["anchor_id"]))
        mine = score[other]
        for w in anchor["windows"]:
            at = first(score, ids, other[(mine >= w["lo"]) & (mine <= w["hi"])], k)
            if len(at):
                yield w["window"], ids[at], row[at], score[at]

    return work


def hard_negatives(
    vectors: DataFrame, every: int = 50, positives: int = 5, k: int = 3, low: int = 50, high: int = 95, scale: float = 256.0,
    block: int = 2048, group: int = 32768, gather: int = 16,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of vectors(vec_id, label, embedding).

    Scores are inner products of floor(scale * x), as whole numbers; higher ones come first, ties by the smaller vec_id.
    Anchors are the rows whose vec_id is divisible by `every`; an anchor's positives its first `positives` other rows of
    the same label; a positive's negatives the first k rows of other labels with low% to high% of the positive's score.
    A positive with a score under 0 has no such rows, one of 0 those with 0.

    Rows without vec_id, label or vector, or with a null or not finite component, take no part; vectors meet only those
    of their own length. Rows with the anchor's vec_id are not its others. Repeated anchor rows count once; other
    repeated rows each count. A scaled component of 2**62 or more, and a score that is no long, are errors. An empty
    table gives no rows, and so does one label alone; other columns are ignored. A task holds up to some `group` vectors
    and `block` anchors; digits are refined while more than gather * k rows share the k-th one and those before it.
    """
    v = vectors.select(*[F.col(c).cast(t).alias(c) for c, t in (("vec_id", "long"), ("label", "long"), ("embedding", "array<double>"))])
    v = v.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("embedding")))
    whole = F.transform("embedding", lambda x: F.when(F.abs(x * scale) < WIDEST, F.floor(x * scale)).otherwise(F.raise_error(F.lit("a scaled component is beyond a long")).cast("long")))
    v = v.select("vec_id", "label", whole.alias("whole"), F.size("embedding").alias("dim"))
    rows = written(v.withColumn("row", F.monotonically_increasing_id()), "vectors")
    anchors = rows.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("anchor_id"), "label", "dim", "whole").distinct()
    anchors = written(anchors.withColumn("anchor", F.monotonically_increasing_id()), "anchors")
    sizes = (anchors.count(), rows.count(), group, block)

    best = lambda *of: Window.partitionBy("anchor", *of).orderBy(F.desc("score"), "vec_id", "row")
    near = scan(anchors, rows, *sizes, positives_of(positives), FOUND)
    near = near.withColumn("window", F.row_number().over(best())).filter(F.col("window") <= positives)
    ps = F.col("positive_score")
    part = lambda share: F.expr(f"positive_score div 100 * {share} + (positive_score % 100 * {share}) div 100")  # noqa: E731  floor, without a product beyond a long
    hi, lo = part(high), part(low) + F.when(ps % 100 * low % 100 > 0, 1).otherwise(0)
    windows = near.select("anchor", "window", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")).filter(ps >= 0)
    windows = written(windows.withColumn("hi", hi).withColumn("lo", lo).filter("lo <= hi"), "windows")

    open_, bounds = windows.select("anchor", "window", "lo", "hi", F.lit(k).cast("long").alias("need")), []
    while True:
        # the window's digit: as many of the highest bits of hi - lo as fit
        bits = F.length(F.bin(F.col("hi") - F.col("lo")))
        state = open_.withColumn("shift", F.greatest(bits - DIGIT, F.lit(0)))
        counts = scan(with_windows(anchors, state), rows, *sizes, digits_of, COUNTS).groupBy("anchor", "window", "digit").agg(F.sum("n").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("anchor", "window").orderBy("digit"))
        kth = counts.withColumn("upto", upto).join(state.select("anchor", "window", "need"), ["anchor", "window"])
        kth = kth.filter((F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("n") < F.col("need"))).drop("need")
        step = F.expr("shiftleft(CAST(1 AS BIGINT), shift)")
        upper = F.col("hi") - F.col("digit") * step
        found = state.join(kth, ["anchor", "window"], "left").withColumn("upper", upper).withColumn("lower", F.greatest("lo", upper - step + 1))
        found = found.withColumn("settled", F.col("digit").isNull() | (F.col("shift") == 0) | (F.col("upto") <= gather * k))
        found = written(found, "digits")  # a window without a k-th row takes all that it has
        bounds.append(found)
        rest = found.filter(~F.col("settled")).select("anchor", "window", F.col("lower").alias("lo"), F.col("upper").alias("hi"), (F.col("need") - F.col("upto") + F.col("n")).alias("need"))
        if rest.isEmpty():
            break
        open_ = rest

    settled = [b.filter("settled").select("anchor", "window", F.coalesce("lower", "lo").alias("least")) for b in bounds]
    least = settled[0]
    for more in settled[1:]:
        least = least.unionByName(more)
    last = windows.join(least, ["anchor", "window"]).select("anchor", "window", F.col("least").alias("lo"), "hi")
    out = scan(with_windows(anchors, last), rows, *sizes, gathered(k), FOUND)
    out = out.withColumn("rank", F.row_number().over(best("window"))).filter(F.col("rank") <= k)
    out = out.join(windows.drop("lo", "hi"), ["anchor", "window"]).join(anchors.select("anchor", "anchor_id"), "anchor")
    out = out.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
    out = written(out, "hard-negatives")
    forget(rows, anchors, windows, *bounds)
    return out


def with_windows(anchors: DataFrame, state: DataFrame) -> DataFrame:
    """The anchors that have open windows, with these: as many as an anchor has positives at most."""
    each = state.groupBy("anchor").agg(F.collect_list(F.struct([c for c in state.columns if c != "anchor"])).alias("windows"))
    return anchors.join(each, "anchor")


SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_sum(list_transform(list_zip(a.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM v a JOIN v c ON a.vec_id % 50 = 0 AND c.vec_id <> a.vec_id AND len(a.e) = len(c.e)),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score QUALIFY rank <= 3
"""
