"""Mixing sources to target weights with hash-threshold histograms.

Sizes are summed by source and hash bucket; the bucket in which a source's running sum passes its budget is found, and
only that bucket is refined, level by level, until the threshold is a single hash. Documents are then taken by
comparing their hash with their source's threshold: nothing is sorted, and a larger budget takes a superset.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, written

BITS, LEVELS = 15, 4
PLAN = "source string, source_size long, target double, copies int, cut long"


def size_in_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def place(doc_id: Column, text: Column) -> Column:
    """A hash of 60 bits of the document's id (of its text where it has none)."""
    key = F.coalesce(doc_id.cast("string"), text, F.lit(""))
    return F.conv(F.substring(F.md5(key), 1, BITS), 16, 10).cast("long")


def targets(sizes: dict[str | None, int], weights: Sequence[int], share: float, most: float) -> dict[str | None, float]:
    """Each source's target: budget by weight, at most `most` times its size, the excess shared again by weight."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full: set = set()
    while True:
        budget = share * sum(sizes.values()) - sum(most * sizes[s] for s in full)
        each = sum(weight[s] for s in names if s not in full)
        out = {s: most * sizes[s] if s in full else max(0.0, budget * weight[s] / each) for s in names}
        above = {s for s in names if s not in full and out[s] > most * sizes[s]}
        if not above:
            return out
        full |= above


def mixing_plan(sized: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row per source of sized(source, size, place): its size and target, how often all its documents are taken,
    and the place below which they are taken once more.

    The driver holds one row per source, as the weights do; everything else stays distributed.
    """
    spark = sized.sparkSession
    sizes = {r.source: r.size or 0 for r in sized.groupBy("source").agg(F.sum("size").alias("size")).collect()}
    goal = targets(sizes, weights, share, most)
    state = {}
    for s, size in sizes.items():
        copies = min(int(goal[s] // size), int(most)) if size else 0
        state[s] = {"copies": copies, "rest": goal[s] - copies * size, "base": 0, "prefix": 0}
    going = {s for s, x in state.items() if sizes[s] and x["rest"] > 0}
    last: dict = {}
    for level in range(LEVELS):
        if not going:
            break
        shift = BITS * (LEVELS - level - 1)
        rows = [(s, float(state[s]["rest"] - state[s]["base"]), state[s]["prefix"]) for s in going]
        now = F.broadcast(spark.createDataFrame(rows, "s string, rest double, prefix long"))  # one row per source
        bucket = F.shiftright("place", shift)
        inside = sized.join(now, F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("place", shift + BITS) == F.col("prefix")))
        histogram = inside.groupBy("s", bucket.alias("bucket")).agg(F.sum("size").alias("size"), F.first("rest").alias("rest"))
        running = Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        passed = histogram.withColumn("upto", F.sum("size").over(running)).filter("upto > rest")
        edge = passed.groupBy("s").agg(F.min_by(F.struct("bucket", "size", "upto"), "bucket").alias("e"))
        for r in edge.collect():
            state[r.s]["base"] += r.e.upto - r.e.size
            state[r.s]["prefix"] = r.e.bucket
            last[r.s] = r.e.size
    plan = []
    for s, x in state.items():
        cut = 0
        if s in going:  # the last hash is in if that comes nearer to the budget
            nearer = x["base"] + last[s] - x["rest"] < x["rest"] - x["base"]
            cut = x["prefix"] + int(nearer)
        plan.append((s, sizes[s], float(goal[s]), x["copies"], cut))
    return spark.createDataFrame(plan, PLAN)


def with_plan(df: DataFrame, plan: DataFrame, hashed: Column) -> DataFrame:
    """df with _size, _target and _copies of its source's plan."""
    plan = plan.select(*(F.col(c).alias(f"_{c}") for c in plan.columns))
    joined = df.join(F.broadcast(plan), df["source"].eqNullSafe(F.col("_source")), "left")  # one row per source
    return joined.withColumn("_times", F.col("_copies") + (hashed < F.col("_cut")).cast("int"))


def mix_sources(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """doc_id, size, source_size, target, taken of each row of docs(doc_id, source, text).

    A size is the number of words, 0 for a null text. Sources go by code point, a null source last. taken is the size
    times 0, 1 or 2 (up to `most`). Rows that repeat a doc_id are taken alike; rows without one go by their text.
    Other columns are ignored; an empty table gives an empty result.
    """
    sized = docs.select("doc_id", F.col("source").cast("string").alias("source"), size_in_words(F.col("text")).alias("size"), place(F.col("doc_id"), F.col("text")).alias("place"))
    sized = written(sized, "sizes")
    out = with_plan(sized, mixing_plan(sized, weights, share, most), F.col("place"))
    return out.select("doc_id", "size", F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("size") * F.col("_times")).alias("taken"))


def mixed(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """The rows of docs that the mix takes, as often as it takes them, with the columns of docs, whatever their names."""
    hashed = place(F.col("doc_id"), F.col("text"))
    sized = written(docs.select(F.col("source").cast("string").alias("source"), size_in_words(F.col("text")).alias("size"), hashed.alias("place")), "sizes")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("source").cast("string").alias("source"), hashed.alias("place"))
    out = with_plan(rows, mixing_plan(sized, weights, share, most), F.col("place"))
    return out.withColumn("again", F.explode(F.expr("array_repeat(1, _times)"))).select("row.*")


def _words_sql() -> str:
    return "coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)"


SQL = f"""
WITH d AS (SELECT doc_id, source, {_words_sql()}::BIGINT AS size,
                  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, text, '')), 1, 15))::BIGINT AS place FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY source_size / w, source NULLS LAST) AS k FROM w),
l AS (SELECT *, 1.5::DOUBLE * sum(source_size) OVER () - 2.0::DOUBLE * coalesce(sum(source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS budget,
        sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws FROM o),
c AS (SELECT min(k) AS k FROM l WHERE budget * w / ws <= 2.0 * source_size),
b AS (SELECT budget, ws FROM l WHERE k = (SELECT k FROM c)),
t AS (SELECT l.source, l.source_size,
             CASE WHEN l.k < coalesce((SELECT k FROM c), 1e9) THEN 2.0::DOUBLE * l.source_size ELSE greatest(0, (SELECT budget FROM b) * l.w / (SELECT ws FROM b)) END AS target FROM l),
r AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE least(2, floor(target / source_size)) END AS copies FROM t),
p AS (SELECT d.*, r.source_size, r.target, r.copies, r.target - r.copies * r.source_size AS rest,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY d.place RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
             sum(d.size) OVER (PARTITION BY d.source, d.place) AS here
      FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target,
       (size * (copies + CASE WHEN rest > 0 AND (upto <= rest OR (upto - here <= rest AND upto - rest < rest - (upto - here))) THEN 1 ELSE 0 END))::BIGINT AS taken FROM p
"""
