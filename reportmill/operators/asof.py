"""As-of and interval joins as equi-joins: no comparison of times across all rows of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Interval ends and points lie within 2**REACH of 0.
REACH = 40


def asof_join(left: DataFrame, right: DataFrame, on: list[str], left_time: str, right_time: str, columns: list[str], width: int = 30 * 86400, within: int | None = None) -> DataFrame:
    """left with `columns` of the latest row of right that has its key and is no later; null where there is none.

    Times are dates or timestamps; with `within`, a row that is more seconds older does not count. Of right rows with one
    key and time the greatest by `columns` counts. Rows of left all stay, those with a null key or time without a match.
    Columns of right are renamed where left has them already, as right_<name>.

    Only the different (key, time) pairs of left are matched, in slices of `width` seconds, each with the last row of the
    slices before it carried in; so neither a hot key nor very many rows at one time meet in a task.
    """
    slice_of = lambda c: F.floor(F.unix_seconds(F.col(c).cast("timestamp")) / width)
    found = {c: f"right_{c}" if c in left.columns else c for c in columns}
    times = left.select(*on, F.col(left_time).cast("timestamp").alias("_t")).dropna().distinct().withColumn("_slice", slice_of("_t"))
    rows = right.select(*on, F.col(right_time).cast("timestamp").alias("_t"), F.struct(*columns).alias("_v")).dropna(subset=[*on, "_t"])
    rows = rows.groupBy(*on, "_t").agg(F.max("_v").alias("_v")).withColumn("_slice", slice_of("_t"))
    at = F.struct("_t", "_v").alias("_last")
    # what each slice begins with: the last row of the slices before it
    ends = rows.groupBy(*on, "_slice").agg(F.max_by(F.struct("_t", "_v"), "_t").alias("_end"))
    asked = times.select(*on, "_slice").distinct()
    before = Window.partitionBy(*on).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = asked.join(ends, [*on, "_slice"], "full").withColumn("_last", F.last("_end", ignorenulls=True).over(before)).drop("_end")
    begins = slices.filter("_last IS NOT NULL").select(*on, "_slice", F.lit(None).cast("timestamp").alias("_t"), "_last", F.lit(0).alias("_side"))
    both = begins.unionByName(rows.select(*on, "_slice", "_t", at, F.lit(1).alias("_side"))).unionByName(times.select(*on, "_slice", "_t", F.lit(None).cast(begins.schema["_last"].dataType).alias("_last"), F.lit(2).alias("_side")))
    upto = Window.partitionBy(*on, "_slice").orderBy(F.col("_t").asc_nulls_first(), "_side")
    matched = both.withColumn("_last", F.last("_last", ignorenulls=True).over(upto)).filter("_side = 2")
    if within is not None:
        matched = matched.filter(F.unix_seconds("_t") - F.unix_seconds(F.col("_last._t")) <= within)
    matched = matched.select(*on, "_t", *[F.col("_last._v")[c].alias(f"_r_{c}") for c in columns])
    out = left.withColumn("_t", F.col(left_time).cast("timestamp")).join(matched, [*on, "_t"], "left")
    return out.select(*left.columns, *[F.col(f"_r_{c}").alias(n) for c, n in found.items()])


def blocks(start: Column, end: Column) -> Column:
    """The fewest aligned blocks of 2**level whole numbers that together are start..end: array of (level, block)."""

    def step(held: Column, level: Column) -> Column:
        s, e = held["s"], held["e"]
        low = (s <= e) & (s % 2 == 1)
        s = F.when(low, s + 1).otherwise(s)
        high = (s <= e) & (e % 2 == 0)
        block = lambda x: F.struct(level.cast("int").alias("level"), x.alias("block"))
        none = F.array().cast("array<struct<level:int,block:bigint>>")
        taken = F.concat(held["out"], F.when(low, F.array(block(held["s"]))).otherwise(none), F.when(high, F.array(block(e))).otherwise(none))
        e = F.when(high, e - 1).otherwise(e)
        return F.struct(F.when(s <= e, F.shiftright(s, 1)).otherwise(F.lit(1).cast("long")).alias("s"), F.when(s <= e, F.shiftright(e, 1)).otherwise(F.lit(0).cast("long")).alias("e"), taken.alias("out"))

    ok = F.coalesce(start <= end, F.lit(False))
    first = F.struct(
        F.when(ok, biased(start)).otherwise(F.lit(1).cast("long")).alias("s"), F.when(ok, biased(end)).otherwise(F.lit(0).cast("long")).alias("e"), F.array().cast("array<struct<level:int,block:bigint>>").alias("out")
    )
    return F.aggregate(F.sequence(F.lit(0), F.lit(REACH + 1)), first, step)["out"]


def biased(x: Column) -> Column:
    return x.cast("long") + (1 << REACH)


def interval_join(points: DataFrame, intervals: DataFrame, on: list[str], at: Column, start: Column, end: Column) -> DataFrame:
    """Every pair of a point and an interval of its key that holds it, both ends included: the columns of both.

    at, start and end are whole numbers (F.unix_date of dates, F.unix_seconds of timestamps). Each interval is dealt out
    as aligned blocks of a power of two; a point is in one block of each size that occurs, and equal blocks join. Each
    pair comes once. Nulls and intervals that end before they start join nothing; columns other than `on` that both
    sides have are an error.
    """
    if clash := (set(points.columns) & set(intervals.columns)) - set(on):
        raise ValueError(f"both sides have {sorted(clash)}")
    dealt = intervals.withColumn("_b", F.explode(blocks(start, end))).select(*intervals.columns, "_b.level", "_b.block")
    dealt = dealt.withColumnsRenamed({"level": "_level", "block": "_block"})
    sizes = sorted(r[0] for r in dealt.select("_level").distinct().collect())  # at most REACH + 2 numbers
    levels = F.array(*[F.lit(n) for n in sizes]) if sizes else F.array().cast("array<int>")
    asked = points.withColumn("_at", biased(at)).withColumn("_level", F.explode(levels))
    asked = asked.withColumn("_block", F.expr("shiftright(_at, _level)")).drop("_at")
    return asked.join(dealt, [*on, "_level", "_block"]).drop("_level", "_block")

