"""Counts on all levels of several columns, and approximate distinct counts that add up over any days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cube_counts(df: DataFrame, columns: dict[str, Column], **values: Column) -> DataFrame:
    """The aggregates `values` for every subset of the columns, in one pass: a column that a row sums over is null.

    level has a bit for each column, the first one's the highest; it is set where the row sums over the column, which
    tells such a row from one whose column is null itself.
    """
    named = df.withColumns(columns)
    return named.cube(*columns).agg(F.grouping_id().alias("level"), *[v.alias(n) for n, v in values.items()])


def grouping_sets(df: DataFrame, sets: list[tuple[str, ...]], **values: Column) -> DataFrame:
    """The aggregates for each of the given sets of columns only; others are null. level as in cube_counts."""
    columns = list(dict.fromkeys(c for s in sets for c in s))
    return df.groupingSets([[F.col(c) for c in s] for s in sets], *columns).agg(F.grouping_id().alias("level"), *[v.alias(n) for n, v in values.items()])


def distinct_sketches(df: DataFrame, by: list[Column | str], value: str, bits: int = 12) -> DataFrame:
    """A sketch of the different values of each group: 2**bits registers, some kilobytes whatever the group holds.

    Sketches are what is stored: those of several groups merge into that of all their rows, without reading these again.
    A group with null values alone has a sketch of none.
    """
    return df.groupBy(*by).agg(F.hll_sketch_agg(value, F.lit(bits)).alias("sketch"))


def merged_distinct(sketches: DataFrame, by: list[Column | str]) -> DataFrame:
    """n_approx of each group of sketches: the standard error is 1.04 / 2**(bits / 2), 1.6 % with 12 bits."""
    return sketches.groupBy(*by).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n_approx"))


def over_ranges(sketches: DataFrame, ranges: DataFrame, day: str, start: str, end: str) -> DataFrame:
    """n_approx of each of ranges(.., start, end): the sketches of its days merged. Days are as few as a calendar has."""
    days = ranges.withColumn(day, F.explode(F.sequence(start, end)))
    return merged_distinct(days.join(sketches, day), ranges.columns)
