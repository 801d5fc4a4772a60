"""The catalog of reports: file names in and out, idempotent registration, and its look-ups."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..functions.text import once, sanitize, shorten
from ..schema import REPORTS


def parse_file_name(name: Column) -> Column:
    """type_date_target_broker_title.pdf as a struct; null unless it has the ending, five parts and a valid date.

    The title keeps further underscores, the date its spelling; report_dt has it as a date.
    """
    parts = F.split(F.regexp_replace(name, r"(?i)\.pdf$", ""), "_", 5)
    part = [F.get(parts, F.lit(i)) for i in range(5)]
    day = F.try_to_date(part[1], "yyyy-M-d")
    ok = F.lower(name).endswith(".pdf") & (F.size(parts) == 5) & part[1].rlike(r"^\d{4}-\d{1,2}-\d{1,2}$") & day.isNotNull()
    return F.when(
        ok,
        F.struct(
            part[0].alias("report_type"), part[1].alias("report_date"), day.alias("report_dt"), part[2].alias("target_name"),
            part[4].alias("title"), part[3].alias("broker"), name.alias("file_name"),
        ),
    )


def build_file_name(report_type: Column, report_date: Column, target: Column, broker: Column, title: Column) -> Column:
    """Parts without forbidden characters and underscores, the title cut to fifty."""
    part = lambda c: F.translate(sanitize(c), "_", "-")
    # a part of a head with more than fifty characters begins as the whole title's does, which is longer still
    begun = once(part(title.substr(1, 200)), lambda h: F.when(F.length(h) > 50, shorten(h)).otherwise(shorten(part(title))))
    return F.concat(F.concat_ws("_", part(report_type), report_date, part(target), part(broker), begun), F.lit(".pdf"))


def report_id(file_name: Column) -> Column:
    return F.sha2(file_name, 256)


def parse_names(names: DataFrame, column: str = "file_name", keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows of REPORTS for the names that parse, and the columns to keep; the others go. Each name is parsed once."""
    one = names.select(*keep, F.explode(F.array(parse_file_name(F.col(column)))).alias("r")).filter("r IS NOT NULL").select(*keep, "r.*")
    return one.select(
        *keep, report_id(F.col("file_name")).alias("report_id"), "report_type", "report_date", "report_dt", "target_name", "title", "broker", "file_name", F.lit(False).alias("is_embedded")
    )


def with_nullable_target(reports: DataFrame) -> DataFrame:
    """Economy reports carry the text null as their target; here it is one."""
    return reports.withColumn("target", F.nullif(F.col("target_name"), F.lit("null")))


def insert_or_ignore(old: DataFrame, new: DataFrame, key: str = "file_name") -> DataFrame:
    """The rows of new that old has no row of that key for, one a key."""
    order = Window.partitionBy(key).orderBy(*new.columns)
    one = new.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")
    return one.join(old.select(key), key, "left_anti").select(*new.columns)


def insert_counts(old: DataFrame, new: DataFrame, key: str = "file_name") -> DataFrame:
    """One row: how many rows of new are inserted and skipped, and how many the table has before and after."""
    before = old.agg(F.count(F.lit(1)).alias("n_before"))
    given = new.agg(F.count(F.lit(1)).alias("given"))
    fresh = new.select(key).join(old.select(key), key, "left_anti").agg(F.count_distinct(key).alias("inserted"))
    out = before.crossJoin(given).crossJoin(fresh)  # one row each
    return out.select("n_before", (F.col("n_before") + F.col("inserted")).alias("n_after"), "inserted", (F.col("given") - F.col("inserted")).alias("skipped"))


def insert_or_replace(batches: DataFrame, key: str, order: str) -> DataFrame:
    """Of rows with one key the one of the latest batch stays."""
    last = Window.partitionBy(key).orderBy(F.col(order).desc(), *[F.col(c).desc() for c in batches.columns if c not in (key, order)])
    return batches.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n")


def mark_embedded(reports: DataFrame, done: DataFrame, key: str = "file_name") -> DataFrame:
    """is_embedded from a log of finished files, which only grows; resetting is emptying the log."""
    log = done.select(F.col(key).alias("_done")).distinct()
    joined = reports.join(log, F.col(key) == F.col("_done"), "left")
    return joined.withColumn("is_embedded", F.col("is_embedded") | F.col("_done").isNotNull()).drop("_done")


def pending(reports: DataFrame, limit: int | None = None) -> DataFrame:
    """Reports that are not embedded: the latest `limit` in order, or all for None or 0, in no order that has to be paid for."""
    out = reports.filter(~F.col("is_embedded"))
    return out.orderBy(F.col("report_date").desc(), "file_name").limit(limit) if limit else out


def unfinished(reports: DataFrame, done: DataFrame, key: str = "file_name") -> DataFrame:
    return reports.join(done, key, "left_anti")


def with_source(reports: DataFrame, files: DataFrame, key: str = "file_name") -> DataFrame:
    return reports.join(files, key, "left_semi")


def by_target(reports: DataFrame, text: str) -> DataFrame:
    """Targets that contain the text, ASCII letters of either case; % and _ in it stay wildcards, a backslash is itself."""
    lower = lambda c: F.translate(c, string.ascii_uppercase, string.ascii_lowercase)
    pattern = "".join(c.lower() if c.isascii() else c for c in text).replace("\\", "\\\\")
    return reports.filter(lower("target_name").like(f"%{pattern}%")).orderBy(F.col("report_date").desc(), "file_name")


def by_dates(reports: DataFrame, start: str, end: str) -> DataFrame:
    """Report dates from start to end, both included, by the calendar."""
    return reports.filter(F.col("report_dt").between(F.lit(start).cast("date"), F.lit(end).cast("date"))).orderBy(F.col("report_dt").desc(), "file_name")


def fetch_all(reports: DataFrame, *order: Column) -> DataFrame:
    return reports.orderBy(*order) if order else reports.orderBy(F.col("report_date").desc(), "file_name")


def brokers_latest(reports: DataFrame) -> DataFrame:
    """Per broker: how many reports and targets, and date and title of the latest."""
    return reports.groupBy("broker").agg(
        F.count(F.lit(1)).alias("n_reports"),
        F.max("report_dt").cast("string").alias("latest_date"),
        F.count_distinct("target_name").alias("n_targets"),
        F.max_by("title", F.struct("report_dt", "file_name")).alias("latest_title"),
    )


def counts_by(reports: DataFrame, *columns: str) -> DataFrame:
    return reports.groupBy(*columns).agg(F.count(F.lit(1)).alias("n_reports"))


class Registry:
    """The catalog as Parquet tables under one folder: reports, and the log of embedded files."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def reports(self) -> DataFrame:
        return mark_embedded(self._read("reports", REPORTS), self._read("embedded", "file_name string"))

    def register(self, names: DataFrame) -> tuple[int, int]:
        """Add the file names that parse and are new; how many were inserted, and how many skipped."""
        old, new = self._read("reports", REPORTS), parse_names(names)
        counts = insert_counts(old, new).first()
        insert_or_ignore(old, new).write.mode("append").parquet(f"{self.path}/reports")
        return counts.inserted, counts.skipped

    def mark(self, done: DataFrame) -> None:
        fresh = insert_or_ignore(self._read("embedded", "file_name string"), done.select("file_name"))
        fresh.write.mode("append").parquet(f"{self.path}/embedded")

    def reset(self) -> None:
        """Forget what is embedded; reports stay."""
        self.spark.createDataFrame([], "file_name string").write.mode("overwrite").parquet(f"{self.path}/embedded")
