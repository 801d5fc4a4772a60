"""Report listings: rows out of HTML pages, and which of them a run takes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import short_year_date, strip
from .registry import build_file_name

# Cells that a row needs, and the places of its target, title, broker, link and date, by category.
LAYOUT = (("company", 0, 6, 0, 1, 2, 3, 4), ("industry", 1, 6, 0, 1, 2, 3, 4), ("economy", 2, 5, None, 0, 1, 2, 3))
LAYOUT_SCHEMA = "category string, category_order int, cells int, i_target int, i_title int, i_broker int, i_link int, i_date int"


def pdf_link(html: Column) -> Column:
    """The first link's address that holds .pdf, in either case."""
    return F.nullif(F.regexp_extract(html, r"""(?i)<a\b[^>]*?\bhref\s*=\s*["']([^"']*\.pdf[^"']*)["']""", 1), F.lit(""))


def links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r'<a href="([^"]*)"'), 1)


def plain_text(html: Column) -> Column:
    """Text without tags, the common entities resolved, trimmed."""
    out = F.regexp_replace(html, "<[^>]*>", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return strip(out)


def listing_rows(pages: DataFrame) -> DataFrame:
    """Rows of LISTING out of pages(category, page, html): a row's cells by its category's layout.

    Rows with too few cells, no valid date or no link to a PDF go. pos numbers the rows of a category.
    """
    layout = F.broadcast(pages.sparkSession.createDataFrame(LAYOUT, LAYOUT_SCHEMA))  # three rows
    table = F.regexp_extract("html", r"""(?is)<table[^>]*class=["'][^"']*\btype_1\b[^"']*["'][^>]*>(.*?)</table>""", 1)
    rows = pages.select("category", "page", F.posexplode(F.regexp_extract_all(table, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), 1)).alias("n", "row"))
    cells = F.regexp_extract_all("row", F.lit(r"(?is)<td[^>]*>(.*?)</td>"), 1)
    rows = rows.withColumn("td", cells).join(layout, "category").filter(F.size("td") >= F.col("cells"))
    cell = lambda i: F.get("td", F.col(i))
    return rows.select(
        "category", "category_order", (F.col("page").cast("long") * 100_000 + F.col("n")).alias("pos"), F.col("category").alias("report_type"),
        F.when(F.col("i_target").isNull(), "null").otherwise(plain_text(cell("i_target"))).alias("target_name"),
        plain_text(cell("i_title")).alias("title"), plain_text(cell("i_broker")).alias("broker"), pdf_link(cell("i_link")).alias("pdf_url"),
        short_year_date(plain_text(cell("i_date"))).alias("report_dt"),
    ).filter("report_dt IS NOT NULL")


def with_file_name(listing: DataFrame) -> DataFrame:
    day = F.date_format("report_dt", "yyyy-MM-dd")
    return listing.withColumn("file_name", build_file_name(F.col("report_type"), day, F.col("target_name"), F.col("broker"), F.col("title")))


def since(listing: DataFrame, target: str | None = None) -> DataFrame:
    """What a run takes: in each category, the rows before the first that is older than the target date.

    Without a target it is the date of the first row of the first category. Rows without a PDF link still stop it.
    """
    if target is None:
        least = listing.agg(F.min_by("report_dt", F.struct("category_order", "pos")).alias("_target"))
        dated = listing.crossJoin(F.broadcast(least))  # one row
    else:
        dated = listing.withColumn("_target", F.lit(target).cast("date"))
    old = dated.filter(F.col("report_dt") < F.col("_target")).groupBy("category").agg(F.min("pos").alias("_stop"))
    going = dated.join(F.broadcast(old), "category", "left")  # a row a category, of which LAYOUT has three
    return going.filter("pdf_url IS NOT NULL AND (_stop IS NULL OR pos < _stop)").drop("_stop", "_target")


def latest_day(listing: DataFrame, today: str) -> DataFrame:
    """One row: the latest date with reports up to today; null where there is none."""
    return listing.filter(F.col("report_dt") <= F.lit(today).cast("date")).agg(F.max("report_dt").cast("string").alias("latest_date"))


def crawl_count(listing: DataFrame, present: DataFrame) -> DataFrame:
    """One row: how many of the listed files a run takes (n_taken) and how many of those are there already (n_present)."""
    known = present.select("file_name", F.lit(True).alias("_there")).distinct()
    return listing.select("file_name").distinct().join(known, "file_name", "left").agg(F.count(F.lit(1)).alias("n_taken"), F.count("_there").alias("n_present"))
