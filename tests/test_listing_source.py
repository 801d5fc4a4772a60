"""Listing pages as a table and as a stream, over saved pages."""

import os

import pytest
from pyspark.sql import functions as F

from reportmill.operators import listing
from reportmill.sources import listings
from reportmill.sources.listings import ListingSource


def save(folder, category, page, days):
    os.makedirs(folder / category, exist_ok=True)
    rows = "".join(f'<tr><td>회사</td><td>제목 {category} {page} {d}</td><td>증권</td><td><a href="{category}{page}.pdf">f</a></td><td>{d}</td><td>9</td></tr>' for d in days)
    html = f'<table class="type_1"><tr><th>x</th></tr>{rows}</table>'
    (folder / category / f"{page}.html").write_bytes(html.encode("euc-kr"))


@pytest.fixture
def folder(tmp_path):
    d = tmp_path / "pages"
    for page in range(1, 6):
        save(d, "company", page, [f"24.02.{28 - 4 * page + i}" for i in (3, 2, 1, 0)])
    save(d, "industry", 1, ["24.02.20"])
    return d


def seen(df):
    return sorted((r.category, r.page) for r in df.collect())


def test_as_a_table(spark, folder):
    spark.dataSource.register(ListingSource)
    read = lambda **o: spark.read.format("listing_pages").options(path=str(folder), **o).load()
    assert seen(read()) == [("company", p) for p in range(1, 6)] + [("industry", 1)]
    assert seen(read(since="2024-02-19")) == [("company", p) for p in (1, 2, 3)] + [("industry", 1)]  # page 3 has the first that is too old
    rows = listing.listing_rows(read(since="2024-02-19"))
    taken = listing.since(rows, "2024-02-19").select("title", "target_name", F.col("report_dt").cast("string").alias("d")).collect()
    assert min(r.d for r in taken) == "2024-02-19" and len(taken) == 10 and {r.target_name for r in taken} == {"회사"}
    assert seen(read(categories="economy")) == []


def test_other_fetchers(spark, folder):
    """Any function that workers can import; this one takes the pages' bytes for euc-kr, too."""
    spark.dataSource.register(ListingSource)
    read = lambda **o: spark.read.format("listing_pages").options(path=str(folder), **o).load()
    assert sorted(map(tuple, read(fetch="reportmill.sources.listings:saved_page", encoding="none").collect())) == sorted(map(tuple, read().collect()))


def test_as_a_stream(spark, folder, tmp_path):
    """Each run reads the pages that are new; a category that ended is left alone, and so is what was read before a restart."""
    spark.dataSource.register(ListingSource)
    got = []

    def run(**options):
        batches = []
        stream = spark.readStream.format("listing_pages").options(path=str(folder), since="2024-02-15", pagesPerTask="2", **options).load()
        q = stream.writeStream.foreachBatch(lambda df, _: batches.append(seen(df))).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        got.extend(x for b in batches for x in b)
        return sorted(x for b in batches for x in b)

    assert run() == [("company", p) for p in (1, 2, 3, 4)] + [("industry", 1)]
    assert run() == []
    save(folder, "company", 6, ["24.02.01"])
    save(folder, "industry", 2, ["24.02.18"])
    save(folder, "economy", 1, ["24.02.19"])
    assert run() == [("economy", 1), ("industry", 2)]
    save(folder, "industry", 3, ["24.01.01"])
    assert run() == [("industry", 3)] and run() == []
    save(folder, "industry", 4, ["24.02.18"])
    assert run() == [] and len(got) == len(set(got))


def test_dates():
    assert listings.oldest("<td> 24.2.1 </td><td>99.12.31</td>") == "1999-12-31" and listings.oldest("<td>x</td>") == "9999-12-31"
