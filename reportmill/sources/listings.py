"""Listing pages as a data source: in one go, or as a stream that goes on behind the pages it has read.

    spark.dataSource.register(ListingSource)
    spark.read.format("listing_pages").option("path", folder).option("since", "2024-02-01").load()
    spark.readStream.format("listing_pages").option("path", folder).load()

Pages are files <category>/<number>.html under a folder that driver and executors see, or whatever `fetch` (module:function
of path, category and number, None where there is no such page) gets for them, from a web server for example.
"""

from __future__ import annotations

import importlib
import json
import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

PAGES = "category string, page int, html string"
CATEGORIES = "company,industry,economy"
#: A row's date as listings have it.
DAY = re.compile(r"<td[^>]*>\s*(\d{2})\.(\d{1,2})\.(\d{1,2})\s*</td>")


def saved_page(path: str, category: str, page: int, encoding: str = "euc-kr") -> str | None:
    """The page from its file; bytes that the encoding doesn't know are replaced."""
    name = os.path.join(path.removeprefix("file://"), category, f"{page}.html")
    if not os.path.exists(name):
        return None
    with open(name, "rb") as f:
        return f.read().decode(encoding, "replace")


def oldest(html: str) -> str:
    """The earliest date of a page's rows as yyyy-mm-dd; the latest there is where no row has one."""
    days = (f"{'19' if int(y) >= 69 else '20'}{y}-{int(m):02d}-{int(d):02d}" for y, m, d in DAY.findall(html))
    return min(days, default="9999-12-31")


@dataclass
class Pages(InputPartition):
    """Pages first..upto of a category; without upto, as far as there are any, or up to one with a row older than since."""

    category: str
    first: int
    upto: int | None = None


class Listings:
    def __init__(self, options: dict[str, str]):
        self.path, self.since = options["path"], options.get("since", "")
        self.categories = [c.strip() for c in options.get("categories", CATEGORIES).split(",")]
        self.pages = int(options.get("pagesPerTask", "20"))
        self.most = int(options.get("maxPagesPerTrigger", "1000"))
        self.encoding, self.fetcher = options.get("encoding", "euc-kr"), options.get("fetch")

    def fetch(self) -> Callable[[str, int], str | None]:
        if self.fetcher:
            module, _, name = self.fetcher.partition(":")
            get = getattr(importlib.import_module(module), name)
            return lambda category, page: get(self.path, category, page)
        return lambda category, page: saved_page(self.path, category, page, self.encoding)

    def read(self, part: Pages) -> Iterator[tuple[str, int, str]]:
        get, page = self.fetch(), part.first
        while part.upto is None or page <= part.upto:
            html = get(part.category, page)
            if html is None:
                return
            yield part.category, page, html
            if part.upto is None and oldest(html) < self.since:
                return
            page += 1

    def ahead(self, category: str, page: int) -> tuple[int, bool]:
        """The last page behind `page` that a batch takes, and whether the category ends there by its dates."""
        get = self.fetch()
        for _ in range(self.most):
            html = get(category, page + 1)
            if html is None:
                break
            page += 1
            if oldest(html) < self.since:
                return page, True
        return page, False


class ListingSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "listing_pages"

    def schema(self) -> str:
        return PAGES

    def reader(self, schema) -> DataSourceReader:
        return Whole(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return Following(self.options)


class Whole(DataSourceReader):
    """A task for each category: where it ends is known only on the way."""

    def __init__(self, options: dict[str, str]):
        self.listings = Listings(options)

    def partitions(self) -> list[Pages]:
        return [Pages(c, 1) for c in self.listings.categories]

    def read(self, partition: Pages) -> Iterator[tuple]:
        return self.listings.read(partition)


class Following(DataSourceStreamReader):
    """Offsets hold how many pages of each category have been read, and which have ended with a row before `since`: no later
    run looks at these again. Pages are numbered once and for all; the driver looks at each new one for its dates alone."""

    def __init__(self, options: dict[str, str]):
        self.listings = Listings(options)
        self.last: dict | None = None

    def initialOffset(self) -> dict:
        return {c: 0 for c in self.listings.categories} | {"ended": "[]"}

    def latestOffset(self) -> dict:
        out = dict(self.last or self.initialOffset())
        ended = set(json.loads(out["ended"]))
        for c in self.listings.categories:
            if c not in ended:
                out[c], over = self.listings.ahead(c, out.get(c, 0))
                ended |= {c} if over else set()
        out["ended"] = json.dumps(sorted(ended))
        return out

    def partitions(self, start: dict, end: dict) -> list[Pages]:
        self.last = end
        parts = []
        for c in self.listings.categories:
            for first in range(start.get(c, 0) + 1, end[c] + 1, self.listings.pages):
                parts.append(Pages(c, first, min(first + self.listings.pages - 1, end[c])))
        return parts

    def read(self, partition: Pages) -> Iterator[tuple]:
        return self.listings.read(partition)

    def commit(self, end: dict) -> None:
        self.last = end
