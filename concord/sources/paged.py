"""Listings in pages as a Spark data source: pages are followed by their tokens, in batch and as a stream whose offsets are the listings' cursors.

A listing is a folder; its pages are files TOKEN.json of {"items": [...], "next_page_token": TOKEN},
the first one START.json.  Folders must be mounted where tasks run.

    register(spark)
    spark.read.format("concord_pages").schema("listing string, id long, name string").load(folder)
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from datetime import datetime

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import DateType, DecimalType, StructType, TimestampNTZType, TimestampType

START = "start"
#: More pages than this in one listing are taken for a fault of the source: it raises, nothing is cut off.
MAX_PAGES = 1000


class Pages(InputPartition):
    """Pages of one listing: from after the page `after` (null: the first), `count` of them (null: all)."""

    def __init__(self, listing: str, after: str | None = None, count: int | None = None):
        self.listing, self.after, self.count = listing, after, count


class _Walk:
    def __init__(self, options: dict, schema: StructType):
        self.folder, self.schema = options["path"], schema
        self.max_pages = int(options.get("maxPages", MAX_PAGES))
        self.items, self.next = options.get("itemsKey", "items"), options.get("tokenKey", "next_page_token")
        self.missing_ok = options.get("missingIsEmpty", "false").lower() == "true"

    def listings(self) -> list[str]:
        return sorted(e.name for e in os.scandir(self.folder) if e.is_dir())

    def page(self, listing: str, token: str) -> dict | None:
        """A page, or null where a listing has none and that counts as empty; a page that another one names must be there."""
        try:
            with open(os.path.join(self.folder, listing, f"{token}.json"), encoding="utf-8") as f:
                return json.load(f)
        except FileNotFoundError:
            if token == START and self.missing_ok:
                return None
            raise

    def pages(self, part: Pages) -> Iterator[tuple[str, dict]]:
        """Tokens and pages, one after the other; a token that comes twice, or more pages than allowed, raise."""
        token, seen = START, set()
        if part.after is not None:
            token = (self.page(part.listing, part.after) or {}).get(self.next)
        while token and (part.count is None or len(seen) < part.count):
            if token in seen:
                raise ValueError(f"listing {part.listing!r} comes back to page {token!r}")
            if len(seen) >= self.max_pages:
                raise ValueError(f"listing {part.listing!r} has over {self.max_pages} pages")
            seen.add(token)
            page = self.page(part.listing, token)
            if page is None:
                return
            yield token, page
            token = page.get(self.next)

    def rows(self, part: Pages) -> Iterator[tuple]:
        for _, page in self.pages(part):
            for item in page.get(self.items) or []:
                yield tuple(part.listing if f.name == "listing" else _typed(item.get(f.name), f.dataType) for f in self.schema.fields)


def _typed(value, kind):
    if value is None:
        return None
    if isinstance(kind, TimestampType | TimestampNTZType):
        return datetime.fromisoformat(value)
    if isinstance(kind, DateType):
        return datetime.fromisoformat(value).date()
    if isinstance(kind, DecimalType):
        from decimal import Decimal

        return Decimal(str(value))
    return value


class PagedReader(DataSourceReader):
    def __init__(self, walk: _Walk):
        self.walk, self.only = walk, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Listings that are asked for by name are the only ones that are walked."""
        for f in filters:
            if isinstance(f, EqualTo | In) and tuple(f.attribute) == ("listing",):
                asked = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.only = asked if self.only is None else self.only & asked
            else:
                yield f

    def partitions(self) -> list[Pages]:
        return [Pages(x) for x in self.walk.listings() if self.only is None or x in self.only]

    def read(self, partition: Pages) -> Iterator[tuple]:
        return self.walk.rows(partition)


class PagedStream(DataSourceStreamReader):
    """An offset names the last page read of each listing, and how many there were."""

    def __init__(self, walk: _Walk):
        self.walk, self.known = walk, {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        for listing in self.walk.listings():
            n, last = self.known.get(listing, (0, None))
            for token, _ in self.walk.pages(Pages(listing, last)):
                n, last = n + 1, token
            if last is not None:
                self.known[listing] = (n, last)
        return {k: list(v) for k, v in self.known.items()}

    def partitions(self, start: dict, end: dict) -> list[Pages]:
        self.known = {k: tuple(v) for k, v in end.items()} | self.known
        out = []
        for listing, (n, _) in sorted(end.items()):
            before, after = start.get(listing, (0, None))
            if n > before:
                out.append(Pages(listing, after, n - before))
        return out

    def read(self, partition: Pages) -> Iterator[tuple]:
        return self.walk.rows(partition)

    def commit(self, end: dict) -> None:
        """Pages are kept by whoever wrote them."""


class PagedListings(DataSource):
    """Options: path; maxPages, itemsKey, tokenKey, missingIsEmpty. The schema names the items' keys, and listing."""

    @classmethod
    def name(cls) -> str:
        return "concord_pages"

    def schema(self) -> str:
        return "listing string, key string, checksum string, seq long"

    def reader(self, schema: StructType) -> PagedReader:
        return PagedReader(_Walk(self.options, schema))

    def streamReader(self, schema: StructType) -> PagedStream:
        return PagedStream(_Walk(self.options, schema))


def register(spark: SparkSession) -> None:
    """Make the source known to a session, and let filters reach it."""
    spark.dataSource.register(PagedListings)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
