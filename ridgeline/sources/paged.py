"""Rows that a service hands out page by page, as a Spark data source whose partitions are ranges of pages (SRC-15)."""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from pathlib import Path
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Pages that a task reads, tries of a page, and seconds before the second try, doubled before each further one.
PAGES, TRIES, WAIT = 10, 4, 0.2


class PageRange(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


def file_page(path: str, number: int) -> list[dict]:
    """Page ``number`` of a folder that stands for the service: the JSON list in ``page=<number>``; a page that isn't there is empty."""
    where = urlparse(path)
    if where.scheme not in ("", "file"):
        raise ValueError(f"pages are read from files, not from {where.scheme}")
    files = sorted(p for p in Path(where.path, f"page={number}").glob("*") if not p.name.startswith((".", "_")))
    return [item for f in files for line in f.read_text("utf-8").splitlines() for item in json.loads(line)]


def with_retries(fetch, path: str, number: int, tries: int = TRIES, wait: float = WAIT) -> list[dict]:
    """The page; a failed try is repeated after a while, the last one's error is raised."""
    for i in range(tries):
        try:
            return fetch(path, number)
        except (OSError, json.JSONDecodeError):
            if i == tries - 1:
                raise
            time.sleep(wait * 2**i)
    return []


class PagedRows(DataSource):
    """(row_idx, row): options ``path``, ``rows`` (how many there are) and ``page_rows``. A subclass with another ``fetch`` reads a service."""

    fetch = staticmethod(file_page)

    @classmethod
    def name(cls) -> str:
        return "paged_rows"

    def schema(self) -> str:
        return "row_idx long, row string"

    def reader(self, schema) -> DataSourceReader:
        return PagedReader(self.options, type(self).fetch)


class PagedReader(DataSourceReader):
    def __init__(self, options, fetch):
        self.path, self.rows, self.size, self.fetch = options["path"], int(options["rows"]), int(options["page_rows"]), fetch
        if self.size <= 0:
            raise ValueError("page_rows must be positive")

    def partitions(self) -> list[PageRange]:
        pages = -(-self.rows // self.size)
        return [PageRange(i, min(i + PAGES, pages)) for i in range(0, max(pages, 1), PAGES)]

    def read(self, partition: PageRange) -> Iterator[tuple]:
        for number in range(partition.first, partition.last):
            found = with_retries(self.fetch, self.path, number)
            want = min(self.size, self.rows - number * self.size)
            if len(found) != want:
                raise ValueError(f"page {number} has {len(found)} rows, not {want}")
            for item in found:
                yield int(item["row_idx"]), json.dumps(item["row"], ensure_ascii=False)


def write_pages(rows: DataFrame, number: str, path: str, page_rows: int) -> None:
    """Writes ``rows``, numbered from 1 by ``number``, as pages in the service's form, one folder a page."""
    body = F.struct(*[c for c in rows.columns if c != number])
    item = F.struct((F.col(number) - 1).alias("row_idx"), body.alias("row"))
    pages = rows.select(((F.col(number) - 1) / page_rows).cast("long").alias("page"), item.alias("item")).groupBy("page").agg(F.to_json(F.array_sort(F.collect_list("item")), {"ignoreNullFields": "false"}).alias("value"))
    pages.write.partitionBy("page").text(path)


def read_pages(spark: SparkSession, path: str, rows: int, page_rows: int = 100, source: type[PagedRows] = PagedRows) -> DataFrame:
    """(row_idx, row) of all pages, in stable numbers; a page that lacks rows is an error, not an end."""
    spark.dataSource.register(source)
    return spark.read.format(source.name()).option("path", path).option("rows", str(rows)).option("page_rows", str(page_rows)).load()
