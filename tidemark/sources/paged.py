"""A Spark data source over series that are stored page by page.

Pages are JSON files `<path>/<key>/page-<number>.json` in the form of a paged
service: `{"response": {"total": N, "data": [{"period": ..., "value": ...}]}}`.

    spark.dataSource.register(paged.PagedSeries)
    spark.read.format("paged_series").load(root).filter("key = 'W1' and date >= '2026-01-01'")

Each page is a partition. Filters on key choose folders, filters on date drop
rows in the reader (both are pushed where the session allows it:
`spark.sql.python.filterPushdown.enabled`). Pages must add up to the total that
they state: a missing or short page is an error, not a shorter series.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Iterator, Sequence
from typing import NamedTuple

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

COMPARED = {GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, EqualTo: lambda a, b: a == b}


class Page(InputPartition):
    def __init__(self, key: str, uri: str, number: int, expected: int) -> None:
        self.key, self.uri, self.number, self.expected = key, uri, number, expected


class Bound(NamedTuple):
    """A pushed comparison of the date."""

    kind: type
    date: dt.date


def month_end(year: int, month: int) -> dt.date:
    return dt.date(year + month // 12, month % 12 + 1, 1) - dt.timedelta(1)


def period_of(text: str) -> dt.date:
    """The last day of a month or year, or the day itself."""
    parts = list(map(int, text.split("-")))
    return dt.date(*parts) if len(parts) == 3 else month_end(parts[0], parts[1] if len(parts) == 2 else 12)


def page_of(files: fs.FileSystem, path: str) -> dict:
    with files.open_input_stream(path) as file:
        body = json.loads(file.read())
    if not isinstance(body, dict) or "response" not in body:
        raise ValueError(f"{path}: payload has no response")
    return body["response"]


class Reader(DataSourceReader):
    def __init__(self, root: str) -> None:
        self.root, self.keys, self.bounds = root.rstrip("/"), None, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802  Spark's name
        """Keep those on key and date; the others are Spark's."""
        for f in filters:
            column = getattr(f, "attribute", None)
            if column == ("key",) and isinstance(f, EqualTo | In):
                names = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.keys = names if self.keys is None else self.keys & names
            elif isinstance(f, IsNotNull) and column in (("key",), ("date",)):
                continue  # they never are
            elif column == ("date",) and type(f) in COMPARED and isinstance(f.value, dt.date):
                self.bounds.append(Bound(type(f), f.value))
            else:
                yield f

    def partitions(self) -> Sequence[Page]:
        """A partition for each page; the first page of a key says how many rows there must be."""
        files, top = fs.FileSystem.from_uri(self.root)
        folders = [i for i in files.get_file_info(fs.FileSelector(top)) if i.type == fs.FileType.Directory]
        out = []
        for folder in sorted(folders, key=lambda i: i.base_name):
            if self.keys is not None and folder.base_name not in self.keys:
                continue
            pages = sorted(i.path for i in files.get_file_info(fs.FileSelector(folder.path)) if i.base_name.startswith("page-"))
            if not pages:
                continue
            first = page_of(files, pages[0])
            total, size = int(first["total"]), len(first["data"])
            if total > size * len(pages) or len(pages) > max(1, -(-total // max(size, 1))):
                raise ValueError(f"{folder.base_name}: {len(pages)} pages of {size} rows for a total of {total}")
            out += [Page(folder.base_name, p, k, min(size, total - k * size)) for k, p in enumerate(pages)]
        return out

    def read(self, page: Page) -> Iterator[tuple]:
        files, _ = fs.FileSystem.from_uri(self.root)
        rows = page_of(files, page.uri)["data"]
        if len(rows) != page.expected:
            raise ValueError(f"{page.key}: page {page.number} has {len(rows)} rows, {page.expected} are missing or too many by its total")
        for row in rows:
            date = period_of(row["period"])
            if all(COMPARED[b.kind](date, b.date) for b in self.bounds):
                value = row.get("value")
                try:
                    value = None if value is None else float(value)
                except ValueError:
                    value = None
                yield page.key, date, value, row.get("units"), page.number


class PagedSeries(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_series"

    def schema(self) -> str:
        return "key string, date date, value double, units string, page int"

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options["path"])
