"""A range cache of provider series: Parquet by provider and key, a manifest with optimistic commits, and SQL over all of it."""

from __future__ import annotations

import datetime as dt
import json
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.bars import merge_range

from . import ranges

ENTRY = "provider string, key string, path string, coverage_start date, first date, last date, n long, fetched_at timestamp"
Fetch = Callable[[str, dt.date, dt.date], DataFrame]


class Conflict(Exception):
    """Another writer has committed the same series meanwhile."""


class DataUnavailable(Exception):
    """There is nothing to return for a range."""


def safe_key(key: str) -> str:
    return re.sub(r"[^A-Za-z0-9._=-]", "_", key)


class RangeCache:
    """Tables are written under a new name, and the manifest names the current one: readers never see half a table.

    The manifest is a log of numbered files, one for each commit. A writer takes
    the number after the last one that it has seen; where another has that
    number, it goes on behind it if that was another series, and fails if it was
    the same: of two writers of one series, one wins and the other knows. This
    holds on stores where a file that exists cannot be created again.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The number of the last commit; 0 before the first."""
        at, files = self._path(f"{self.root}/manifest")
        names = [s.getPath().getName() for s in files.listStatus(at)] if files.exists(at) else []
        return max((int(n[1:-5]) for n in names if re.fullmatch(r"v\d+\.json", n)), default=0)

    def entries(self) -> DataFrame:
        """The current table of each provider and key, and the commit it is from."""
        if not self.version():
            return self.spark.createDataFrame([], f"version long, {ENTRY}")
        log = self.spark.read.schema(ENTRY).json(f"{self.root}/manifest/v*.json")
        log = log.withColumn("version", F.regexp_extract("_metadata.file_name", r"v(\d+)\.json", 1).cast("long"))
        names = [c for c in log.columns if c not in ("version", "provider", "key")]
        return log.groupBy("provider", "key").agg(F.max("version").alias("version"), F.max_by(F.struct(*names), "version").alias("e")).select("version", "provider", "key", "e.*")

    def entry(self, provider: str, key: str):
        return self.entries().filter((F.col("provider") == provider) & (F.col("key") == safe_key(key))).first()

    def load(self, provider: str, key: str) -> DataFrame | None:
        row = self.entry(provider, key)
        return self.spark.read.parquet(row.path) if row else None

    def commit(self, entry: dict, seen: int) -> int:
        """Append an entry behind commit `seen`; Conflict where a later one is of the same series."""
        number = seen
        while True:
            number += 1
            at, files = self._path(f"{self.root}/manifest/v{number:012d}.json")
            try:
                out = files.create(at, False)
            except Exception as error:  # noqa: BLE001  the store's own error, from Java
                if not files.exists(at):
                    raise
                other = self.spark.read.schema(ENTRY).json(at.toString()).first()
                if other is None or (other.provider, other.key) == (entry["provider"], entry["key"]):
                    raise Conflict(f"{entry['provider']}:{entry['key']} has changed since commit {seen}") from error
                continue
            out.write(bytearray(json.dumps(entry, default=str).encode()))
            out.close()
            return number

    def save(self, provider: str, key: str, rows: DataFrame, coverage_start: dt.date | None = None, fetched_at: dt.datetime | None = None, seen: int | None = None) -> int:
        """Write rows as the current table of a series; the number of the commit."""
        seen = self.version() if seen is None else seen
        path = f"{self.root}/data/{provider}/{safe_key(key)}/{uuid.uuid4().hex}"
        rows.write.parquet(path)
        edge = self.spark.read.parquet(path).agg(F.min("date").alias("first"), F.max("date").alias("last"), F.count(F.lit(1)).alias("n")).first()
        fetched = fetched_at or self.spark.sql("SELECT current_timestamp() AS t").first().t
        entry = {"provider": provider, "key": safe_key(key), "path": path, "coverage_start": coverage_start or edge["first"], "first": edge["first"], "last": edge["last"], "n": edge.n, "fetched_at": fetched.isoformat()}
        return self.commit(entry, seen)

    def refresh(self, provider: str, key: str, new: DataFrame) -> DataFrame:
        """Merge a refetched range into what is cached; rows of the new fetch win, so corrections land."""
        seen, old = self.version(), self.load(provider, key)
        self.save(provider, key, new if old is None else merge_range(old, new), seen=seen)
        return self.load(provider, key)

    def ranged(self, provider: str, key: str, start: dt.date, end: dt.date, ttl_hours: float, fetch: Fetch | None, now: dt.datetime, refresh: bool = False, tries: int = 3) -> DataFrame:
        """The rows of a series from start to end, fetching what `ranges.to_fetch` asks for; without fetch, only what is cached.

        Fails where there is nothing in the range. Where another writer was
        first, the ranges are worked out again from what it has left.
        """
        schema = "provider string, key string, start date, end date, now timestamp, ttl_hours double, refresh boolean"
        for attempt in range(tries):
            seen, entry = self.version(), self.entry(provider, key)
            request = self.spark.createDataFrame([(provider, safe_key(key), start, end, now, float(ttl_hours), refresh)], schema)
            coverage = self.entries().select("provider", "key", "coverage_start", F.col("last").alias("last_row"), "fetched_at")
            plan = ranges.to_fetch(request, coverage).first()
            held = self.load(provider, key) if entry and not refresh else None
            if fetch is None:
                if held is None:
                    raise DataUnavailable(f"offline and no cached {provider}:{key}")
                break
            if not plan.parts:
                break
            rows = held
            for part in plan.parts:
                new = fetch(key, part.first, part.last)
                rows = new if rows is None else merge_range(rows, new)
            fetched = now if any(p.part != "head" for p in plan.parts) else entry.fetched_at
            if rows.isEmpty():
                raise DataUnavailable(f"{provider}:{key} returned no data for {start} to {end}")
            begun = start if held is None or entry.coverage_start is None else min(start, entry.coverage_start)
            try:
                self.save(provider, key, rows, begun, fetched, seen)
            except Conflict:
                if attempt == tries - 1:
                    raise
                continue
            held = self.load(provider, key)
            break
        return held.filter(F.col("date").between(F.lit(start), F.lit(end)))

    def sql(self, query: str) -> DataFrame:
        """A SELECT with a view for each provider: its current tables by column name, with their file names."""
        for provider, paths in self.entries().groupBy("provider").agg(F.collect_list("path").alias("paths")).collect():  # a row for each provider
            rows = self.spark.read.option("mergeSchema", True).parquet(*paths)
            rows.select("*", F.col("_metadata.file_path").alias("filename")).createOrReplaceTempView(provider)
        return self.spark.sql(query)
