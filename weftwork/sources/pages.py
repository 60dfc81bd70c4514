"""A Spark data source for captured pages: ``spark.read.format("weft_pages").schema(...).load(path)``.

A capture is a folder ``fetch=<number>`` of folders ``newest=<date>`` that hold files of envelopes, one page a line; the date
is that of the newest row of the folder's pages.  A read ``since`` a moment, or with a filter on ``updated`` that Spark pushes
down, plans the files of that day and later ones only, one partition each, and drops older rows as it decodes.  A stream
reads fetches as they come, by number.

Folders must be on a file system that the driver and all executors mount, as Python lists and opens them; pages
in other stores are read by ``envelope.read_pages``.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from datetime import date, datetime, timezone
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, TimestampNTZType, TimestampType

from weftwork.session import ship_package

BATCH_ROWS = 4096


def write_fetch(df: DataFrame, path: str, number: int, updated: str = "updated", size: int = 250) -> None:
    """Write a capture: rows with their newest day, pages of at most ``size`` rows each."""
    day = F.to_date(updated)
    row = df.select(F.coalesce(day.cast("string"), F.lit("none")).alias("newest"), F.struct(*df.columns).alias("row"), F.floor(F.monotonically_increasing_id() / size).alias("page"))
    pages = row.groupBy("newest", "page").agg(F.to_json(F.struct(F.struct("page").alias("meta"), F.collect_list("row").alias("data")), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}).alias("value"))
    pages.select("value", "newest").write.partitionBy("newest").text(f"{path}/fetch={number:08d}")


def _moment(value: Any) -> datetime | None:
    if value is None or isinstance(value, datetime):
        return value if value is None or value.tzinfo is None else value.astimezone(timezone.utc).replace(tzinfo=None)
    return _moment(datetime.fromisoformat(value))


class Page(InputPartition):
    def __init__(self, file: str):
        self.file = file


def _fetches(path: str) -> list[int]:
    return sorted(int(n.split("=")[1]) for n in os.listdir(path) if n.startswith("fetch="))


def _files(path: str, number: int, since: datetime | None) -> list[str]:
    """The files of a fetch that may hold rows at or after a moment; others aren't opened."""
    top, out = f"{path}/fetch={number:08d}", []
    for folder in sorted(os.listdir(top)):
        day = folder.removeprefix("newest=")
        if not folder.startswith("newest=") or (since is not None and (day == "none" or date.fromisoformat(day) < since.date())):
            continue
        out += [f"{top}/{folder}/{f}" for f in sorted(os.listdir(f"{top}/{folder}")) if f.startswith("part-")]
    return out


def _decoded(file: str, schema: StructType, updated: str, since: datetime | None) -> Iterator[pa.RecordBatch]:
    """Rows of a file's pages as Arrow batches; unknown keys are dropped, missing ones null."""
    times = {f.name for f in schema.fields if isinstance(f.dataType, (TimestampType, TimestampNTZType))}
    zoned = {f.name for f in schema.fields if isinstance(f.dataType, TimestampType)}
    names, kind = schema.names, to_arrow_schema(schema)
    rows: list[dict[str, Any]] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(rows, schema=kind)

    with open(file, encoding="utf-8") as lines:
        for line in lines:
            for r in json.loads(line)["data"]:
                row = {n: r.get(n) for n in names}
                for n in times:
                    moment = _moment(row[n])
                    row[n] = moment.replace(tzinfo=timezone.utc) if moment is not None and n in zoned else moment
                at = _moment(r.get(updated))
                if since is None or (at is not None and at >= since):
                    rows.append(row)
                if len(rows) >= BATCH_ROWS:
                    yield batch()
                    rows = []
    if rows:
        yield batch()


class PageReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, updated: str, since: datetime | None):
        self.path, self.kind, self.updated, self.since = path, schema, updated, since

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)) and f.attribute == (self.updated,) and isinstance(f.value, datetime):
                moment = _moment(f.value)
                self.since = moment if self.since is None else max(self.since, moment)
            # Spark applies each filter again: what is pushed down only saves reading.
            yield f

    def partitions(self) -> list[Page]:
        return [Page(f) for n in _fetches(self.path) for f in _files(self.path, n, self.since)]

    def read(self, partition: Page) -> Iterator[pa.RecordBatch]:
        yield from _decoded(partition.file, self.kind, self.updated, self.since)


class PageStreamReader(DataSourceStreamReader):
    def __init__(self, path: str, schema: StructType, updated: str, since: datetime | None):
        self.path, self.kind, self.updated, self.since = path, schema, updated, since

    def initialOffset(self) -> dict[str, int]:
        return {"fetch": -1}

    def latestOffset(self) -> dict[str, int]:
        return {"fetch": max(_fetches(self.path), default=-1)}

    def partitions(self, start: dict[str, int], end: dict[str, int]) -> list[Page]:
        return [Page(f) for n in _fetches(self.path) if start["fetch"] < n <= end["fetch"] for f in _files(self.path, n, self.since)]

    def read(self, partition: Page) -> Iterator[pa.RecordBatch]:
        yield from _decoded(partition.file, self.kind, self.updated, self.since)


class PageSource(DataSource):
    """Options: ``path``, ``since`` (ISO 8601), ``updated`` (the column it speaks of)."""

    @classmethod
    def name(cls) -> str:
        return "weft_pages"

    def schema(self) -> str:
        raise ValueError("weft_pages needs a schema")

    def _given(self) -> tuple[str, str, datetime | None]:
        return self.options["path"].removeprefix("file://").removeprefix("file:"), self.options.get("updated", "updated"), _moment(self.options.get("since"))

    def reader(self, schema: StructType) -> PageReader:
        path, updated, since = self._given()
        return PageReader(path, schema, updated, since)

    def streamReader(self, schema: StructType) -> PageStreamReader:
        path, updated, since = self._given()
        return PageStreamReader(path, schema, updated, since)


def register(spark: SparkSession) -> None:
    """Make the format known to a session, filters pushed down."""
    ship_package(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PageSource)


def read_since(spark: SparkSession, path: str, schema: StructType, since: datetime | None = None, updated: str = "updated") -> DataFrame:
    """Rows at or after a moment, of pages that may hold some."""
    register(spark)
    reader = spark.read.format("weft_pages").schema(schema).option("updated", updated)
    return (reader if since is None else reader.option("since", since.isoformat())).load(path)
