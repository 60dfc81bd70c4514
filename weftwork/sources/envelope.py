"""JSON envelopes ``{"meta": ..., "data": [rows]}`` in and out, and other text sinks."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftwork.plans.schema import NATIVE_DDL

#: The column that numbers arrivals: later ones are greater.
ARRIVAL = "_arrival"


def read_envelope(spark: SparkSession, path: str, row: T.StructType) -> DataFrame:
    """Rows of all envelopes under a path; unknown keys are dropped by the schema."""
    envelope = T.StructType([T.StructField("data", T.ArrayType(row))])
    return spark.read.schema(envelope).option("multiLine", True).json(path).select(F.explode("data").alias("r")).select("r.*")


def read_native(spark: SparkSession, path: str, name: str) -> DataFrame:
    return read_envelope(spark, path, T.StructType.fromDDL(NATIVE_DDL[name]))


def write_pages(df: DataFrame, path: str, page: Column, meta: Mapping[str, Any] | None = None) -> None:
    """Envelopes of pages, one a line, written compressed by the executors; rows of a page are those of one value."""
    head = F.struct(F.col("_page").alias("page"), *[F.lit(v).alias(k) for k, v in (meta or {}).items()])
    pages = df.select(page.alias("_page"), F.struct(*df.columns).alias("_row")).groupBy("_page").agg(F.collect_list("_row").alias("data"))
    pages.select(F.to_json(F.struct(head.alias("meta"), "data")).alias("value")).write.option("compression", "gzip").text(path)


def read_pages(spark: SparkSession, path: str, row: T.StructType) -> DataFrame:
    """Rows of envelopes, one a line, with ``_arrival``: (number of the page, position in it)."""
    envelope = T.StructType([T.StructField("meta", T.StructType([T.StructField("page", T.LongType())])), T.StructField("data", T.ArrayType(row))])
    pages = spark.read.schema(envelope).json(path).select("meta.page", F.posexplode("data").alias("at", "r"))
    return pages.select("r.*", F.struct("page", "at").alias(ARRIVAL))


def read_lines(spark: SparkSession, path: str, row: T.StructType) -> DataFrame:
    """One row object a line: splittable, the form for large captures."""
    return spark.read.schema(row).json(path)


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """(path, value): whole captured pages."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")


def parse_rows(df: DataFrame, column: str, row: T.StructType) -> DataFrame:
    """Rows from a column of envelopes."""
    envelope = T.StructType([T.StructField("data", T.ArrayType(row))])
    return df.select(F.explode(F.from_json(column, envelope)["data"]).alias("r")).select("r.*")


def since(df: DataFrame, cursor: Any, updated: str = "updated") -> DataFrame:
    """An incremental read: rows updated at or after the cursor."""
    return df if cursor is None else df.where(F.col(updated) >= F.lit(cursor))


def json_rows(df: DataFrame, keep_null: bool = False) -> DataFrame:
    """One JSON object a row."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": str(not keep_null).lower()}).alias("value"))


def write_json_rows(df: DataFrame, path: str) -> None:
    """The rows as JSON lines, written by the executors."""
    json_rows(df).write.text(path)


def stream_envelope(df: DataFrame, meta: Mapping[str, Any] | None = None, flush: int = 100) -> Iterator[str]:
    """An envelope in parts of ``flush`` rows, a partition at a time through the driver."""
    yield '{"meta":' + json.dumps(dict(meta or {})) + ',"data":['
    part: list[str] = []
    first = True
    for row in json_rows(df).toLocalIterator(prefetchPartitions=True):
        part.append(row["value"])
        if len(part) == flush:
            yield ("" if first else ",") + ",".join(part)
            part, first = [], False
    if part:
        yield ("" if first else ",") + ",".join(part)
    yield "]}"


def single_envelope(df: DataFrame, meta: Mapping[str, Any] | None = None) -> str:
    """The envelope of a detail row."""
    rows = [json.loads(r["value"]) for r in json_rows(df.limit(1)).collect()]
    return json.dumps({"meta": dict(meta or {}), "data": rows})


def proto_columns(df: DataFrame, names: Mapping[str, str] | Iterable[str]) -> DataFrame:
    """Columns under the names of another wire form."""
    pairs = names.items() if isinstance(names, Mapping) else [(n, n) for n in names]
    return df.select(*[F.col(a).alias(b) for a, b in pairs])
