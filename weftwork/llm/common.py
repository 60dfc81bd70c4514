"""Helpers shared by the operators: shared storage, shipping the package, word rules."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftwork.session import ship_package as ship_package

#: Fixed value: the white space that separates words (space, tab, LF, VT, FF, CR).
SPACE_CHARS = " \t\n\x0b\x0c\r"
#: Fixed value: a run of anything else is a word.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
SPACE_PATTERN = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session names none, a local session gets a local folder, set once for the context.
    A cluster's executors would each write to a disk of their own, so there this is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if not current:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="weftwork-"))
        current = spark.sparkContext.getCheckpointDir()
    return current.rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path under the shared folder."""
    return f"{shared_dir(spark)}/weftwork/{label}-{uuid.uuid4().hex}"


#: Open lists of the paths that ``materialize`` writes, of this thread or context; see ``tracking``.
_TRACKED: ContextVar[tuple[list[str], ...]] = ContextVar("tracked", default=())


def materialize(df: DataFrame, label: str, codec: str = "zstd", by: str | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    This cuts the lineage in storage that outlives any executor, and later
    readers see only the columns they need, and of a table dealt by a column only the folders they ask for.
    """
    path = shared_path(df.sparkSession, label)
    writer = df.write.option("compression", codec)
    (writer.partitionBy(by) if by else writer).parquet(path)
    for paths in _TRACKED.get():
        paths.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in any storage that Spark reaches."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


@contextmanager
def tracking() -> Iterator[list[str]]:
    """Collect the paths of the tables that are written inside, so that they can be deleted
    when no plan reads them any more.  Another thread's tables aren't among them."""
    paths: list[str] = []
    before = _TRACKED.set((*_TRACKED.get(), paths))
    try:
        yield paths
    finally:
        _TRACKED.reset(before)


def delete(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables of the shared folder."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: Positions of the bitmap of ``with_likely``; with 64 to a row it has 2**17 rows (2 MB) at most.
BITMAP_BITS = 23


def _one_bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))


def with_likely(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Add ``_likely``: false for rows whose key is surely not in ``keys``.

    A bitmap of hashed keys is broadcast.  Its size is fixed; with many more keys than positions
    more rows are likely, never fewer.
    """
    place = F.pmod(F.xxhash64(key), F.lit(1 << BITMAP_BITS))
    words = keys.select(key).groupBy(F.shiftright(place, 6).alias("_word")).agg(F.bit_or(_one_bit(place)).alias("_bits"))
    words = materialize(words, "bitmap")
    marked = df.withColumn("_place", place).join(F.broadcast(words), F.shiftright("_place", 6) == F.col("_word"), "left")
    hit = F.col("_bits").bitwiseAND(_one_bit(F.col("_place"))) != 0
    return marked.withColumn("_likely", F.coalesce(hit, F.lit(False))).drop("_place", "_word", "_bits")


def likely_in(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose key is in ``keys``, and a few others: a filter to run before a join."""
    return with_likely(df, keys, key).where("_likely").drop("_likely")


def words_of(text: Column) -> Column:
    """The words of ``text`` as an array; empty for null, empty or blank texts."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_PATTERN))


def word_count(text: Column) -> Column:
    """Number of words, as long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8_column(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """A string column of an Arrow batch as UTF-8 bytes; null becomes empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [value or b"" for value in column.cast(kind).to_pylist()]


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 8 << 20):
    """Cut an Arrow batch so that a slice holds about ``most_bytes`` of ``column``.

    Batches are cut by rows when Spark sends them, so a run of long texts could
    otherwise make one step of a Python worker large.
    """
    start, size = 0, 0
    for i, text in enumerate(batch.column(column)):
        size += text.as_buffer().size if text.is_valid else 0
        if size >= most_bytes:
            yield batch.slice(start, i + 1 - start)
            start, size = i + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)
