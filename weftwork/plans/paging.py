"""Pages: offsets and tokens, keysets, relay connections, numbered pages, bound cursors."""

from __future__ import annotations

import base64
import binascii
import json
from collections.abc import Iterator, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from weftwork.plans.filters import FilterError
from weftwork.session import shared_folder

DEFAULT_PAGE, MOST_PAGE = 100, 1000


# Offset pages with an opaque token.


def page_size(asked: int) -> int:
    return DEFAULT_PAGE if asked <= 0 else min(asked, MOST_PAGE)


def encode_token(offset: int) -> str:
    return base64.b64encode(str(offset).encode()).decode() if offset > 0 else ""


def decode_token(token: str) -> int:
    if not token:
        return 0
    try:
        offset = int(base64.b64decode(token, validate=True).decode("ascii"))
    except (binascii.Error, ValueError) as error:
        raise FilterError(f"bad page token: {token!r}") from error
    if offset < 0:
        raise FilterError("page token before the start")
    return offset


def offset_page(ordered: DataFrame, size: int, offset: int) -> DataFrame:
    """One row more than the page, which tells whether there is a next one."""
    return (ordered.offset(offset) if offset else ordered).limit(size + 1)


def token_page(ordered: DataFrame, size: int, token: str = "") -> tuple[list[Row], str]:
    size, offset = page_size(size), decode_token(token)
    rows = offset_page(ordered, size, offset).collect()
    return rows[:size], encode_token(offset + size) if len(rows) > size else ""


# Keysets.


def keyset_after(keys: Sequence[tuple[str, bool]], last: Sequence[Any]) -> Column:
    """Rows after ``last`` in the order of (column, descending) keys: an OR of ANDs."""
    out: Column | None = None
    for at, ((name, down), value) in enumerate(zip(keys, last)):
        lit = value if isinstance(value, Column) else F.lit(value)
        part = F.col(name) < lit if down else F.col(name) > lit
        for (before, _), v in zip(keys[:at], last[:at]):
            part = (F.col(before) == (v if isinstance(v, Column) else F.lit(v))) & part
        out = part if out is None else out | part
    assert out is not None
    return out


def keyset_order(keys: Sequence[tuple[str, bool]]) -> list[Column]:
    return [F.col(name).desc() if down else F.col(name).asc() for name, down in keys]


def stream_rows(df: DataFrame, keys: Sequence[tuple[str, bool]]) -> Iterator[Row]:
    """All rows in keyset order from one sorted plan, a partition at a time."""
    return df.orderBy(*keyset_order(keys)).toLocalIterator(prefetchPartitions=True)


def delta(df: DataFrame, since_id: int | None = None, updated_since: Any = None, key: str = "id", updated: str = "updated") -> DataFrame:
    """Rows after an id and after an update, both exclusive."""
    if since_id is not None:
        df = df.where(F.col(key) > since_id)
    return df if updated_since is None else df.where(F.col(updated) > updated_since)


# Relay connections.


def relay_guard(first: int | None, last: int | None) -> tuple[int | None, int | None]:
    if first is not None and last is not None:
        raise FilterError("first and last exclude each other")
    for n in (first, last):
        if n is not None and not 0 <= n <= MOST_PAGE:
            raise FilterError(f"page size must be 0 to {MOST_PAGE}")
    return (DEFAULT_PAGE, None) if first is None and last is None else (first, last)


def relay_cursor(values: Sequence[Any]) -> str:
    return base64.urlsafe_b64encode(json.dumps(list(values), default=str).encode()).decode()


def relay_page(
    df: DataFrame, keys: Sequence[tuple[str, bool]], first: int | None = None, last: int | None = None, after: Sequence[Any] | None = None, before: Sequence[Any] | None = None
) -> DataFrame:
    """Rows between the cursors, one more than asked; the last rows come from the reversed order."""
    first, last = relay_guard(first, last)
    if after is not None:
        df = df.where(keyset_after(keys, after))
    back = [(name, not down) for name, down in keys]
    if before is not None:
        df = df.where(keyset_after(back, before))
    if last is not None:
        return df.orderBy(*keyset_order(back)).limit(last + 1)
    return df.orderBy(*keyset_order(keys)).limit(first + 1)


def relay_connection(df: DataFrame, keys: Sequence[tuple[str, bool]], **ask: Any) -> dict[str, Any]:
    """Edges with cursors, page info and the total count."""
    first, last = relay_guard(ask.get("first"), ask.get("last"))
    size = last if last is not None else first
    rows = relay_page(df, keys, **ask).collect()
    more, rows = len(rows) > size, rows[:size]
    if last is not None:
        rows.reverse()
    edges = [{"node": r, "cursor": relay_cursor([r[name] for name, _ in keys])} for r in rows]
    return {
        "edges": edges,
        "totalCount": df.count(),
        "pageInfo": {
            "hasNextPage": more if last is None else ask.get("before") is not None,
            "hasPreviousPage": more if last is not None else ask.get("after") is not None,
            "startCursor": edges[0]["cursor"] if edges else None,
            "endCursor": edges[-1]["cursor"] if edges else None,
        },
    }


def offset_guard(offset: int | None, limit: int | None) -> tuple[int, int]:
    offset, limit = offset or 0, DEFAULT_PAGE if limit is None else limit
    if offset < 0 or not 0 <= limit <= MOST_PAGE:
        raise FilterError(f"offset must not be negative, limit 0 to {MOST_PAGE}")
    return offset, limit


# Numbered pages.


def numbered_page(ordered: DataFrame, total: int, page: int = 1, per_page: int = 10) -> tuple[DataFrame, dict[str, int]]:
    """A page of 10 rows, 100 at most; a page after the last is an error."""
    if page < 1 or not 1 <= per_page <= 100:
        raise FilterError("page must be 1 or more, per_page 1 to 100")
    last = max(1, -(-total // per_page))
    if page > last:
        raise FilterError(f"page {page} is after the last, {last}")
    return ordered.offset((page - 1) * per_page).limit(per_page), {"page": page, "per_page": per_page, "total": total, "last_page": last}


# Cursors that are bound to a version of the data.


def encode_cursor(scope: str, parent: Any, version: str, offset: int) -> str:
    return base64.urlsafe_b64encode(json.dumps({"s": scope, "p": parent, "v": version, "o": offset}, sort_keys=True).encode()).decode().rstrip("=")


def cursor_offset(cursor: str, scope: str, parent: Any, version: str) -> int:
    if not cursor:
        return 0
    try:
        got = json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
        offset = got["o"]
    except (ValueError, KeyError, TypeError, binascii.Error) as error:
        raise FilterError("bad cursor") from error
    if (got.get("s"), got.get("p")) != (scope, parent):
        raise FilterError("the cursor belongs to another list")
    if got.get("v") != version:
        raise FilterError("the data has changed since the cursor was made")
    if not isinstance(offset, int) or offset < 0:
        raise FilterError("bad cursor")
    return offset


def slice_page(column: Column, offset: int, size: int) -> Column:
    """Part of a nested set; a page holds 20 entries, 100 at most."""
    size = 20 if size <= 0 else min(size, 100)
    return F.slice(column, offset + 1, size)


def numbered(df: DataFrame, keys: Sequence[str], name: str = "at", weight: Column | None = None) -> DataFrame:
    """Number the rows from 0 in the order of ``keys``, nulls first, without sorting all of them in one task.

    Spark deals the rows into ranges by a sample, and they are stored once with their range; a row's number is the count of the
    ranges before its own plus its number within.  Rows of one key differ by row, so a key that repeats spreads over ranges.
    With a weight, a row stands for so many, and the number is that of those before it.
    """
    weight = F.lit(1) if weight is None else weight
    path, order = shared_folder(df.sparkSession, "numbered"), [*keys, "_row"]
    n = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = df.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id())
    dealt.write.parquet(path)
    stored = df.sparkSession.read.schema(dealt.schema).parquet(path)
    counts = stored.groupBy("_range").agg(F.sum(weight).alias("_n"))
    # One row for each range.
    before = counts.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    within = stored.repartition(n, "_range").withColumn(name, F.sum(weight).over(Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - weight)
    return within.join(F.broadcast(before), "_range").withColumn(name, (F.col("_before") + F.col(name)).cast("bigint")).drop("_range", "_before", "_row")


def batches(df: DataFrame, keys: Sequence[str], size: int) -> DataFrame:
    """Add ``batch``: which batch of ``size`` rows, in the order of ``keys``, holds the row."""
    return numbered(df, keys, "batch").withColumn("batch", F.floor(F.col("batch") / size).cast("bigint"))
