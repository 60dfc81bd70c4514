"""Children wait for their parents: a stateful stream.

A child passes once its parent is there, as does each further update of it.  Without an end of the wait this is a join of two streams,
whose state holds both sides by parent: no Python, and no call for each parent.  Late updates pass the join, and the merge drops them.

With an end of the wait, state is keyed by parent in a processor: whether it was seen, the children that wait for it, and the newest update of every child, so late
ones never pass; a timer ends the wait of what never finds its parent, and it passes as an orphan.  That is one Python call for each parent of a batch.

A parent's children are dealt over ``shares`` keys by a hash of their id, so a parent with very many isn't one key; the parent itself goes to all of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from weftwork.session import ship_package
from weftwork.streaming import merge

PASSED = "state string, id long, updated timestamp, row string"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


class Waiting(StatefulProcessor):
    """Rows of a parent's share of children; ``wait_ms`` after the first of them arrived they pass as orphans."""

    def __init__(self, wait_ms: int):
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "seen boolean")
        self.held = handle.getMapState("held", "id long", "updated timestamp, row string")
        self.newest = handle.getMapState("newest", "id long", "updated timestamp")

    def _held(self, state: str) -> list[tuple]:
        out = [(state, key[0], value[0], value[1]) for key, value in self.held.iterator()]
        self.held.clear()
        return out

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        every = pd.concat(list(rows), ignore_index=True)
        children = every[~every["is_parent"]].sort_values(["updated", "row"]).drop_duplicates("id", keep="last")
        waiting, there = bool(self.held.exists()), bool(self.seen.exists())
        out: list[tuple] = []
        if not there and len(children) < len(every) and every["is_parent"].any():
            there = True
            self.seen.update((True,))
            out += self._held("kept") if waiting else []
        for child, updated, row in zip(children["id"].astype("int64").tolist(), [t.to_pydatetime() for t in children["updated"]], children["row"]):
            if self.newest.containsKey((child,)) and self.newest.getValue((child,))[0] >= updated:
                continue
            self.newest.updateValue((child,), (updated,))
            if there:
                out.append(("kept", child, updated, row))
            else:
                self.held.updateValue((child,), (updated, row))
        if not there and len(children) and not waiting:
            first = int(children["arrived"].min().timestamp() * 1000)
            self.handle.registerTimer(max(first, timerValues.getCurrentWatermarkInMs()) + self.wait_ms)
        if out:
            yield _frame(out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        out = self._held("orphan")
        for _, child, *_ in out:
            # Should it arrive again, it waits again.
            self.newest.removeKey((child,))
        if out:
            yield _frame(out)

    def close(self) -> None:
        pass


def _frame(rows: list[tuple[str, int, datetime, str]]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["state", "id", "updated", "row"]).astype({"updated": "datetime64[us]"})


def waiting_children(children: DataFrame, parents: DataFrame, fk: str, key: str, parent_key: str, updated: str, shares: int = 8, arrived: str | None = None, wait_ms: int = 3_600_000) -> DataFrame:
    """``state`` (kept or orphan) and the columns of a stream of children, as their parents arrive in another.

    Children without an id, a key or an update pass nowhere.  With ``arrived``, a column of event time in both streams, children whose
    parent is still missing ``wait_ms`` later by the watermark pass as orphans; without it they wait.
    """
    parent, share = F.col(fk).cast("long").alias("parent"), F.pmod(F.xxhash64(key), F.lit(shares)).cast("int").alias("share")
    every_share = F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share")
    left = children.where(F.col(fk).isNotNull() & F.col(key).isNotNull() & F.col(updated).isNotNull())
    if arrived is None:
        # A parent counts once, however often it arrives.
        once = parents.select(F.col(parent_key).cast("long").alias("parent")).where("parent IS NOT NULL").dropDuplicates(["parent"])
        rows = left.select(parent, share, F.struct(*children.columns).alias("r"))
        return rows.join(once.select("parent", every_share), ["parent", "share"]).select(F.lit("kept").alias("state"), "r.*")
    ship_package(children.sparkSession)
    given = F.struct(*[c for c in children.columns if c != arrived])
    left = left.select(
        parent, share, F.lit(False).alias("is_parent"), F.col(key).cast("long").alias("id"),
        F.col(updated).cast("timestamp").alias("updated"), F.to_json(given, _JSON).alias("row"), F.col(arrived).cast("timestamp").alias("arrived"),
    )
    right = parents.select(
        F.col(parent_key).cast("long").alias("parent"), every_share, F.lit(True).alias("is_parent"), F.lit(None).cast("long").alias("id"),
        F.lit(None).cast("timestamp").alias("updated"), F.lit(None).cast("string").alias("row"), F.col(arrived).cast("timestamp").alias("arrived"),
    )
    left, right = (side.withWatermark("arrived", "0 seconds") for side in (left, right))
    passed = (
        left.unionByName(right)
        .groupBy("parent", "share")
        .transformWithStateInPandas(statefulProcessor=Waiting(wait_ms), outputStructType=T.StructType.fromDDL(PASSED), outputMode="Append", timeMode="EventTime")
    )
    schema = T.StructType([f for f in children.schema.fields if f.name != arrived])
    return passed.select("state", F.from_json("row", schema, _JSON).alias("r")).select("state", "r.*")


def merge_waiting(passed: DataFrame, path: str, orphans: str, checkpoint: str, key: str, updated: str, buckets: int = 64):
    """Merge what is kept into a table dealt by key hash and append orphans to another, until the streams are drained."""

    def batch(df: DataFrame, number: int) -> None:
        df = df.persist()
        try:
            kept = df.where("state = 'kept'").drop("state")
            merge.merge_keyed(path, merge.newest_arrivals(kept, key, updated), key, updated, buckets)
            # A folder for each batch: a replayed one overwrites its own.
            df.where("state = 'orphan'").drop("state").write.mode("overwrite").parquet(f"{orphans}/batch={number}")
        finally:
            df.unpersist()

    spark = passed.sparkSession
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKSDB)
    try:
        return passed.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
