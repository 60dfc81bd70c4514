"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Each shard owns many points (virtual nodes) on a ring of hashes.  A key goes to
the shard of the next point clockwise.  A shard that is full, at its bound, passes
keys on: they continue clockwise to the next shard with room.  Bounds are the
number of rows divided evenly, so the counts of any two shards differ by one at
most, and adding a shard moves only the keys of its own arcs and the overflow.

How it runs: keys are counted by arc (the stretch before one virtual node), a table
whose size depends on the number of virtual nodes alone.  From these counts the
ring is walked once, giving for every arc the ranges of ranks that stay and that
go on.  Rows then get their rank within their arc by one window, and the ranges tell
shard and slot.  Large arcs are split by a salt of the row's content, into as many parts as their rows
ask for, so that a key that repeats over many texts is spread over many windows.  Equal
rows are counted before they are shuffled: a window sees one of them, with their number, and
the ranks they take are dealt out afterwards.

Defined results: a null text has no bytes; a null ``doc_id`` is a key like another;
repeated rows are rows of their own, in any order among themselves; of a text, however long, only its
length and checksum go on; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftwork.llm import common

#: Hashes live on a ring of this many positions.
RING = 1 << 31


def ring_points(n_shards: int, virtual_nodes: int) -> list[tuple[int, int]]:
    """The (position, shard) points of the ring, clockwise.

    A shard's points depend on its number alone, so one more shard leaves all others
    where they are.
    """
    points = []
    for shard in range(n_shards):
        for v in range(virtual_nodes):
            digest = hashlib.sha256(f"shard {shard} node {v}".encode()).digest()
            points.append((int.from_bytes(digest[:4], "big") % RING, shard))
    return sorted(points)


def walk(arcs: list[int], owners: list[int], n_shards: int) -> list[tuple[int, int, int, int]]:
    """Ranges (arc, first rank, end rank, shard) for the number of keys of each arc.

    Own keys come first: every arc fills its own shard, in ring order, up to the
    bound.  What is left goes on clockwise, arc by arc, to shards that still have room.
    The bounds add up to the number of keys, so all keys find a place.
    """
    total = sum(arcs)
    bound = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    room, ranges, left = list(bound), [], []
    for arc, (keys, shard) in enumerate(zip(arcs, owners)):
        stay = min(keys, room[shard])
        room[shard] -= stay
        if stay:
            ranges.append((arc, 0, stay, shard))
        if keys > stay:
            left.append((arc, stay, keys))
    for arc, first, end in left:
        at = arc
        while first < end:
            at = (at + 1) % len(owners)
            take = min(end - first, room[owners[at]])
            if take:
                ranges.append((arc, first, first + take, owners[at]))
                room[owners[at]] -= take
                first += take
    return ranges


def _split(ranges, cells: dict[int, list[tuple[int, int]]]):
    """Cut the ranges of an arc at its salts: (arc, salt, first, end, shard, slot)."""
    used: dict[int, int] = {}
    starts = {arc: [*_running(parts)] for arc, parts in cells.items()}
    for arc, first, end, shard in ranges:
        for salt, low, high in starts[arc]:
            a, b = max(first, low), min(end, high)
            if a < b:
                slot = used.get(shard, 0)
                used[shard] = slot + b - a
                yield arc, salt, a - low, b - low, shard, slot


def _running(parts):
    low = 0
    for salt, n in sorted(parts):
        yield salt, low, low + n
        low += n


def _arc(points: list[tuple[int, int]]):
    """The arc of a position: the first point at or after it; past the last, the first."""
    edges = np.array([p for p, _ in points], np.int64)

    @F.pandas_udf("long")
    def arc(position: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, position.to_numpy()) % len(edges))

    return arc


_PLAN = T.StructType([T.StructField(c, T.LongType()) for c in ("arc", "salt", "first_rank", "end_rank", "shard", "slot_base")])


def assign(documents: DataFrame, n_shards: int = 24, virtual_nodes: int = 128, window_rows: int = 500_000, most_windows: int = 65_536) -> DataFrame:
    """doc_id, size (UTF-8 bytes + 8), text_crc32, shard and slot of every row.

    A window holds about ``window_rows`` different rows, or more where ``most_windows`` windows wouldn't do.
    Two tables meet here: one slim row for each different document, and the plan, of at most about
    ``2 * n_shards * virtual_nodes + most_windows`` rows whatever the input's size, which is broadcast.
    """
    spark: SparkSession = documents.sparkSession
    common.ship_package(spark)
    points = ring_points(n_shards, virtual_nodes)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    slim = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    position = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), F.lit(RING))
    counted = slim.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("n")).withColumn("arc", _arc(points)(position))
    counted = common.materialize(counted.withColumn("position", position), "sharding")
    of_arc = {row["arc"]: row["rows"] for row in counted.groupBy("arc").agg(F.sum("n").alias("rows")).toLocalIterator()}
    per_window = max(window_rows, -(-sum(of_arc.values()) // most_windows))
    salts = [-(-of_arc.get(arc, 0) // per_window) or 1 for arc in range(len(points))]
    content = F.xxhash64("doc_id", "text_crc32", "size")
    salt = F.pmod(content, F.element_at(F.lit(salts), F.col("arc").cast("int") + 1)) if max(salts) > 1 else F.lit(0)
    placed = counted.withColumn("salt", salt.cast("long"))
    cells: dict[int, list[tuple[int, int]]] = {}
    for row in placed.groupBy("arc", "salt").agg(F.sum("n").alias("rows")).toLocalIterator():
        cells.setdefault(row["arc"], []).append((row["salt"], row["rows"]))
    arcs = [sum(n for _, n in cells.get(a, [])) for a in range(len(points))]
    plan = list(_split(walk(arcs, [s for _, s in points], n_shards), cells))
    plan_df = F.broadcast(spark.createDataFrame(plan, _PLAN))
    order = Window.partitionBy("arc", "salt").orderBy("position", "doc_id", "text_crc32", "size")
    # A row's copies take the ranks from rank to end; a range of the plan takes those it covers.
    ranked = placed.withColumn("end", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("rank", F.col("end") - F.col("n"))
    joined = ranked.alias("r").join(
        plan_df.alias("p"),
        (F.col("r.arc") == F.col("p.arc")) & (F.col("r.salt") == F.col("p.salt")) & (F.col("r.end") > F.col("p.first_rank")) & (F.col("r.rank") < F.col("p.end_rank")),
    )
    low = F.greatest("r.rank", "p.first_rank")
    parts = joined.select(
        "r.doc_id",
        "r.size",
        "r.text_crc32",
        F.col("p.shard").cast("int").alias("shard"),
        (F.col("p.slot_base") + low - F.col("p.first_rank")).alias("first"),
        (F.least("r.end", "p.end_rank") - low).alias("n"),
    )
    return _copies(parts)


def _copies(parts: DataFrame, at_once: int = 100_000) -> DataFrame:
    """A row for each of the ``n`` slots from ``first`` on; long runs are dealt to all tasks first."""
    given = ["doc_id", "size", "text_crc32", "shard"]
    slots = lambda df: df.select(*given, F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)).alias("slot"))
    long = parts.where(F.col("n") > at_once)
    starts = long.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(at_once).cast("long"))))
    cut = starts.select(*given, (F.col("first") + F.col("at")).alias("first"), F.least(F.col("n") - F.col("at"), F.lit(at_once)).alias("n")).repartition("first")
    return slots(parts.where(F.col("n") <= at_once)).union(slots(cut))
