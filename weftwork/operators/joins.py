"""Joins over edges: parents, children, through-joins, existence and orphans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: rows of keys up to which Spark may broadcast them; one takes 35 to 50 bytes on the driver.
BROADCAST_ROWS = 500_000


def bounded(keys: DataFrame, rows: int | None = None) -> DataFrame:
    """Keys to join with, which Spark is kept from broadcasting where they are many.

    Spark guesses their size from the compressed files, by the share that the key has in the declared width of a row; for a
    wide table, mostly nulls, that is far less than what the driver needs to build them.  They are counted unless
    their number is given, which of a Parquet table reads footers only.
    """
    return keys if (keys.count() if rows is None else rows) <= BROADCAST_ROWS else keys.hint("merge")


def with_parent(df: DataFrame, fk: str, parents: DataFrame, key: str, alias: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Left join to one parent, as a struct; null where there is none."""
    body = F.struct(*(columns or parents.columns))
    return df.join(parents.select(F.col(key).alias("_parent"), body.alias(alias)), F.col(fk) == F.col("_parent"), "left").drop("_parent")


def child_objects(children: DataFrame, fk: str, key: str, drop: Sequence[str] = ()) -> DataFrame:
    """(_fk, items): a parent's children as structs in key order, without the dropped columns."""
    kept = [c for c in children.columns if c not in drop and c != key]
    item = F.struct(F.col(key), *kept)
    # The key is unique and leads the struct, so sorting never looks at later fields.
    sorted_items = F.transform(F.array_sort(F.collect_list(F.struct(F.col(key).alias("_k"), item.alias("_v"))), lambda a, b: F.when(a["_k"] < b["_k"], -1).when(a["_k"] > b["_k"], 1).otherwise(0)), lambda x: x["_v"])
    return children.groupBy(F.col(fk).alias("_fk")).agg(sorted_items.alias("items"))


def child_ids(children: DataFrame, fk: str, key: str) -> DataFrame:
    """(_fk, items): a parent's child keys, ascending."""
    return children.groupBy(F.col(fk).alias("_fk")).agg(F.sort_array(F.collect_list(key)).alias("items"))


def with_set(df: DataFrame, key: str, sets: DataFrame, alias: str) -> DataFrame:
    """Attach a set by key; parents without children get an empty one."""
    kind = sets.schema["items"].dataType.simpleString()
    named = sets.withColumnRenamed("items", alias)
    return df.join(named, F.col(key) == F.col("_fk"), "left").drop("_fk").withColumn(alias, F.coalesce(F.col(alias), F.array().cast(kind)))


def through(bridge: DataFrame, near_fk: str, far_fk: str, bridge_key: str, targets: DataFrame, target_key: str) -> DataFrame:
    """(_fk, _order, target columns): targets reached over a bridge, duplicates kept."""
    links = bridge.select(F.col(near_fk).alias("_fk"), F.col(bridge_key).alias("_order"), F.col(far_fk).alias("_far"))
    return links.join(targets, F.col("_far") == F.col(target_key)).drop("_far")


def through_ids(bridge: DataFrame, near_fk: str, far_fk: str, bridge_key: str) -> DataFrame:
    """(_fk, items): far keys in the order of the bridge rows, duplicates kept."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(bridge_key).alias("k"), F.col(far_fk).alias("f"))))
    return bridge.groupBy(F.col(near_fk).alias("_fk")).agg(F.transform(pairs, lambda p: p["f"]).alias("items"))


def with_existing_parent(df: DataFrame, fk: str, parents: DataFrame, key: str = "id") -> DataFrame:
    return df.join(parents.select(F.col(key).alias("_p")), F.col(fk) == F.col("_p"), "left_semi")


def orphans(df: DataFrame, fk: str, parents: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose key names no parent; null names none either."""
    return df.join(parents.select(F.col(key).alias("_p")), F.col(fk) == F.col("_p"), "left_anti")


def null_on_miss(df: DataFrame, fk: str, parents: DataFrame, key: str = "id") -> DataFrame:
    """An optional key becomes null where its parent is missing."""
    hit = parents.select(F.col(key).alias("_p")).distinct()
    return df.join(hit, F.col(fk) == F.col("_p"), "left").withColumn(fk, F.when(F.col("_p").isNotNull(), F.col(fk))).drop("_p")


def missing_parents(df: DataFrame, fk: str, parents: DataFrame, key: str = "id") -> DataFrame:
    """Distinct keys that no parent has."""
    return df.where(F.col(fk).isNotNull()).select(F.col(fk).alias(key)).distinct().join(parents.select(key), key, "left_anti")


def exists(df: DataFrame) -> bool:
    return not df.isEmpty()


def fetch_by_ids(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return df.join(ids.select(key).distinct(), key, "left_semi")


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    from pyspark.sql import Window

    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(rank) <= n)
