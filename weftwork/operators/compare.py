"""Comparing the footprints of two entities: shared, all, and shared groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def one_per_key(df: DataFrame, key: str, order: str, last: bool) -> DataFrame:
    """The first or last row of each key, by an order column; rows without key go."""
    by = F.col(order).desc() if last else F.col(order).asc()
    return df.where(F.col(key).isNotNull()).withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(by))).where("_n = 1").drop("_n")


def _side(df: DataFrame, key: str, columns: Sequence[str], mark: str) -> DataFrame:
    return df.select(F.col(key).alias(f"_{mark}"), *[F.col(c).alias(f"{c}_{mark}") for c in columns])


def shared(a: DataFrame, b: DataFrame, key: str, order: str, columns: Sequence[str]) -> DataFrame:
    """Keys on both sides: of duplicates the last of a, the first of b."""
    left = _side(one_per_key(a, key, order, True), key, columns, "a")
    right = _side(one_per_key(b, key, order, False), key, columns, "b")
    return left.join(right, F.col("_a") == F.col("_b")).withColumn(key, F.col("_a")).drop("_a", "_b")


def everything(a: DataFrame, b: DataFrame, key: str, order: str, columns: Sequence[str]) -> DataFrame:
    """All keys, flagged as shared or not; of duplicates the last of either side."""
    left = _side(one_per_key(a, key, order, True), key, columns, "a")
    right = _side(one_per_key(b, key, order, True), key, columns, "b")
    joined = left.join(right, F.col("_a") == F.col("_b"), "full_outer")
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    return joined.withColumn(key, F.coalesce("_a", "_b")).withColumn("shared", both).drop("_a", "_b")


def sides(df: DataFrame, in_a: Column, in_b: Column, key: str, order: str, columns: Sequence[str], b_last: bool = True) -> DataFrame:
    """(key, columns of a, columns of b, shared) of one table's rows that are on side a, on b, or on both: one scan and one shuffle.

    Of duplicates the last by ``order`` counts, of b the first if asked; a column of a side without the key is null.
    """
    def one(on: Column, last: bool, name: str) -> Column:
        row, at = F.when(on, F.struct(*columns)), F.when(on, F.col(order))
        return (F.max_by(row, at) if last else F.min_by(row, at)).alias(name)

    known = df.where(F.col(key).isNotNull() & (in_a | in_b))
    both = known.groupBy(key).agg(one(in_a, True, "_a"), one(in_b, b_last, "_b"))
    named = [F.col(f"_{side}")[c].alias(f"{c}_{side}") for side in "ab" for c in columns]
    return both.select(key, *named, (F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("shared"))


def shared_groups(a: DataFrame, b: DataFrame, group: str, member: str) -> DataFrame:
    """Groups on both sides with the members they share, which may be none."""
    left = a.where(F.col(group).isNotNull()).groupBy(group).agg(F.collect_set(member).alias("_a"))
    right = b.where(F.col(group).isNotNull()).groupBy(F.col(group).alias("_g")).agg(F.collect_set(member).alias("_b"))
    joined = left.join(right, F.col(group) == F.col("_g"))
    return joined.select(group, F.sort_array(F.array_intersect("_a", "_b")).alias("members"))


def bounded(ordered: DataFrame, most: int = 100) -> tuple[DataFrame, int]:
    """The first rows, and how many there are."""
    return ordered.limit(most), ordered.count()
