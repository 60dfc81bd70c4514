"""Counts, sums, cursors, percentiles and rollups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftwork.plans import paging


def sum_by(df: DataFrame, key: str, value: str, alias: str) -> DataFrame:
    return df.groupBy(key).agg(F.sum(value).alias(alias))


def child_counts(parents: DataFrame, key: str, children: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """Each parent's number of children, one column for each kind; 0 where there are none."""
    out = parents
    for name, (rows, fk) in children.items():
        counts = rows.groupBy(F.col(fk).alias("_fk")).agg(F.count(F.lit(1)).alias(name))
        out = out.join(counts, F.col(key) == F.col("_fk"), "left").drop("_fk").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def table_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(type, n) of all tables in one plan."""
    return reduce(DataFrame.unionByName, [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("type"), "n") for name, df in tables.items()])


def newest(df: DataFrame, updated: str, by: Sequence[str] = ()) -> DataFrame:
    """The last update, of all rows or of each group."""
    return df.groupBy(*by).agg(F.max(updated).alias("newest"))


def from_footers(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """(n, min_<column>, max_<column>, ...) of a Parquet table from its files' footers: no data page is read.

    The second reader of Parquet pushes counts, minima and maxima of numbers, dates and zone-less timestamps down to the scan; a session
    of its own holds these settings.  Files without statistics are an error there.
    """
    own = spark.newSession()
    own.conf.set("spark.sql.sources.useV1SourceList", "")
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    asked = [f(c).alias(f"{name}_{c}") for c in columns for name, f in (("min", F.min), ("max", F.max))]
    return own.read.parquet(path).agg(F.count(F.lit(1)).alias("n"), *asked)


def total_of(counts: Column) -> Column:
    """The sum of a map's values."""
    return F.aggregate(F.map_values(counts), F.lit(0).cast("bigint"), lambda a, v: a + v)


def percentiles(df: DataFrame, value: str, by: Sequence[str] = (), at: Sequence[int] = (50, 95, 99)) -> DataFrame:
    """Nearest-rank percentiles; nulls don't count, and a group of nulls alone has none.

    Equal values are counted before they are numbered by ranges, so no task holds or sorts all values of a group.
    """
    groups = {f"_g{k}": F.col(c) for k, c in enumerate(by)} or {"_g0": F.lit(0)}
    counted = df.select(*[c.alias(g) for g, c in groups.items()], F.col(value).alias("_v")).groupBy(*groups, "_v").agg(F.count("_v").alias("_c"))
    placed = paging.numbered(counted, [*groups, "_v"], "_at", F.col("_c"))
    sizes = placed.groupBy(*groups).agg(F.min("_at").alias("_start"), F.sum("_c").alias("_n")).select(*[F.col(g).alias(f"{g}s") for g in groups], "_start", "_n")
    found = placed.join(sizes, reduce(Column.__and__, [F.col(g).eqNullSafe(F.col(f"{g}s")) for g in groups]))
    rank = F.col("_at") - F.col("_start") + F.col("_c")
    out = found.groupBy(*groups).agg(*[F.min(F.when(rank * 100 >= F.col("_n") * p, F.col("_v"))).alias(f"p{p}") for p in at])
    return out.select(*[F.col(g).alias(c) for g, c in zip(groups, by)], *[f"p{p}" for p in at])


def rollup(df: DataFrame, by: str, measures: Sequence[Column], total: str = "TOTAL") -> DataFrame:
    """Measures of each group and of all rows together."""
    rolled = df.rollup(by).agg(F.grouping(by).alias("_all"), *measures)
    return rolled.withColumn(by, F.when(F.col("_all") == 1, F.lit(total)).otherwise(F.col(by))).drop("_all")


def orphan_groups(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).orderBy(*by)
