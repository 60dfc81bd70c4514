"""Search over several entities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftwork.plans.filters import search_predicate
from weftwork.plans.schema import Catalogue
from weftwork.session import shared_folder

PREVIEW, PAGE, LEAST_CHARACTERS = 10, 50, 2


def hits(catalogue: Catalogue, name: str, query: str, label: str | None = None, tier: str = "public", details: bool = False) -> DataFrame:
    """(type, id, name) of an entity's rows that match, and country, city and number where details are
    asked for (empty or 0 for entities that have none); no rows for a query that is too short."""
    entity = catalogue.entities[name]
    df = catalogue.table(name, tier)
    if entity.status:
        df = df.where(F.col(entity.status).isin("ok", "pending")) if "status" in df.columns else df
    found = search_predicate(entity, query) if len(query.strip()) >= LEAST_CHARACTERS else F.lit(False)
    more = []
    if details:
        more = [(F.coalesce(c, F.lit("")) if c in df.columns else F.lit("")).alias(c) for c in ("country", "city")]
        more.append((F.coalesce(F.col(entity.number).cast("bigint"), F.lit(0)) if entity.number else F.lit(0)).cast("bigint").alias("number"))
    return df.where(found).select(F.lit(name).alias("type"), F.col(entity.key).cast("bigint").alias("id"), F.col(label or entity.search[0]).alias("name"), *more)


def grouped(catalogue: Catalogue, names: list[str], query: str, preview: int = PREVIEW, tier: str = "public") -> DataFrame:
    """The first hits of each entity, by name and id, with each one's total.

    Entities are scanned once: their hits, a few narrow columns, are stored, and firsts and totals come from there.
    """
    found = [hits(catalogue, name, query, tier=tier).withColumn("place", F.lit(place)) for place, name in enumerate(names)]
    every = reduce(DataFrame.unionByName, found)
    path = shared_folder(every.sparkSession, "hits")
    every.write.parquet(path)
    stored = every.sparkSession.read.schema(every.schema).parquet(path)
    # Tasks keep the first rows of each type before anything is shuffled.
    first = stored.withColumn("rank", F.row_number().over(Window.partitionBy("type").orderBy("name", "id"))).where(F.col("rank") <= preview)
    totals = stored.groupBy("type").agg(F.count(F.lit(1)).alias("total"))
    return first.join(totals, "type").select("type", "id", "name", "total", "place", "rank")


def page(catalogue: Catalogue, name: str, query: str, offset: int = 0, size: int = PAGE, tier: str = "public") -> tuple[DataFrame, int]:
    """A page of one entity's hits and their total."""
    found = hits(catalogue, name, query, tier=tier)
    ordered = found.orderBy("name", "id")
    return (ordered.offset(offset) if offset else ordered).limit(size), found.count()


def completions(catalogue: Catalogue, names: list[str], query: str, most: int = 20, only: str | None = None) -> DataFrame:
    """Ids to complete a query with: at most ``most`` of each entity, or of one alone."""
    asked = [n for n in names if only is None or n == only]
    if not asked:
        return hits(catalogue, names[0], "").select("type", "id", F.lit(0).alias("place"), F.lit(0).alias("rank"))
    return grouped(catalogue, asked, query, preview=most).select("type", "id", "place", "rank")
