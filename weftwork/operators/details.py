"""Detail rows with counts and sums, and the lists that belong to a detail, by page."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftwork.operators import joins
from weftwork.plans.query import list_order
from weftwork.plans.schema import Catalogue

LIVE = ("ok", "pending")
FRAGMENT = 100


@dataclass(frozen=True)
class Relation:
    """Rows of ``child`` whose ``fk`` names the entity, or names a ``via`` row that does.

    ``order``: its own columns; ``by``: (entity, key column) of the related row whose name comes first.
    """

    child: str
    fk: str
    order: tuple[str, ...] = ()
    via: str = ""
    via_fk: str = ""
    by: tuple[str, str] | None = None


RELATIONS: dict[tuple[str, str], Relation] = {
    ("net", "exchanges"): Relation("netixlan", "net_id", ("name",)),
    ("net", "facilities"): Relation("netfac", "net_id", ("name",)),
    ("net", "contacts"): Relation("poc", "net_id", ("role", "name")),
    ("ix", "participants"): Relation("netixlan", "ixlan_id", ("asn",), "ixlan", "ix_id"),
    ("ix", "facilities"): Relation("ixfac", "ix_id", ("name",)),
    ("ix", "prefixes"): Relation("ixpfx", "ixlan_id", ("prefix",), "ixlan", "ix_id"),
    ("fac", "networks"): Relation("netfac", "fac_id", by=("net", "net_id")),
    ("fac", "exchanges"): Relation("ixfac", "fac_id", by=("ix", "ix_id")),
    ("fac", "carriers"): Relation("carrierfac", "fac_id", by=("carrier", "carrier_id")),
    ("org", "networks"): Relation("net", "org_id", ("asn",)),
    ("org", "exchanges"): Relation("ix", "org_id", ("name",)),
    ("org", "facilities"): Relation("fac", "org_id", ("name",)),
    ("org", "campuses"): Relation("campus", "org_id", ("name",)),
    ("org", "carriers"): Relation("carrier", "org_id", ("name",)),
    ("campus", "facilities"): Relation("fac", "campus_id", ("name",)),
    ("carrier", "facilities"): Relation("carrierfac", "carrier_id", ("name",)),
}


def live(catalogue: Catalogue, name: str, tier: str = "public") -> DataFrame:
    return catalogue.table(name, tier).where(F.col("status").isin(*LIVE))


def related_rows(catalogue: Catalogue, entity: str, relation: str, tier: str = "public") -> DataFrame:
    """Live rows of a relation, for all owners at once, with ``owner`` and, where rows
    are ordered by it, ``related_name``."""
    r = RELATIONS[entity, relation]
    rows = live(catalogue, r.child, tier)
    if r.via:
        between = live(catalogue, r.via, tier).select(F.col("id").alias("_via"), F.col(r.via_fk).alias("owner"))
        rows = rows.join(between, F.col(r.fk) == F.col("_via")).drop("_via")
    else:
        rows = rows.where(F.col(r.fk).isNotNull()).withColumn("owner", F.col(r.fk))
    if r.by:
        other, key = r.by
        names = catalogue.table(other, tier).select(F.col("id").alias("_other"), F.col("name").alias("related_name"))
        rows = rows.join(names, F.col(key) == F.col("_other"), "left").drop("_other")
    return rows


def relation_order(entity: str, relation: str) -> list[Column]:
    """The order of a relation's list; the id decides between equal rows."""
    r = RELATIONS[entity, relation]
    return [*([F.col("related_name")] if r.by else []), *[F.col(c) for c in r.order], F.col("id")]


def fragment(catalogue: Catalogue, entity: str, relation: str, owner: int, offset: int = 0, size: int = FRAGMENT, tier: str = "public") -> DataFrame:
    """A page of a relation of one owner, with one row more to tell whether there is a next page."""
    ordered = related_rows(catalogue, entity, relation, tier).where(F.col("owner") == owner).orderBy(*relation_order(entity, relation))
    return (ordered.offset(offset) if offset else ordered).limit(size + 1)


def _counted(df: DataFrame, rows: DataFrame, alias: str, value: Column | None = None) -> DataFrame:
    """Add a count, or a sum, of the rows of each owner; 0 where there are none."""
    sums = rows.groupBy("owner").agg((F.count(F.lit(1)) if value is None else F.sum(value)).alias(alias))
    return df.join(sums, F.col("id") == F.col("owner"), "left").drop("owner").withColumn(alias, F.coalesce(alias, F.lit(0)))


def _named(df: DataFrame, catalogue: Catalogue, parent: str, fk: str) -> DataFrame:
    """Add the parent's name, or empty, as ``<parent>_name``; the stored copy gives way."""
    names = catalogue.tables[parent].select(F.col("id").alias("_p"), F.col("name").alias("_name"))
    return df.join(names, F.col(fk) == F.col("_p"), "left").withColumn(f"{parent}_name", F.coalesce("_name", F.lit(""))).drop("_p", "_name")


def details(catalogue: Catalogue, entity: str, tier: str = "public") -> DataFrame:
    """Detail rows of all live rows of an entity; filter by key for one.

    Networks and exchanges have the bandwidth of their ports added up; networks count contacts,
    exchanges prefixes, organisations what is theirs, and campuses facilities.
    """
    df = live(catalogue, entity, tier)
    rows = lambda relation: related_rows(catalogue, entity, relation, tier)
    if entity != "org" and "org_id" in df.columns:
        df = _named(df, catalogue, "org", "org_id")
    if entity == "net":
        df = _counted(_counted(df, rows("contacts"), "poc_count"), rows("exchanges"), "aggregate_bandwidth", F.col("speed"))
    elif entity == "ix":
        df = _counted(_counted(df, rows("prefixes"), "prefix_count"), rows("participants"), "aggregate_bandwidth", F.col("speed"))
    elif entity == "fac":
        df = _named(df, catalogue, "campus", "campus_id")
        placed = (F.coalesce("latitude", F.lit(0.0)) != 0) | (F.coalesce("longitude", F.lit(0.0)) != 0)
        set_both = F.col("latitude").isNotNull() & F.col("longitude").isNotNull() & placed
        df = df.withColumn("latitude", F.when(set_both, F.col("latitude"))).withColumn("longitude", F.when(set_both, F.col("longitude")))
    elif entity == "org":
        for relation in ("networks", "exchanges", "facilities", "campuses", "carriers"):
            df = _counted(df, rows(relation), f"{relation}_count")
    elif entity == "campus":
        df = _counted(df, rows("facilities"), "facilities_count")
    return df


def eager_load(catalogue: Catalogue, entity: str, most: int = 1000) -> DataFrame:
    """Rows with all edges: parents as structs, children newest first, at most ``most`` of each parent."""
    e = catalogue.entities[entity]
    df = catalogue.tables[entity]
    for name, edge in sorted(e.edges.items()):
        target = catalogue.entities[edge.target]
        rows = catalogue.tables[edge.target]
        if edge.owns_key:
            df = joins.with_parent(df, edge.key, rows, target.key, name)
        else:
            top = joins.top_per_group(rows.where(F.col(edge.key).isNotNull()), [edge.key], list_order(target, False), most, "_rank")
            sets = joins.child_objects(top, edge.key, "_rank").withColumn("items", F.transform("items", lambda x: x.dropFields("_rank")))
            df = joins.with_set(df, e.key, sets, f"{name}_set")
    return df


def sorted_list(catalogue: Catalogue, entity: str, by: str, descending: bool = False) -> DataFrame:
    """Rows by a field, a parent's field (``org.updated``), the number of children
    (``net.count``), their sum of a field (``netixlan.speed.sum``) or at random (``random``)."""
    e = catalogue.entities[entity]
    df, way = catalogue.tables[entity], (lambda c: c.desc() if descending else c.asc())
    if by == "random":
        return df.orderBy(F.rand())
    head, *rest = by.split(".")
    if not rest:
        ties = [c for c in (e.updated, e.created, e.key) if c and c != by] if by == e.updated else [e.key]
        return df.orderBy(way(F.col(by)), *[way(F.col(c)) for c in ties])
    edge = e.edges[head]
    rows = catalogue.tables[edge.target]
    if edge.owns_key:
        joined = joins.with_parent(df, edge.key, rows, catalogue.entities[edge.target].key, "_parent_row")
        return joined.orderBy(way(F.col(f"_parent_row.{rest[0]}")), way(F.col(e.key))).drop("_parent_row")
    value = F.count(F.lit(1)) if rest == ["count"] else F.sum(rest[0])
    sums = rows.groupBy(F.col(edge.key).alias("_fk")).agg(value.alias("_n"))
    joined = df.join(sums, F.col(e.key) == F.col("_fk"), "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    return joined.orderBy(way(F.col("_n")), way(F.col(e.key))).drop("_fk", "_n")
