"""Nested selections compiled to one plan: fields, filters, order and a limit at every level of a tree of relations.

A selection names fields of an entity and selections of its relations.  A parent becomes a struct, children an array
of structs: of each parent the first ones by the level's order, at most ``MOST``.  Children are ranked before what hangs below them
is joined, tasks keep the first of each parent before anything is shuffled, and scans read the named columns and keys only.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftwork.plans.filters import FilterError, compile_filters
from weftwork.plans.schema import Catalogue, Edge, Entity

#: Children of a parent at most, asked for or not.
MOST = 1000


@dataclass(frozen=True)
class Selection:
    """``order`` names fields, descending with a minus sign; the entity's key breaks ties."""

    fields: Sequence[str] = ()
    where: Mapping[str, str] = field(default_factory=dict)
    order: Sequence[str] = ()
    first: int | None = None
    edges: Mapping[str, Selection] = field(default_factory=dict)


def _order(entity: Entity, selection: Selection) -> list[Column]:
    out = []
    for name in [*selection.order, entity.key]:
        plain = name.removeprefix("-")
        if plain not in entity.schema.names:
            raise FilterError(f"{entity.name} has no field {plain}")
        out.append(F.desc(plain) if name.startswith("-") else F.asc(plain))
    return out


def _edge(entity: Entity, name: str) -> Edge:
    if name not in entity.edges:
        raise FilterError(f"{entity.name} has no relation {name}")
    return entity.edges[name]


def _matching(catalogue: Catalogue, entity: Entity, selection: Selection, keys: Sequence[str], tier: str) -> DataFrame:
    """The level's rows with the columns that the plan needs."""
    unknown = [f for f in selection.fields if f not in entity.schema.names]
    if unknown:
        raise FilterError(f"{entity.name} has no field {', '.join(unknown)}")
    if selection.first is not None and selection.first < 0:
        raise FilterError("first is negative")
    rows = compile_filters(catalogue, entity.name, selection.where).apply(catalogue.table(entity.name, tier))
    owned = [edge.key for name in selection.edges if (edge := _edge(entity, name)).owns_key]
    needed = dict.fromkeys([*selection.fields, *[o.removeprefix("-") for o in selection.order], entity.key, *owned, *keys])
    return rows.select(*[c for c in entity.schema.names if c in needed])


def _with_edges(catalogue: Catalogue, entity: Entity, rows: DataFrame, selection: Selection, tier: str) -> tuple[DataFrame, Column]:
    """(rows with their relations joined, the struct that the selection asks for)."""
    parts = [F.col(f) for f in selection.fields]
    for name, below in selection.edges.items():
        edge, alias = _edge(entity, name), f"_edge_{name}"
        target = catalogue.entities[edge.target]
        if edge.owns_key:
            parents = _matching(catalogue, target, below, (), tier)
            parents, body = _with_edges(catalogue, target, parents, below, tier)
            found = parents.select(F.col(target.key).alias(f"_key_{name}"), body.alias(alias))
            rows = rows.join(found, F.col(edge.key) == F.col(f"_key_{name}"), "left").drop(f"_key_{name}")
            parts.append(F.col(alias).alias(name))
        else:
            sets = _children(catalogue, target, edge.key, below, alias, tier).withColumnRenamed("_fk", f"_key_{name}")
            rows = rows.join(sets, F.col(entity.key) == F.col(f"_key_{name}"), "left").drop(f"_key_{name}")
            parts.append(F.coalesce(F.col(alias), F.array().cast(sets.schema[alias].dataType)).alias(name))
    return rows, F.struct(*parts)


def _children(catalogue: Catalogue, entity: Entity, fk: str, selection: Selection, alias: str, tier: str) -> DataFrame:
    """(_fk, alias): of each parent the first children, in order."""
    rows = _matching(catalogue, entity, selection, (fk,), tier).where(F.col(fk).isNotNull())
    first = MOST if selection.first is None else min(selection.first, MOST)
    rank = F.row_number().over(Window.partitionBy(fk).orderBy(*_order(entity, selection)))
    rows = rows.withColumn("_at", rank).where(F.col("_at") <= first)
    rows, body = _with_edges(catalogue, entity, rows, selection, tier)
    # The rank is unique in a parent and leads the struct, so sorting never looks at what follows.
    items = F.array_sort(F.collect_list(F.struct("_at", body.alias("_v"))), lambda a, b: a["_at"] - b["_at"])
    return rows.groupBy(F.col(fk).alias("_fk")).agg(F.transform(items, lambda x: x["_v"]).alias(alias))


def select(catalogue: Catalogue, name: str, selection: Selection, tier: str = "public") -> DataFrame:
    """The selection's rows: a column for each field and relation."""
    entity = catalogue.entities[name]
    rows = _matching(catalogue, entity, selection, (), tier).orderBy(*_order(entity, selection))
    if selection.first is not None:
        rows = rows.limit(selection.first)
    rows, body = _with_edges(catalogue, entity, rows, selection, tier)
    return rows.select(body.alias("_row")).select("_row.*")
