"""Detail rows with parents and sets, at three depths."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftwork.operators import joins
from weftwork.plans.schema import Catalogue

LIVE = ("ok", "pending")


@dataclass(frozen=True)
class SetOf:
    """A set of children, or of what a bridge leads to (``over``)."""

    child: str
    fk: str
    drop: tuple[str, ...] = ()
    over: str = ""
    far: str = ""
    far_live: bool = False


@dataclass(frozen=True)
class Shape:
    """Parents (name, key column) and sets of an entity's detail."""

    parents: tuple[tuple[str, str], ...] = ()
    sets: tuple[SetOf, ...] = ()


SHAPES = {
    "org": Shape((), tuple(SetOf(c, "org_id", ("org_id",)) for c in ("net", "fac", "ix", "carrier", "campus"))),
    "net": Shape((("org", "org_id"),), tuple(SetOf(c, "net_id", ("net_id",)) for c in ("poc", "netfac", "netixlan"))),
    "fac": Shape((("org", "org_id"), ("campus", "campus_id"))),
    "ix": Shape((("org", "org_id"),), (SetOf("ixlan", "ix_id", ("ix_id",)), SetOf("fac", "ix_id", over="ixfac", far="fac_id"))),
    "ixlan": Shape((("ix", "ix_id"),), (SetOf("ixpfx", "ixlan_id", ("ixlan_id",)), SetOf("net", "ixlan_id", over="netixlan", far="net_id", far_live=True))),
    "carrier": Shape((("org", "org_id"),), (SetOf("carrierfac", "carrier_id"),)),
    "campus": Shape((("org", "org_id"),), (SetOf("fac", "campus_id", ("org_id",)),)),
    "netfac": Shape((("net", "net_id"), ("fac", "fac_id"))),
    "netixlan": Shape((("net", "net_id"), ("ixlan", "ixlan_id"))),
    "ixfac": Shape((("ix", "ix_id"), ("fac", "fac_id"))),
    "carrierfac": Shape((("carrier", "carrier_id"), ("fac", "fac_id"))),
    "poc": Shape((("net", "net_id"),)),
    "ixpfx": Shape((("ixlan", "ixlan_id"),)),
}


def clamp_depth(asked: int | None) -> int:
    """2 when not asked; 3 and 4 show what 2 shows."""
    return 2 if asked is None else min(max(asked, 0), 4)


def _live(catalogue: Catalogue, name: str, tier: str) -> DataFrame:
    return catalogue.table(name, tier).where(F.col("status").isin(*LIVE))


def _with_id_sets(df: DataFrame, catalogue: Catalogue, name: str, tier: str) -> DataFrame:
    for s in SHAPES[name].sets:
        found = joins.through_ids(_live(catalogue, s.over, tier), s.fk, s.far, "id") if s.over else joins.child_ids(_live(catalogue, s.child, tier), s.fk, "id")
        df = joins.with_set(df, "id", found, f"{s.child}_set")
    return df


def _with_object_sets(df: DataFrame, catalogue: Catalogue, name: str, tier: str) -> DataFrame:
    for s in SHAPES[name].sets:
        if s.over:
            targets = _live(catalogue, s.child, tier) if s.far_live else catalogue.table(s.child, tier)
            reached = joins.through(_live(catalogue, s.over, tier), s.fk, s.far, "id", targets, "id")
            found = joins.child_objects(reached, "_fk", "_order")
            found = found.withColumn("items", F.transform("items", lambda x: x.dropFields("_order", "_fk") if "_fk" in reached.columns[1:] else x.dropFields("_order")))
        else:
            found = joins.child_objects(_live(catalogue, s.child, tier), s.fk, "id", s.drop)
        df = joins.with_set(df, "id", found, f"{s.child}_set")
    return df


def expand(catalogue: Catalogue, name: str, depth: int | None = None, tier: str = "public", rows: DataFrame | None = None) -> DataFrame:
    """Detail rows of an entity: live ones, or those given.

    Depth 0 has the columns alone; 1 adds flat parents and sets of ids; 2 adds parents with
    their own sets of ids, and sets of objects without the key that leads back.
    """
    depth = clamp_depth(depth)
    df = _live(catalogue, name, tier) if rows is None else rows
    if depth == 0:
        return df
    df = _with_id_sets(df, catalogue, name, tier) if depth == 1 else _with_object_sets(df, catalogue, name, tier)
    for parent, fk in SHAPES[name].parents:
        found = catalogue.table(parent, tier)
        if depth >= 2:
            found = _with_id_sets(found, catalogue, parent, tier)
        df = joins.with_parent(df, fk, found, "id", parent)
    return df


def wire_row(df: DataFrame) -> DataFrame:
    """As written out: a null foreign key is 0, a null list is empty."""
    out = {}
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        if kind == "bigint" and f.name.endswith("_id"):
            out[f.name] = F.coalesce(F.col(f.name), F.lit(0).cast("bigint"))
        elif kind.startswith("array"):
            out[f.name] = F.coalesce(F.col(f.name), F.array().cast(kind))
    return df.withColumns(out) if out else df


def redact(df: DataFrame, column: str, gate: str, tier: str) -> DataFrame:
    """A value shows if its gate says Public, or Users and the tier is users."""
    shown = ["Public", "Users"] if tier == "users" else ["Public"]
    return df.withColumn(column, F.when(F.col(gate).isin(shown), F.col(column)))


def redact_nested(df: DataFrame, array: str, column: str, gate: str, tier: str) -> DataFrame:
    """The same for the objects of a set."""
    shown = ["Public", "Users"] if tier == "users" else ["Public"]
    return df.withColumn(array, F.transform(array, lambda x: x.withField(column, F.when(x[gate].isin(shown), x[column]))))
