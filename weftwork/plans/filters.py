"""The key and value filter language, compiled to DataFrame predicates."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftwork.functions.text import fold, fold_column
from weftwork.plans.schema import Catalogue, Entity, visible_rows

OPERATORS = {"contains", "icontains", "startswith", "istartswith", "iexact", "in", "lt", "gt", "lte", "gte"}
RESERVED = {"limit", "skip", "depth", "since", "q", "fields"}
MOST_HOPS = 2
#: Longer value lists are joined instead of held in the plan.
MOST_LITERALS = 10_000


class FilterError(ValueError):
    """A value that doesn't fit its field or operator."""


@dataclass
class Compiled:
    """A row predicate, semi-joins, and what to say about the keys."""

    predicates: list[Column] = field(default_factory=list)
    joins: list[Callable[[DataFrame], DataFrame]] = field(default_factory=list)
    unknown: list[str] = field(default_factory=list)
    empty: bool = False

    def apply(self, df: DataFrame) -> DataFrame:
        if self.empty:
            return df.where(F.lit(False))
        if self.predicates:
            df = df.where(reduce(lambda a, b: a & b, self.predicates))
        for join in self.joins:
            df = join(df)
        return df


def parse_key(key: str) -> tuple[list[str], str, str]:
    """(relations, field, operator) of a key; the operator is empty for equality."""
    parts = key.split("__")
    op = parts.pop() if len(parts) > 1 and parts[-1] in OPERATORS else ""
    if not all(parts):
        return [], "", ""
    return parts[:-1], parts[-1], {"contains": "icontains", "startswith": "istartswith"}.get(op, op)


def location_operator(name: str, op: str, value: str) -> str:
    """Bare address, city and state keys, and countries that aren't codes, match inside."""
    if op or name not in ("address1", "city", "state", "country"):
        return op
    return op if name == "country" and len(value.encode()) == 2 else "icontains"


def parse_bool(text: str) -> bool:
    if (low := text.lower()) in ("1", "true"):
        return True
    if low in ("0", "false"):
        return False
    raise FilterError(f"not a truth value: {text!r}")


def _parse_number(text: str, kind: Callable[[str], Any], pattern: str) -> Any:
    if not re.fullmatch(pattern, text, re.ASCII):
        raise FilterError(f"not a number: {text!r}")
    return kind(text)


def parse_time(text: str) -> tuple[datetime, bool]:
    """(moment in UTC, whether only a date was given); epoch seconds, dates and date-times."""
    if re.fullmatch(r"[+-]?\d+", text, re.ASCII):
        return datetime(1970, 1, 1) + timedelta(seconds=int(text)), False
    try:
        if re.fullmatch(r"\d{4}-\d\d-\d\d", text, re.ASCII):
            return datetime.fromisoformat(text), True
        if re.fullmatch(r"\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)?", text, re.ASCII):
            moment = datetime.fromisoformat(text)
            return (moment.astimezone(timezone.utc).replace(tzinfo=None) if moment.tzinfo else moment), False
    except ValueError:
        pass
    raise FilterError(f"not a time: {text!r}")


def parse_value(text: str, kind: str) -> Any:
    if kind == "int":
        return _parse_number(text, int, r"[+-]?\d+")
    if kind == "float":
        return _parse_number(text, float, r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?")
    if kind == "bool":
        return parse_bool(text)
    if kind == "time":
        return parse_time(text)[0]
    return text


def moment_literal(value: datetime, type_name: str) -> Column:
    """A literal of the column's own time type, so that no cast hides the column."""
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz" if type_name == "timestamp_ntz" else "timestamp" if type_name == "timestamp" else "timestamp_ntz")


def _folded(entity: Entity, name: str) -> Column:
    """The stored folded copy, or the folded column where there is none."""
    stored = f"{name}_fold"
    return F.col(stored) if stored in entity.schema.names else fold_column(F.col(name))


def local_predicate(entity: Entity, name: str, op: str, value: str, bare: bool = True) -> Column | tuple[Column, list[Any]] | None:
    """The predicate of one key on one of the entity's own fields.

    None: an empty value list, which empties the whole result.  A pair (column, values): a
    list too long for the plan.  ``bare``: the key named no relation.
    """
    kind, folded = entity.fields[name], name in entity.folded
    op = location_operator(name, op, value) if bare else op
    column = F.col(name)
    type_name = entity.schema[name].dataType.simpleString()
    if op in ("icontains", "istartswith"):
        if kind != "string":
            raise FilterError(f"{op} needs a text field, {name} isn't one")
        text, probe = (_folded(entity, name), fold(value)) if folded else (F.lower(column), value.lower())
        return F.contains(text, F.lit(probe)) if op == "icontains" else F.startswith(text, F.lit(probe))
    if op == "in":
        if value == "":
            return None
        parts = [p.strip() for p in value.split(",")]
        if kind == "string":
            text = _folded(entity, name) if folded else F.lower(column)
            probes: list[Any] = [(fold(p) if folded else p.lower()) for p in parts]
        else:
            text, probes = column, [parse_value(p, kind) for p in parts]
        if len(probes) > MOST_LITERALS:
            return text, sorted(set(probes))
        if kind == "time":
            probes = [moment_literal(p, type_name) for p in probes]
        return text.isin(probes)
    if op in ("lt", "gt", "lte", "gte"):
        if kind == "time":
            moment, day = parse_time(value)
            if day and op in ("gt", "lte"):
                moment += timedelta(days=1) - timedelta(milliseconds=1)
            probe = moment_literal(moment, type_name)
        else:
            probe = F.lit(parse_value(value, kind))
        return {"lt": column < probe, "gt": column > probe, "lte": column <= probe, "gte": column >= probe}[op]
    if kind == "string":
        return _folded(entity, name) == fold(value) if folded else F.lower(column) == value.lower()
    if kind == "time":
        moment, day = parse_time(value)
        if day:
            return (column >= moment_literal(moment, type_name)) & (column < moment_literal(moment + timedelta(days=1), type_name))
        return column == moment_literal(moment, type_name)
    return column == F.lit(parse_value(value, kind))


def _values_join(column: Column, values: list[Any]) -> Callable[[DataFrame], DataFrame]:
    def join(df: DataFrame) -> DataFrame:
        listed = df.sparkSession.createDataFrame([(v,) for v in values], ["_listed"])
        return df.join(listed, column == F.col("_listed"), "left_semi")

    return join


def _select(df: DataFrame, entity: Entity, name: str, op: str, value: str) -> DataFrame | None:
    """Related rows that meet one predicate; None for an empty value list."""
    made = local_predicate(entity, name, op, value, bare=False)
    if made is None:
        return None
    return _values_join(*made)(df) if isinstance(made, tuple) else df.where(made)


def hop(parents: DataFrame, entity: Entity, edge_name: str, target: Entity, matching: DataFrame) -> DataFrame:
    """Parents that have a matching row over an edge: a left semi-join on the key."""
    edge = entity.edges[edge_name]
    on, column = (edge.key, target.key) if edge.owns_key else (entity.key, edge.key)
    keys = matching.select(F.col(column).alias("_key"))
    return parents.join(keys, F.col(on) == F.col("_key"), "left_semi")


def traversal(catalogue: Catalogue, entity: Entity, relations: list[str], name: str, op: str, value: str, tier: str):
    """A semi-join chain over one or two edges.

    None: an edge or field is unknown.  False: the value list is empty.  The visibility
    gate holds for the leaf only, and no status is asked of any row on the way.
    """
    path = [entity]
    for relation in relations:
        edge = path[-1].edges.get(relation)
        if edge is None or edge.target not in catalogue.entities:
            return None
        path.append(catalogue.entities[edge.target])
    leaf = path[-1]
    if name not in leaf.fields:
        return None
    matching = _select(visible_rows(catalogue.tables[leaf.name], leaf, tier), leaf, name, op, value)
    if matching is None:
        return False

    def join(df: DataFrame) -> DataFrame:
        found = matching
        for at in range(len(relations) - 1, 0, -1):
            found = hop(catalogue.tables[path[at].name], path[at], relations[at], path[at + 1], found)
        return hop(df, entity, relations[0], path[1], found)

    return join


def compile_filters(catalogue: Catalogue, name: str, params: Mapping[str, str | Iterable[str]], tier: str = "public") -> Compiled:
    """All keys in conjunction; of repeated values the last counts.

    Unknown keys are ignored and listed; a value that doesn't fit a known field is an error.
    """
    entity, out = catalogue.entities[name], Compiled()
    for key, given in params.items():
        values = [given] if isinstance(given, str) else list(given)
        if not values or key in RESERVED:
            continue
        value = values[-1]
        relations, field_name, op = parse_key(key)
        if not relations and field_name in RESERVED:
            continue
        if not field_name or len(relations) > MOST_HOPS:
            out.unknown.append(key)
            continue
        try:
            if relations:
                made = traversal(catalogue, entity, relations, field_name, op, value, tier)
                if made is None:
                    out.unknown.append(key)
                elif made is False:
                    out.empty = True
                else:
                    out.joins.append(made)
            elif field_name not in entity.fields:
                out.unknown.append(key)
            else:
                local = local_predicate(entity, field_name, op, value)
                if local is None:
                    out.empty = True
                elif isinstance(local, tuple):
                    out.joins.append(_values_join(*local))
                else:
                    out.predicates.append(local)
        except FilterError as error:
            raise FilterError(f"filter {key}: {error}") from error
    return out


def status_predicate(entity: Entity, since: bool) -> Column | None:
    """Live rows in plain lists; live and deleted ones, and pending campuses, since a moment."""
    if entity.status is None:
        return None
    if not since:
        return F.col(entity.status) == "ok"
    return F.col(entity.status).isin(["ok", "deleted", *(["pending"] if entity.keeps_pending else [])])


def search_predicate(entity: Entity, text: str) -> Column | None:
    """Any of the search fields holds the text, or the number field is the literal."""
    from weftwork.functions.text import parse_asn

    text = text.strip()
    if not text:
        return None
    parts = [F.contains(F.lower(F.col(c)), F.lit(text.lower())) for c in entity.search]
    if entity.number and (number := parse_asn(text)) is not None:
        parts.append(F.col(entity.number) == number)
    return reduce(lambda a, b: a | b, parts) if parts else None
