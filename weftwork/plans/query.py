"""List queries: filters, status, since, search, order, paging and projection."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftwork.plans.filters import Compiled, FilterError, compile_filters, moment_literal, search_predicate, status_predicate
from weftwork.plans.schema import Catalogue, Entity


@dataclass(frozen=True)
class QueryOptions:
    limit: int = 0
    skip: int = 0
    since: datetime | None = None
    search: str = ""
    fields: tuple[str, ...] = ()


def _first(params: Mapping[str, str | Iterable[str]], key: str) -> str:
    given = params.get(key, "")
    return given if isinstance(given, str) else (list(given) or [""])[0]


def parse_options(params: Mapping[str, str | Iterable[str]]) -> QueryOptions:
    """Limit and skip aren't negative, 0 is unlimited; a since of 0 or less counts for nothing."""

    def number(key: str) -> int:
        text = _first(params, key)
        if text == "":
            return 0
        if not re.fullmatch(r"\+?\d+", text, re.ASCII):
            raise FilterError(f"{key} needs to be a number that isn't negative: {text!r}")
        return int(text)

    since, text = None, _first(params, "since")
    if text:
        if not re.fullmatch(r"[+-]?\d+", text, re.ASCII):
            raise FilterError(f"since needs epoch seconds: {text!r}")
        since = datetime(1970, 1, 1) + timedelta(seconds=int(text)) if int(text) > 0 else None
    fields = tuple(f.strip() for f in _first(params, "fields").split(",") if f.strip())
    return QueryOptions(number("limit"), number("skip"), since, _first(params, "q"), fields)


def list_order(entity: Entity, since: bool) -> list[Column]:
    """Newest first, by update, creation and key; since a moment, oldest update first."""
    if since:
        return [F.col(entity.updated).asc(), F.col(entity.key).asc()]
    stamps = [c for c in dict.fromkeys((entity.updated, entity.created)) if c]
    return [*[F.col(c).desc() for c in stamps], F.col(entity.key).desc()]


def paged(df: DataFrame, limit: int, skip: int = 0) -> DataFrame:
    if skip:
        df = df.offset(skip)
    return df.limit(limit) if limit else df


def project(df: DataFrame, fields: Iterable[str], key: str = "id") -> DataFrame:
    """The key, the fields that exist, nested sets and expanded objects."""
    want = {f.strip() for f in fields}
    if not want:
        return df
    kept = [f.name for f in df.schema.fields if f.name == key or f.name in want or f.name.endswith("_set") or isinstance(f.dataType, T.StructType)]
    return df.select(*kept)


def matching(catalogue: Catalogue, name: str, params: Mapping[str, str | Iterable[str]], tier: str = "public", with_status: bool = True) -> tuple[DataFrame, QueryOptions, Compiled]:
    """All rows that a list query counts, before order and paging."""
    entity, options = catalogue.entities[name], parse_options(params)
    compiled = compile_filters(catalogue, name, params, tier)
    df = compiled.apply(catalogue.table(name, tier))
    if options.since is not None and entity.updated:
        df = df.where(F.col(entity.updated) > moment_literal(options.since, entity.schema[entity.updated].dataType.simpleString()))
    if (found := search_predicate(entity, options.search)) is not None:
        df = df.where(found)
    if with_status and (status := status_predicate(entity, options.since is not None)) is not None:
        df = df.where(status)
    return df, options, compiled


def list_rows(catalogue: Catalogue, name: str, params: Mapping[str, str | Iterable[str]], tier: str = "public", with_status: bool = True) -> DataFrame:
    """A list query as one DataFrame: order and limit become a top-k, projection prunes the scan."""
    df, options, _ = matching(catalogue, name, params, tier, with_status)
    entity = catalogue.entities[name]
    df = df.orderBy(*list_order(entity, options.since is not None))
    return project(paged(df, options.limit, options.skip), options.fields, entity.key)


def served_rows(total: int, options: QueryOptions) -> int:
    served = max(total - options.skip, 0)
    return min(served, options.limit) if options.limit else served


def get_row(catalogue: Catalogue, name: str, key: int, tier: str = "public", any_status: bool = False) -> DataFrame:
    """Point lookup; tombstones show only where any status does."""
    entity = catalogue.entities[name]
    df = catalogue.table(name, tier).where(F.col(entity.key) == key)
    if any_status or entity.status is None:
        return df
    return df.where(F.col(entity.status).isin("ok", "pending"))
