"""Admission: row-size budgets, fan-out estimates and plan-time cost of nested pages."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of a serialised row of each type, as it is and expanded, and those of a row of any other type.
ROW_BYTES = {
    "org": (704, 8448),
    "net": (1664, 2560),
    "fac": (1344, 3392),
    "ix": (1280, 2688),
    "poc": (384, 2752),
    "ixlan": (576, 2560),
    "ixpfx": (384, 2240),
    "netixlan": (640, 4928),
    "netfac": (384, 4736),
    "ixfac": (384, 4416),
    "carrier": (512, 1664),
    "carrierfac": (320, 3520),
    "campus": (576, 2688),
}
DEFAULT_ROW_BYTES = (4096, 4096)
COST_LIMIT = 1_000_000
EDGE_WEIGHTS = {"few": 4, "moderate": 16, "members": 64}
#: How many rows each set of a type is taken to hold.
EDGES = {
    "org": {"net": "few", "fac": "few", "ix": "few", "campus": "few", "carrier": "few"},
    "campus": {"fac": "few"},
    "carrier": {"carrierfac": "moderate"},
    "fac": {"netfac": "moderate", "ixfac": "few", "carrierfac": "few"},
    "ix": {"ixlan": "few", "ixfac": "moderate"},
    "ixlan": {"netixlan": "members", "ixpfx": "few"},
    "net": {"netixlan": "moderate", "netfac": "moderate", "poc": "few"},
}


@dataclass(frozen=True)
class Budget:
    allowed: bool
    max_rows: int
    estimated_bytes: int


def row_bytes(entity: str, depth: int = 0) -> int:
    return ROW_BYTES.get(entity, DEFAULT_ROW_BYTES)[1 if depth >= 1 else 0]


def check_budget(count: int, entity: str, depth: int, budget: int) -> Budget:
    """A budget of 0 or less allows everything."""
    per_row = row_bytes(entity, depth)
    return Budget(budget <= 0 or count * per_row <= budget, max(0, budget) // per_row, count * per_row)


def fan_out_bytes(parents: DataFrame, key: str, base: int, children: Mapping[str, tuple[DataFrame, str, int]]) -> DataFrame:
    """Estimated bytes of each parent's detail: its own, and those of all children.

    ``children``: name to (rows, foreign key, bytes of a row).  One grouped count for each set.
    """
    out = parents.select(F.col(key), F.lit(base).cast("long").alias("bytes"))
    for rows, fk, size in children.values():
        counts = rows.groupBy(F.col(fk).alias("_fk")).agg((F.count(F.lit(1)) * size).alias("_more"))
        out = out.join(counts, F.col(key) == F.col("_fk"), "left").select(key, (F.col("bytes") + F.coalesce("_more", F.lit(0))).alias("bytes"))
    return out


def selection_cost(selection: Mapping[str, Any]) -> int:
    """Cost of a nested selection: {"fields": n, "size": page or weight, "children": [...]}.

    A list costs its size times what one of its rows costs.
    """
    own = int(selection.get("fields", 1)) + sum(selection_cost(c) for c in selection.get("children", ()))
    size = selection.get("size", 1)
    return EDGE_WEIGHTS.get(size, size) * own if isinstance(size, str) else int(size) * own


def nested_cost(entity: str, sets: Mapping[str, Any], fields: int = 1) -> int:
    """Cost of a row of an entity with sets below it: {"net": {"poc": {}}}; a set weighs as ``EDGES`` says, a parent 1."""
    return fields + sum(EDGE_WEIGHTS.get(EDGES.get(entity, {}).get(child, ""), 1) * nested_cost(child, below) for child, below in sets.items())


def check_cost(selection: Mapping[str, Any]) -> bool:
    return selection_cost(selection) <= COST_LIMIT
