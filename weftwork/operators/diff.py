"""Comparing datasets: rows and fields that only one of two captures has; redaction; structure."""

from __future__ import annotations

import json
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fields that are always replaced.
PII_FIELDS = [
    "address1",
    "address2",
    "city",
    "email",
    "latitude",
    "longitude",
    "name",
    "phone",
    "policy_email",
    "policy_phone",
    "sales_email",
    "sales_phone",
    "state",
    "tech_email",
    "tech_phone",
    "zipcode",
]
ALWAYS_KEPT = ("id", "visible")


def is_pii(name: str) -> bool:
    return name in PII_FIELDS


def only_in(right: DataFrame, left: DataFrame, key: str) -> DataFrame:
    """Rows of the right side whose key the left side lacks."""
    return right.join(left.select(key), key, "left_anti")


def field_presence(left: DataFrame, right: DataFrame, key: str, json: str) -> DataFrame:
    """(field, n): how many rows of the right side have a field that the left row lacks.

    Rows are JSON objects; of a row without partner every field counts.
    """
    fields = right.select(key, F.explode(F.json_object_keys(json)).alias("field"))
    known = left.select(key, F.explode(F.json_object_keys(json)).alias("field"))
    return fields.join(known, [key, "field"], "left_anti").groupBy("field").agg(F.count(F.lit(1)).alias("n"))


def value_set(df: DataFrame, column: str) -> DataFrame:
    """The distinct values of a column, sorted, in one row."""
    return df.select(column).distinct().agg(F.sort_array(F.collect_set(column)).alias("values"))


def placeholder(kind: T.DataType) -> str:
    name = kind.simpleString()
    for starts, word in (("string", "string"), ("boolean", "bool"), ("array", "array"), ("struct", "object"), ("map", "object")):
        if name.startswith(starts):
            return f"<auth-only:{word}>"
    return "<auth-only:number>"


def redact(rows: DataFrame, public: DataFrame, key: str = "id") -> DataFrame:
    """The rows as text, with placeholders for personal fields and for all that isn't public.

    A field shows if it isn't personal, the row is public and the public side has the field.
    """
    public_ids = public.select(F.col(key).alias("_public")).distinct()
    joined = rows.join(public_ids, F.col(key) == F.col("_public"), "left")
    out: list[Column] = []
    for f in rows.schema.fields:
        value = F.col(f.name)
        if f.name in (key, *ALWAYS_KEPT):
            out.append(value)
            continue
        hidden = F.lit(placeholder(f.dataType))
        text = value.cast("string") if not isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)) else F.to_json(value)
        shown = F.lit(is_pii(f.name) or f.name not in public.columns)
        out.append(F.when(value.isNull(), F.lit(None).cast("string")).when(shown | F.col("_public").isNull(), hidden).otherwise(text).alias(f.name))
    return joined.select(*out)


def json_kind(value: Any) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, (int, float)):
        return "number"
    return {str: "string", dict: "object", list: "array"}.get(type(value), "unknown")


def compare_structure(reference: Any, actual: Any, path: str = "") -> list[tuple[str, str]]:
    """(path, kind) of missing and extra fields and unlike types; null fits everything, and
    of arrays the first elements are compared."""
    a, b = json_kind(reference), json_kind(actual)
    if "null" in (a, b):
        return []
    if a != b:
        return [(path, "type_mismatch")]
    found = []
    if a == "object":
        join = lambda k: f"{path}.{k}" if path else k
        found += [(join(k), "missing_field") for k in reference.keys() - actual.keys()]
        found += [(join(k), "extra_field") for k in actual.keys() - reference.keys()]
        for k in reference.keys() & actual.keys():
            found += compare_structure(reference[k], actual[k], join(k))
    elif a == "array" and reference and actual:
        found += compare_structure(reference[0], actual[0], f"{path}[0]")
    return sorted(found)


def compare_schemas(reference: T.DataType, actual: T.DataType, path: str = "") -> list[tuple[str, str]]:
    """The same for two Spark schemas."""
    if isinstance(reference, T.NullType) or isinstance(actual, T.NullType):
        return []
    if isinstance(reference, T.ArrayType) and isinstance(actual, T.ArrayType):
        return compare_schemas(reference.elementType, actual.elementType, f"{path}[0]")
    if isinstance(reference, T.StructType) and isinstance(actual, T.StructType):
        found, names = [], {f.name: f.dataType for f in actual.fields}
        join = lambda k: f"{path}.{k}" if path else k
        for f in reference.fields:
            found += compare_schemas(f.dataType, names.pop(f.name), join(f.name)) if f.name in names else [(join(f.name), "missing_field")]
        return sorted([*found, *((join(n), "extra_field") for n in names)])
    return [] if type(reference) is type(actual) else [(path, "type_mismatch")]


def summary(left: DataFrame, right: DataFrame, key: str, json: str) -> DataFrame:
    """One row of what a report says of two tables of JSON objects: left_rows, right_rows, only_right and, as a map, fields with the
    number of right rows that have them where the left row lacks them."""
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    entry = F.map_from_entries(F.sort_array(F.collect_list(F.struct("field", "n")))).alias("fields")
    # Four tables of one row each.
    one = count(left, "left_rows")
    for other in (count(right, "right_rows"), count(only_in(right, left, key), "only_right"), field_presence(left, right, key, json).agg(entry)):
        one = one.crossJoin(other)
    return one


def report(pairs: dict[str, tuple[DataFrame, DataFrame]], key: str, json: str) -> DataFrame:
    """(type, left_rows, right_rows, only_right, fields) of pairs of tables; ``as_types`` makes a report's input of it."""
    rows = [summary(left, right, key, json).select(F.lit(name).alias("type"), "*") for name, (left, right) in pairs.items()]
    return reduce(DataFrame.unionByName, rows)


def as_types(rows: DataFrame) -> dict[str, dict[str, Any]]:
    """What ``markdown_report`` and ``json_report`` format: one entry a type."""
    return {r["type"]: {k: v for k, v in r.asDict().items() if k != "type"} for r in rows.collect()}


def markdown_report(types: dict[str, dict[str, Any]]) -> str:
    """A small report of diff results, a table for each type."""
    out = ["# Differences", ""]
    for name, result in sorted(types.items()):
        out += [f"## {name}", "", f"rows: {result['left_rows']} and {result['right_rows']}, only in the second: {result['only_right']}", ""]
        if result.get("fields"):
            out += ["| field | rows |", "|---|---|", *(f"| {k} | {v} |" for k, v in sorted(result["fields"].items())), ""]
    return "\n".join(out)


def json_report(types: dict[str, dict[str, Any]]) -> str:
    """The same report as JSON, types and fields in order."""
    return json.dumps({"types": types}, sort_keys=True, indent=2, default=str)
