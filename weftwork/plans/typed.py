"""Typed filters, condition trees and REST parameters, compiled to predicates."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftwork.plans.filters import FilterError, hop, moment_literal
from weftwork.plans.schema import Catalogue, Entity

#: The typed list filters. ``~`` matches inside whatever the case, ``+`` must be positive.
LIST_FILTERS = {
    "campus": "id+ org_id+ name~ aka~ name_long~ country city~ status website notes state zipcode logo org_name",
    "carrier": "id+ org_id+ name~ aka~ name_long~ status website notes org_name logo",
    "carrierfac": "id+ carrier_id+ fac_id+ status name~",
    "fac": "id+ org_id+ campus_id+ name~ aka~ name_long~ country city~ status website clli rencode npanxx tech_email tech_phone sales_email sales_phone property "
    "diverse_serving_substations notes region_continent status_dashboard logo address1 address2 state zipcode suite floor org_name",
    "ix": "id+ org_id+ name~ aka~ name_long~ country city~ status region_continent media notes proto_unicast proto_multicast proto_ipv6 website url_stats tech_email tech_phone "
    "policy_email policy_phone sales_email sales_phone service_level terms status_dashboard logo",
    "ixfac": "id+ ix_id+ fac_id+ country city~ status name~",
    "ixlan": "id+ ix_id+ name~ status descr mtu dot1q_support rs_asn+ arp_sponge ixf_ixp_member_list_url_visible ixf_ixp_import_enabled",
    "ixpfx": "id+ ixlan_id+ protocol status prefix in_dfz",
    "net": "id+ asn+ org_id+ name~ aka~ name_long~ status website looking_glass route_server irr_as_set info_type info_prefixes4 info_prefixes6 info_traffic info_ratio info_scope "
    "info_unicast info_multicast info_ipv6 info_never_via_route_servers notes policy_url policy_general policy_locations policy_ratio policy_contracts allow_ixp_update "
    "status_dashboard rir_status logo",
    "netfac": "id+ net_id+ fac_id+ country city~ status name~ local_asn+",
    "netixlan": "id+ net_id+ ixlan_id+ asn+ name~ status ix_id+ speed ipaddr4 ipaddr6 is_rs_peer bfd_support operational notes net_side_id+ ix_side_id+",
    "org": "id+ name~ aka~ name_long~ country city~ status website notes logo address1 address2 state zipcode suite floor",
    "poc": "id+ net_id+ role name~ status visible phone email url",
}


def contains_fold(column: Column, text: str) -> Column:
    return F.contains(F.lower(column), F.lit(text.lower()))


def positive(name: str, value: Any) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or value <= 0:
        raise FilterError(f"{name} must be positive")
    return value


def not_empty(name: str, value: str) -> str:
    if not value:
        raise FilterError(f"{name} must not be empty")
    return value


def typed_predicates(spec: str, given: Mapping[str, Any], stream: bool = False) -> list[Column]:
    """The predicates of set fields; streams have no ``id`` filter."""
    out, left = [], dict(given)
    for item in spec.split():
        name, mark = item.rstrip("~+"), item[-1]
        if name not in left or (stream and name == "id"):
            continue
        value = left.pop(name)
        if value is None:
            continue
        if mark == "~":
            out.append(contains_fold(F.col(name), value))
        else:
            out.append(F.col(name) == F.lit(positive(name, value) if mark == "+" else value))
    if unknown := [k for k, v in left.items() if v is not None]:
        raise FilterError(f"no such filter: {', '.join(sorted(unknown))}")
    return out


def typed_list(df: DataFrame, spec: str, given: Mapping[str, Any], stream: bool = False) -> DataFrame:
    """Rows under typed filters; no status is added, so tombstones show."""
    found = typed_predicates(spec, given, stream)
    return df.where(reduce(lambda a, b: a & b, found)) if found else df


#: Operators of condition trees and of REST parameters, by either name.
_OPS: dict[str, Callable[[Column, Any], Column]] = {
    "EQ": lambda c, v: c == v,
    "NEQ": lambda c, v: c != v,
    "In": lambda c, v: c.isin(list(v)) if v else F.lit(False),
    "NotIn": lambda c, v: ~c.isin(list(v)) if v else F.lit(True),
    "GT": lambda c, v: c > v,
    "GTE": lambda c, v: c >= v,
    "LT": lambda c, v: c < v,
    "LTE": lambda c, v: c <= v,
    "Contains": lambda c, v: F.contains(c, F.lit(v)),
    "HasPrefix": lambda c, v: F.startswith(c, F.lit(v)),
    "HasSuffix": lambda c, v: F.endswith(c, F.lit(v)),
    "EqualFold": lambda c, v: F.lower(c) == v.lower(),
    "ContainsFold": contains_fold,
    "IsNil": lambda c, v: c.isNull() if v else F.lit(True),
    "NotNil": lambda c, v: c.isNotNull() if v else F.lit(True),
}
REST_OPS = {
    "eq": "EQ",
    "neq": "NEQ",
    "in": "In",
    "notIn": "NotIn",
    "gt": "GT",
    "gte": "GTE",
    "lt": "LT",
    "lte": "LTE",
    "ieq": "EqualFold",
    "has": "Contains",
    "ihas": "ContainsFold",
    "prefix": "HasPrefix",
    "suffix": "HasSuffix",
}


def _value(entity: Entity, name: str, value: Any) -> Any:
    from datetime import datetime

    if isinstance(value, datetime):
        return moment_literal(value, entity.schema[name].dataType.simpleString())
    return value


def condition(entity: Entity, tree: Mapping[str, Any]) -> Column | None:
    """A condition tree: ``not``, ``and``, ``or`` and field conditions, all in conjunction.

    A field condition is a field name, with an operator such as ``nameContains`` after it; none
    means equality.  Field names may be written in camel case.
    """
    names = {_camel(f.name): f.name for f in entity.schema.fields} | {f.name: f.name for f in entity.schema.fields}
    parts: list[Column] = []
    for key, value in tree.items():
        if key == "not":
            if (inner := condition(entity, value)) is not None:
                parts.append(~inner)
        elif key in ("and", "or"):
            found = [c for c in (condition(entity, branch) for branch in value) if c is not None]
            if found:
                parts.append(reduce((lambda a, b: a & b) if key == "and" else (lambda a, b: a | b), found))
        elif key in names:
            parts.append(F.col(names[key]) == _value(entity, names[key], value))
        else:
            op = max((o for o in _OPS if key.endswith(o) and key[: -len(o)] in names), key=len, default=None)
            if op is None:
                raise FilterError(f"no such condition: {key}")
            name = names[key[: -len(op)]]
            values = [_value(entity, name, v) for v in value] if isinstance(value, (list, tuple)) else _value(entity, name, value)
            parts.append(_OPS[op](F.col(name), values))
    return reduce(lambda a, b: a & b, parts) if parts else None


def _camel(name: str) -> str:
    head, *tail = name.split("_")
    return head + "".join("ID" if t == "id" else t.capitalize() for t in tail)


def related(catalogue: Catalogue, name: str, edge: str, tree: Mapping[str, Any] | None = None) -> DataFrame:
    """Rows that have a related row, which meets the condition if there is one."""
    entity = catalogue.entities[name]
    target = catalogue.entities[entity.edges[edge].target]
    found = catalogue.tables[target.name]
    if tree and (c := condition(target, tree)) is not None:
        found = found.where(c)
    return hop(catalogue.tables[name], entity, edge, target, found)


def rest_predicate(entity: Entity, params: Mapping[str, Any], filter_op: str = "and") -> Column | None:
    """Parameters such as ``name.ihas``; all of them with one connective."""
    if filter_op not in ("and", "or"):
        raise FilterError("filter_op must be and or or")
    parts = []
    for key, value in params.items():
        name, _, op = key.partition(".")
        if name not in entity.schema.names:
            raise FilterError(f"no such field: {name}")
        if op == "null":
            parts.append(F.col(name).isNull() if value else F.col(name).isNotNull())
        elif (op or "eq") in REST_OPS:
            parts.append(_OPS[REST_OPS[op or "eq"]](F.col(name), _value(entity, name, value)))
        else:
            raise FilterError(f"no such operator: {op}")
    return reduce((lambda a, b: a & b) if filter_op == "and" else (lambda a, b: a | b), parts) if parts else None
