"""Entities, their fields and edges; the native catalogue and the driver tables' one."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftwork.session import ship_package

#: Kinds of filterable fields, by Spark type.
KIND_OF = {"string": "string", "bigint": "int", "int": "int", "boolean": "bool", "double": "float", "timestamp": "time", "timestamp_ntz": "time", "date": "time"}


@dataclass(frozen=True)
class Edge:
    """A way from an entity to another; ``owns_key``: the foreign key is on this side."""

    name: str
    target: str
    key: str
    owns_key: bool


@dataclass(frozen=True)
class Entity:
    name: str
    schema: T.StructType
    key: str = "id"
    fields: dict[str, str] = field(default_factory=dict)
    search: tuple[str, ...] = ()
    folded: frozenset[str] = frozenset()
    number: str | None = None
    edges: dict[str, Edge] = field(default_factory=dict)
    status: str | None = "status"
    updated: str | None = "updated"
    created: str | None = "created"
    keeps_pending: bool = False
    #: A column that hides rows from the public, unless it is null or "Public".
    gate: str | None = None


@dataclass
class Catalogue:
    """Entities, and the tables that hold their rows."""

    entities: dict[str, Entity]
    tables: dict[str, DataFrame] = field(default_factory=dict)

    def table(self, name: str, tier: str = "public") -> DataFrame:
        """An entity's rows as far as the tier may see them."""
        return visible_rows(self.tables[name], self.entities[name], tier)


def visible_rows(df: DataFrame, entity: Entity, tier: str) -> DataFrame:
    if entity.gate is None or tier == "users":
        return df
    return df.where((F.col(entity.gate) == "Public") | F.col(entity.gate).isNull())


def fields_of(schema: T.StructType, hidden: tuple[str, ...] = ()) -> dict[str, str]:
    """Filterable fields: those of plain types that aren't hidden."""
    return {f.name: KIND_OF[k] for f in schema.fields if (k := f.dataType.simpleString()) in KIND_OF and f.name not in hidden}


def edges_of(foreign_keys: list[tuple[str, str, str]]) -> dict[str, dict[str, Edge]]:
    """Both directions of every (child, key column, parent)."""
    out: dict[str, dict[str, Edge]] = {}
    for child, key, parent in foreign_keys:
        out.setdefault(child, {})[parent] = Edge(parent, parent, key, True)
        out.setdefault(parent, {})[child] = Edge(child, child, key, False)
    return out


# The columns of the 13 entity types, in parent-before-child order.
_SOCIAL = "social_media array<struct<service:string,identifier:string>>"
_STAMPS = "created timestamp, updated timestamp, status string"
_ADDRESS = "address1 string, address2 string, city string, state string, country string, zipcode string, suite string, floor string"
NATIVE_DDL = {
    "org": f"id bigint, name string, aka string, name_long string, website string, {_SOCIAL}, notes string, logo string, {_ADDRESS}, latitude double, longitude double, {_STAMPS}",
    "campus": f"id bigint, org_id bigint, org_name string, name string, name_long string, aka string, website string, {_SOCIAL}, notes string, country string, city string, zipcode string, "
    f"state string, logo string, {_STAMPS}",
    "fac": "id bigint, org_id bigint, org_name string, campus_id bigint, name string, aka string, name_long string, website string, "
    f"{_SOCIAL}, clli string, rencode string, npanxx string, tech_email string, tech_phone string, sales_email string, sales_phone string, property string, "
    "diverse_serving_substations boolean, available_voltage_services array<string>, notes string, region_continent string, status_dashboard string, logo string, "
    f"net_count bigint, ix_count bigint, carrier_count bigint, {_ADDRESS}, latitude double, longitude double, {_STAMPS}",
    "carrier": f"id bigint, org_id bigint, org_name string, name string, aka string, name_long string, website string, {_SOCIAL}, notes string, fac_count bigint, logo string, {_STAMPS}",
    "carrierfac": f"id bigint, carrier_id bigint, fac_id bigint, name string, {_STAMPS}",
    "ix": "id bigint, org_id bigint, name string, aka string, name_long string, city string, country string, region_continent string, media string, notes string, "
    f"proto_unicast boolean, proto_multicast boolean, proto_ipv6 boolean, website string, {_SOCIAL}, url_stats string, tech_email string, tech_phone string, "
    "policy_email string, policy_phone string, sales_email string, sales_phone string, net_count bigint, fac_count bigint, ixf_net_count bigint, ixf_last_import timestamp, "
    f"ixf_import_request string, ixf_import_request_status string, service_level string, terms string, status_dashboard string, logo string, {_STAMPS}",
    "ixlan": "id bigint, ix_id bigint, name string, descr string, mtu bigint, dot1q_support boolean, rs_asn bigint, arp_sponge string, "
    f"ixf_ixp_member_list_url_visible string, ixf_ixp_member_list_url string, ixf_ixp_import_enabled boolean, {_STAMPS}",
    "ixpfx": f"id bigint, ixlan_id bigint, protocol string, prefix string, in_dfz boolean, {_STAMPS}",
    "ixfac": f"id bigint, ix_id bigint, fac_id bigint, name string, city string, country string, {_STAMPS}",
    "net": f"id bigint, org_id bigint, name string, aka string, name_long string, website string, {_SOCIAL}, asn bigint, looking_glass string, route_server string, irr_as_set string, "
    "info_type string, info_types array<string>, info_prefixes4 bigint, info_prefixes6 bigint, info_traffic string, info_ratio string, info_scope string, info_unicast boolean, "
    "info_multicast boolean, info_ipv6 boolean, info_never_via_route_servers boolean, notes string, policy_url string, policy_general string, policy_locations string, "
    "policy_ratio boolean, policy_contracts string, allow_ixp_update boolean, ixp_update_exclude array<string>, status_dashboard string, rir_status string, "
    f"rir_status_updated timestamp, logo string, ix_count bigint, fac_count bigint, netixlan_updated timestamp, netfac_updated timestamp, poc_updated timestamp, {_STAMPS}",
    "poc": f"id bigint, net_id bigint, role string, visible string, name string, phone string, email string, url string, {_STAMPS}",
    "netfac": f"id bigint, net_id bigint, fac_id bigint, name string, city string, country string, local_asn bigint, {_STAMPS}",
    "netixlan": "id bigint, net_id bigint, ix_id bigint, ixlan_id bigint, name string, notes string, speed bigint, asn bigint, ipaddr4 string, ipaddr6 string, is_rs_peer boolean, "
    f"bfd_support boolean, operational boolean, net_side_id bigint, ix_side_id bigint, {_STAMPS}",
}
NATIVE_KEYS = [
    ("campus", "org_id", "org"),
    ("fac", "org_id", "org"),
    ("fac", "campus_id", "campus"),
    ("carrier", "org_id", "org"),
    ("carrierfac", "carrier_id", "carrier"),
    ("carrierfac", "fac_id", "fac"),
    ("ix", "org_id", "org"),
    ("ixlan", "ix_id", "ix"),
    ("ixpfx", "ixlan_id", "ixlan"),
    ("ixfac", "ix_id", "ix"),
    ("ixfac", "fac_id", "fac"),
    ("net", "org_id", "org"),
    ("poc", "net_id", "net"),
    ("netfac", "net_id", "net"),
    ("netfac", "fac_id", "fac"),
    ("netixlan", "net_id", "net"),
    ("netixlan", "ixlan_id", "ixlan"),
]
#: Fields of the free-text search, and fields with a folded copy.
NATIVE_SEARCH = {
    "org": "name aka name_long",
    "campus": "name",
    "fac": "name aka name_long city country",
    "carrier": "name aka name_long",
    "carrierfac": "name",
    "ix": "name aka name_long city country",
    "ixlan": "name descr",
    "ixpfx": "prefix",
    "ixfac": "name",
    "net": "name aka name_long irr_as_set",
    "poc": "name email",
    "netfac": "name",
    "netixlan": "name",
}
NATIVE_FOLDED = {"org": "name aka city", "campus": "name", "fac": "name aka city", "carrier": "name aka", "ix": "name aka name_long city", "net": "name aka name_long"}
#: Links to a further facility that are set to null where it is missing.
OPTIONAL_KEYS = {("fac", "campus_id"): "campus", ("netixlan", "net_side_id"): "fac", ("netixlan", "ix_side_id"): "fac"}


def native_entities() -> dict[str, Entity]:
    edges, out = edges_of(NATIVE_KEYS), {}
    for name, ddl in NATIVE_DDL.items():
        schema = T.StructType.fromDDL(ddl)
        out[name] = Entity(
            name,
            schema,
            fields=fields_of(schema, ("status", "ixf_ixp_member_list_url")),
            search=tuple(NATIVE_SEARCH[name].split()),
            folded=frozenset(NATIVE_FOLDED.get(name, "").split()),
            number="asn" if name == "net" else None,
            edges=edges[name],
            keeps_pending=name == "campus",
            gate="visible" if name == "poc" else None,
        )
    return out


#: The driver's relational tables: key column, search fields, number field.
DRIVER = {
    "region": ("r_regionkey", "r_name", None),
    "nation": ("n_nationkey", "n_name", "n_nationkey"),
    "customer": ("c_custkey", "c_name c_mktsegment", "c_custkey"),
    "supplier": ("s_suppkey", "s_name", "s_suppkey"),
    "part": ("p_partkey", "p_name p_brand p_type", "p_partkey"),
    "orders": ("o_orderkey", "o_orderpriority", "o_orderkey"),
    "lineitem": ("l_orderkey", "l_returnflag l_linestatus", None),
    "events": ("event_id", "event_type", None),
}
DRIVER_KEYS = [
    ("nation", "n_regionkey", "region"),
    ("customer", "c_nationkey", "nation"),
    ("supplier", "s_nationkey", "nation"),
    ("orders", "o_custkey", "customer"),
    ("lineitem", "l_orderkey", "orders"),
    ("lineitem", "l_partkey", "part"),
    ("lineitem", "l_suppkey", "supplier"),
]


def driver_catalogue(spark: SparkSession, sf_dir: str, *names: str) -> Catalogue:
    """The driver's tables as a catalogue; only the named ones, or all."""
    ship_package(spark)
    edges, entities, tables = edges_of(DRIVER_KEYS), {}, {}
    for name in names or DRIVER:
        key, search, number = DRIVER[name]
        df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        if name == "orders":
            state = F.col("o_orderstatus")
            df = df.withColumn("status", F.when(state == "F", "ok").when(state == "O", "deleted").otherwise("pending"))
        kept = {k: e for k, e in edges.get(name, {}).items() if not names or e.target in names}
        entities[name] = Entity(
            name,
            df.schema,
            key,
            fields_of(df.schema, ("status",)),
            tuple(search.split()),
            number=number,
            edges=kept,
            status="status" if name == "orders" else None,
            updated={"orders": "o_orderdate", "events": "ts"}.get(name),
            created={"orders": "o_orderdate", "events": "ts"}.get(name),
        )
        tables[name] = df
    return Catalogue(entities, tables)
