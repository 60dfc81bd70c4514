"""Queries over the native catalogue, filled from the driver's tables, with DuckDB SQL for the same rows.

Every native type is a view of a driver table: organisations are nations, networks customers,
facilities suppliers, exchanges parts, and so on; some rows are deleted or pending, some keys name no parent.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftwork.functions import format as fmt
from weftwork.functions import text
from weftwork.operators import details, diff, joins, nested, search
from weftwork.plans import cost
from weftwork.plans.filters import compile_filters
from weftwork.plans.schema import NATIVE_DDL, Catalogue, driver_catalogue, native_entities
from weftwork.queries import _table, register
from weftwork.session import shared_folder, ship_package
from weftwork.sources import envelope
from weftwork.streaming import merge

#: Type to the driver table and the columns it gives, in SQL that Spark and DuckDB read alike.
VIEWS = {
    "org": ("nation", {"id": "n_nationkey", "name": "n_name"}),
    "campus": ("region", {"id": "r_regionkey", "org_id": "r_regionkey * 3", "name": "r_name"}),
    "carrier": ("region", {"id": "r_regionkey + 100", "org_id": "r_regionkey * 2", "name": "r_name"}),
    "fac": ("supplier", {"id": "s_suppkey", "org_id": "s_nationkey", "campus_id": "CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_suppkey % 7 END", "name": "s_name"}),
    "net": ("customer", {"id": "c_custkey", "org_id": "c_nationkey", "name": "c_name", "asn": "c_custkey + 64512"}),
    "ix": ("part", {"id": "p_partkey", "org_id": "p_partkey % 25", "name": "p_name"}),
    "ixlan": ("part", {"id": "p_partkey", "ix_id": "p_partkey", "name": "p_name"}),
    "ixpfx": ("part", {"id": "p_partkey * 2", "ixlan_id": "p_partkey % 150", "prefix": "p_name"}),
    "ixfac": ("part", {"id": "p_partkey", "ix_id": "p_partkey % 40", "fac_id": "p_partkey % 9", "name": "p_name"}),
    "carrierfac": ("supplier", {"id": "s_suppkey", "carrier_id": "s_suppkey % 7 + 99", "fac_id": "s_suppkey", "name": "s_name"}),
    "poc": ("orders", {"id": "o_orderkey", "net_id": "o_custkey", "visible": "CASE o_orderkey % 3 WHEN 0 THEN 'Users' WHEN 1 THEN 'Public' END"}),
    "netfac": ("orders", {"id": "o_orderkey", "net_id": "o_custkey", "fac_id": "o_orderkey % 10"}),
    "netixlan": ("orders", {"id": "o_orderkey", "net_id": "o_custkey", "ix_id": "o_orderkey % 200", "ixlan_id": "o_orderkey % 200", "speed": "o_orderkey % 400 * 100"}),
}
_STATUS = "CASE WHEN id % 11 = 3 THEN 'deleted' WHEN id % 13 = 5 THEN 'pending' ELSE 'ok' END"
_LIVE = "status IN ('ok', 'pending')"
#: The same views for DuckDB; contacts that the public may not see are left out, as the catalogue does.
_WITH = "WITH " + ",\n".join(
    f"{name} AS (SELECT *, {_STATUS} AS status FROM (SELECT {', '.join(f'{v} AS {k}' for k, v in columns.items())} FROM {table}){' WHERE visible = $$Public$$ OR visible IS NULL' if name == 'poc' else ''})"
    for name, (table, columns) in VIEWS.items()
)


def catalogue(spark: SparkSession, d: str) -> Catalogue:
    """The native catalogue over the driver's tables; columns that no table gives are null."""
    ship_package(spark)
    tables = {}
    for name, (table, columns) in VIEWS.items():
        rows = spark.read.parquet(f"{d}/{table}.parquet").selectExpr(*[f"{v} AS {k}" for k, v in columns.items()]).withColumn("status", F.expr(_STATUS))
        schema = T.StructType.fromDDL(NATIVE_DDL[name])
        tables[name] = rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])
    return Catalogue(native_entities(), tables)


def _ids(column: str):
    return F.array_join(F.transform(column, lambda x: x["id"].cast("string")), ",").alias(column)


def _detail(name: str, parents: str = "", sets: str = "", over: str = "") -> None:
    """Register the detail of a type: each parent's name, and the ids of each set in order.

    ``parents`` are pairs of parent and key, ``sets`` pairs of child and key, ``over`` (target, bridge, near key, far key).
    """
    parent_pairs, set_pairs = ([p.split(":") for p in part.split()] for part in (parents, sets))
    bridges = [b.split(":") for b in over.split()]
    made = [f"(SELECT p.name FROM {p} p WHERE p.id = e.{key}) AS {p}_name" for p, key in parent_pairs]
    made += [f"coalesce((SELECT string_agg(c.id::VARCHAR, ',' ORDER BY c.id) FROM {c} c WHERE c.{key} = e.id AND c.{_LIVE}), '') AS {c}_set" for c, key in set_pairs]
    made += [
        f"coalesce((SELECT string_agg(f.id::VARCHAR, ',' ORDER BY b.id) FROM {bridge} b JOIN {f} f ON f.id = b.{far} WHERE b.{near} = e.id AND b.{_LIVE}{f' AND f.{_LIVE}' if f == 'net' else ''}), '') AS {f}_set"
        for f, bridge, near, far in bridges
    ]

    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = nested.expand(catalogue(spark, d), name, 2)
        return rows.select("id", *[F.col(p)["name"].alias(f"{p}_name") for p, _ in parent_pairs], *[_ids(f"{c}_set") for c, *_ in (*set_pairs, *bridges)])

    run.__name__ = f"detail_{name}"
    register(f"{_WITH}\nSELECT {', '.join(['e.id', *made])} FROM {name} e WHERE e.{_LIVE}")(run)


_detail("org", "", "net:org_id fac:org_id ix:org_id carrier:org_id campus:org_id")
_detail("net", "org:org_id", "poc:net_id netfac:net_id netixlan:net_id")
_detail("fac", "org:org_id campus:campus_id")
_detail("ix", "org:org_id", "ixlan:ix_id", "fac:ixfac:ix_id:fac_id")
_detail("ixlan", "ix:ix_id", "ixpfx:ixlan_id", "net:netixlan:ixlan_id:net_id")
_detail("carrier", "org:org_id", "carrierfac:carrier_id")
_detail("campus", "org:org_id", "fac:campus_id")
_detail("netfac", "net:net_id fac:fac_id")
_detail("netixlan", "net:net_id ixlan:ixlan_id")
_detail("ixfac", "ix:ix_id fac:fac_id")
_detail("carrierfac", "carrier:carrier_id fac:fac_id")
_detail("poc", "net:net_id")
_detail("ixpfx", "ixlan:ixlan_id")


@register(f"{_WITH}\nSELECT id, net_id, visible FROM poc")
def visible_contacts(spark: SparkSession, d: str) -> DataFrame:
    return catalogue(spark, d).table("poc").select("id", "net_id", "visible")


@register("SELECT c_custkey FROM customer WHERE lower(c_mktsegment) = 'machinery'")
def filter_iexact(spark: SparkSession, d: str) -> DataFrame:
    cat = driver_catalogue(spark, d, "customer")
    return compile_filters(cat, "customer", {"c_mktsegment__iexact": "mAchinery"}).apply(cat.tables["customer"]).select("c_custkey")


@register("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate IN (TIMESTAMP '1997-05-28', TIMESTAMP '1998-01-01', TIMESTAMP '1995-03-15')")
def filter_in_date(spark: SparkSession, d: str) -> DataFrame:
    cat = driver_catalogue(spark, d, "orders")
    return compile_filters(cat, "orders", {"o_orderdate__in": "1997-05-28,1998-01-01, 1995-03-15"}).apply(cat.tables["orders"]).select("o_orderkey", "o_orderdate")


@register("SELECT s_suppkey, s_acctbal FROM supplier WHERE s_acctbal IN (SELECT s_acctbal FROM supplier WHERE false) OR s_acctbal IN (0.5, 1234.25)")
def filter_in_number(spark: SparkSession, d: str) -> DataFrame:
    cat = driver_catalogue(spark, d, "supplier")
    return compile_filters(cat, "supplier", {"s_acctbal__in": "0.5,1234.25"}).apply(cat.tables["supplier"]).select("s_suppkey", "s_acctbal")


# The sync cycle over all types: a full one from pages of envelopes, then an increment since each type's cursor
# with repeated arrivals, missing parents and null keys.

_KEYS = {t: {"required": dict(merge.required_keys(t)), "optional": dict(merge.optional_keys(t))} for t in NATIVE_DDL}
#: Columns that the views don't give, or that lack a key now and then.
_MORE_KEYS = {
    "netfac": {"fac_id": "CASE WHEN id % 9 = 1 THEN NULL ELSE fac_id END"},
    "netixlan": {"net_side_id": "id % 13", "ix_side_id": "CASE WHEN id % 5 = 0 THEN NULL ELSE id % 2000 END"},
}
_FIRST_UPDATE = "TIMESTAMP '2024-01-01 00:00:00' + id % 3 * INTERVAL 1 DAY"
_EARLY_UPDATE = "CASE WHEN id % 3 = 0 THEN TIMESTAMP '2023-12-01 00:00:00' ELSE TIMESTAMP '2025-01-01 00:00:00' END"
_NEXT_UPDATE = "CASE WHEN id % 8 = 0 THEN TIMESTAMP '2024-01-03 12:00:00' ELSE TIMESTAMP '2023-12-31 00:00:00' END"
_FOUND_UPDATE = "TIMESTAMP '2024-01-01 06:00:00'"


def _links(t: str) -> list[str]:
    return [*_KEYS[t]["required"], *_KEYS[t]["optional"]]


def _sync_sql() -> str:
    """Types by suffix: _1 after the first cycle, _a what arrives then, _b what is looked up, _2 after the second cycle."""
    parts = []
    for t, (table, columns) in VIEWS.items():
        plain = f"(SELECT {', '.join(f'{v} AS {k}' for k, v in columns.items())} FROM {table})"
        given = [f"{_MORE_KEYS.get(t, {}).get(k, k)} AS {k}" for k in _links(t)]
        parts.append(f"{t}_0 AS (SELECT {', '.join(['id', *given])} FROM {plain})")

    def row(t: str, label: str, updated: str) -> str:
        return f"SELECT {', '.join(['id', *_links(t)])}, '{label}' AS name, {updated} AS updated FROM {t}_0"

    def stored(t: str, source: str, version: int) -> str:
        """Rows whose required parents are there; null required keys are 0, missing optional ones null."""
        keys = [f"coalesce({k}, 0) AS {k}" for k in _KEYS[t]["required"]]
        keys += [f"CASE WHEN {k} = 0 OR {k} IN (SELECT id FROM {p}_{version}) THEN {k} END AS {k}" for k, p in _KEYS[t]["optional"].items()]
        has = [f"(coalesce({k}, 0) = 0 OR {k} IN (SELECT id FROM {p}_{version}))" for k, p in _KEYS[t]["required"].items()]
        return f"SELECT {', '.join(['id', *keys])}, name, updated FROM ({source}) WHERE {' AND '.join(has or ['true'])}"

    for t in NATIVE_DDL:
        parts.append(f"{t}_1 AS MATERIALIZED ({stored(t, row(t, 'first', _FIRST_UPDATE) + ' WHERE id % 5 <> 0', 1)})")
        # The later arrival counts, though the earlier one may have the newer update; both only from the cursor on.
        passes = f"updated >= (SELECT coalesce(max(updated), TIMESTAMP '1900-01-01 00:00:00') FROM {t}_1)"
        late = f"SELECT * FROM ({row(t, 'late', _NEXT_UPDATE)} WHERE id % 4 = 0) WHERE {passes}"
        early = f"SELECT * FROM ({row(t, 'early', _EARLY_UPDATE)} WHERE id % 4 = 0) WHERE {passes}"
        parts.append(f"{t}_l AS MATERIALIZED ({late})")
        parts.append(f"{t}_a AS MATERIALIZED (SELECT * FROM {t}_l UNION ALL SELECT * FROM ({early}) WHERE id NOT IN (SELECT id FROM {t}_l))")
    for t in reversed(NATIVE_DDL):
        asked = " UNION ALL ".join(f"SELECT {k} FROM {c}_{v} WHERE {k} IS NOT NULL" for c in NATIVE_DDL for k, p in _KEYS[c]["required"].items() if p == t for v in "ab")
        here = "".join(f" AND id NOT IN (SELECT id FROM {t}_{v})" for v in "1a")
        parts.append(f"{t}_b AS MATERIALIZED ({row(t, 'found', _FOUND_UPDATE)} WHERE {f'id > 0 AND id IN ({asked}){here}' if asked else 'false'})")
    for t in NATIVE_DDL:
        parts.append(f"{t}_s AS MATERIALIZED ({stored(t, f'SELECT * FROM {t}_a UNION ALL SELECT * FROM {t}_b', 2)})")
        columns = ", ".join(f"CASE WHEN o.id IS NULL OR s.updated > o.updated THEN s.{c} ELSE o.{c} END AS {c}" for c in ("id", *_links(t), "name", "updated"))
        parts.append(f"{t}_2 AS MATERIALIZED (SELECT {columns} FROM {t}_1 o FULL JOIN {t}_s s ON o.id = s.id)")
    shown = lambda t: "concat_ws(',', " + ", ".join([*[f"coalesce({k}::VARCHAR, '-')" for k in _links(t)], "''"]) + ")"
    return "WITH " + ",\n".join(parts) + "\n" + " UNION ALL ".join(f"SELECT '{t}' AS type, id, name, updated, {shown(t)} AS links FROM {t}_2" for t in NATIVE_DDL)


@register(_sync_sql())
def sync_cycles(spark: SparkSession, d: str) -> DataFrame:
    root = shared_folder(spark, "sync")
    cat, page = catalogue(spark, d), F.floor(F.col("id") / 250)
    store = merge.Store(spark, f"{root}/store")

    def made(t: str, text: str, updated: str) -> DataFrame:
        given = {k: F.expr(v).cast("bigint") for k, v in _MORE_KEYS.get(t, {}).items()}
        return cat.tables[t].where("id IS NOT NULL").withColumns(given | {label(t): F.lit(text), "updated": F.expr(updated).cast("timestamp")})

    def label(t: str) -> str:
        """Where a type has no name, another text column takes it."""
        return "name" if "name" in cat.tables[t].columns else "protocol"

    def write(t: str) -> None:
        envelope.write_pages(made(t, "first", _FIRST_UPDATE).where("id % 5 <> 0"), f"{root}/full/{t}", page)
        arriving = made(t, "early", _EARLY_UPDATE).unionByName(made(t, "late", _NEXT_UPDATE)).where("id % 4 = 0")
        envelope.write_pages(arriving, f"{root}/increment/{t}", page * 2 + F.when(F.col(label(t)) == "late", 1).otherwise(0))

    merge.at_once(spark, list(NATIVE_DDL), write)

    def read(t: str, kind: str):
        return lambda since: envelope.since(envelope.read_pages(spark, f"{root}/{kind}/{t}", T.StructType.fromDDL(NATIVE_DDL[t])), since)

    merge.sync(store, {t: read(t, "full") for t in NATIVE_DDL}, mode="full")
    merge.sync(store, {t: read(t, "increment") for t in NATIVE_DDL}, lookup=lambda t, ids: made(t, "found", _FOUND_UPDATE), most=10**9)
    shown = lambda t: F.concat_ws(",", *[F.coalesce(F.col(k).cast("string"), F.lit("-")) for k in _links(t)], F.lit(""))
    out = [store.read(t).select(F.lit(t).alias("type"), "id", F.col(label(t)).alias("name"), F.col("updated").cast("timestamp_ntz").alias("updated"), shown(t).alias("links")) for t in NATIVE_DDL]
    return reduce(DataFrame.unionByName, out)


_CHANGED = "CASE WHEN o_orderkey % 1000 < 3 THEN o_orderdate - INTERVAL 1 DAY ELSE o_orderdate + INTERVAL 1 DAY END"


@register(
    f"""
    WITH old AS (SELECT o_orderkey, o_totalprice, o_orderdate FROM orders WHERE o_orderkey % 1000 <> 7),
    new AS (SELECT o_orderkey, o_totalprice * 2 AS o_totalprice, {_CHANGED} AS o_orderdate FROM orders WHERE o_orderkey % 1000 < 8 AND o_orderkey % 1000 <> 5)
    SELECT coalesce(o.o_orderkey, n.o_orderkey) AS o_orderkey, CASE WHEN o.o_orderkey IS NULL OR n.o_orderdate > o.o_orderdate THEN n.o_totalprice ELSE o.o_totalprice END AS o_totalprice,
           CASE WHEN o.o_orderkey IS NULL OR n.o_orderdate > o.o_orderdate THEN n.o_orderdate ELSE o.o_orderdate END AS o_orderdate
    FROM old o FULL JOIN new n ON o.o_orderkey = n.o_orderkey
    """
)
def merge_touched(spark: SparkSession, d: str) -> DataFrame:
    """A table dealt by key hash, then a small increment of it: late, newer and new rows."""
    path = shared_folder(spark, "merge")
    orders = _table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderdate")
    place = F.col("o_orderkey") % 1000
    merge.merge_keyed(path, orders.where(place != 7), "o_orderkey", "o_orderdate", buckets=128)
    new = orders.where((place < 8) & (place != 5)).withColumns({"o_totalprice": F.col("o_totalprice") * 2, "o_orderdate": F.expr(_CHANGED)})
    merge.merge_keyed(path, new, "o_orderkey", "o_orderdate", buckets=128)
    return merge.newest_version(spark, path, orders.schema)


# Display formats.


@register("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') || ' UTC' AS shown FROM events")
def fmt_freshness(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "events").select("event_id", fmt.format_freshness(F.col("ts")).alias("shown"))


@register("SELECT c_custkey, concat_ws(', ', CASE WHEN c_custkey % 3 <> 0 THEN c_name END, CASE WHEN c_custkey % 4 <> 0 THEN c_mktsegment END) AS shown FROM customer")
def fmt_address(spark: SparkSession, d: str) -> DataFrame:
    first, second = F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_name")), F.when(F.col("c_custkey") % 4 != 0, F.col("c_mktsegment"))
    return _table(spark, d, "customer").select("c_custkey", fmt.format_address(first, second).alias("shown"))


@register("SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'open' WHEN 1 THEN 'selective' WHEN 2 THEN 'restrictive' ELSE 'other' END AS policy FROM customer")
def policy_class(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey") % 5
    said = F.when(k == 0, "Open").when(k == 1, "SELECTIVE").when(k == 2, "restrictive\x07").when(k == 3, "No").otherwise(F.lit(None))
    return _table(spark, d, "customer").select("c_custkey", fmt.policy_class(said).alias("policy"))


@register("SELECT c_custkey, concat_ws(', ', CASE WHEN c_custkey % 2 = 0 THEN 'unicast' END, CASE WHEN c_custkey % 3 = 0 THEN 'multicast' END, CASE WHEN c_custkey % 5 = 0 THEN 'IPv6' END) AS shown FROM customer")
def fmt_protocols(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "customer").select("c_custkey", fmt.format_protocols(*[F.col("c_custkey") % n == 0 for n in (2, 3, 5)]).alias("shown"))


@register("SELECT s_suppkey FROM supplier WHERE s_suppkey % 6 <> 0 AND s_suppkey % 5 <> 0")
def mappable(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("s_suppkey")
    latitude = F.when(key % 6 == 0, 0.0).when(key % 5 == 0, F.lit(None)).when(key % 2 == 0, 0.0).otherwise(51.5)
    longitude = F.when(key % 6 == 0, 0.0).otherwise(7.25)
    return _table(spark, d, "supplier").where(fmt.on_map(latitude, longitude)).select("s_suppkey")


@register("SELECT doc_id, CASE WHEN length(text) > 40 THEN left(text, 37) || '...' ELSE text END AS shown FROM documents")
def fmt_truncated(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "documents").select("doc_id", text.truncated(F.col("text"), 40).alias("shown"))


@register(r"SELECT doc_id, regexp_replace(text, '[\x00-\x1f\x7f-\x9f]', '', 'g') AS clean FROM documents")
def strip_control_texts(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "documents").select("doc_id", text.strip_control(F.col("text")).alias("clean"))


# Estimates and completions.


_SIZES = (
    "('org', 704, 8448), ('net', 1664, 2560), ('fac', 1344, 3392), ('ix', 1280, 2688), ('poc', 384, 2752), ('ixlan', 576, 2560), ('ixpfx', 384, 2240), ('netixlan', 640, 4928), "
    "('netfac', 384, 4736), ('ixfac', 384, 4416), ('carrier', 512, 1664), ('carrierfac', 320, 3520), ('campus', 576, 2688)"
)


@register(
    f"WITH n AS ({' UNION ALL '.join(f"SELECT '{t}' AS type, count(*) AS n FROM {table}" for t, (table, _) in VIEWS.items())})\n"
    f"SELECT type, n * plain AS plain, n * expanded AS expanded FROM (VALUES {_SIZES}) v(type, plain, expanded) JOIN n USING (type)"
)
def budget_sizes(spark: SparkSession, d: str) -> DataFrame:
    """What the rows of each type come to, flat and with their sets."""
    tables = catalogue(spark, d).tables
    counted = [tables[t].agg((F.count(F.lit(1)) * cost.row_bytes(t)).alias("plain"), (F.count(F.lit(1)) * cost.row_bytes(t, 1)).alias("expanded")).select(F.lit(t).alias("type"), "*") for t in VIEWS]
    return reduce(DataFrame.unionByName, counted)


# Details at depth 1, detail services, relation lists, search hits with details, differences of tables.


def _detail_flat(name: str, parent: str, key: str, sets: str, over: str = "") -> None:
    """Register depth 1 of a type: a parent's name, and of each set the ids in order; a set over a bridge keeps what the bridge names."""
    pairs, bridges = ([p.split(":") for p in part.split()] for part in (sets, over))
    made = [f"(SELECT p.name FROM {parent} p WHERE p.id = e.{key}) AS {parent}_name"] if parent else []
    made += [f"coalesce((SELECT string_agg(c.id::VARCHAR, ',' ORDER BY c.id) FROM {c} c WHERE c.{k} = e.id AND c.{_LIVE}), '') AS {c}_set" for c, k in pairs]
    made += [f"coalesce((SELECT string_agg(b.{far}::VARCHAR, ',' ORDER BY b.id) FROM {bridge} b WHERE b.{near} = e.id AND b.{_LIVE}), '') AS {f}_set" for f, bridge, near, far in bridges]

    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = nested.expand(catalogue(spark, d), name, 1)
        names = [F.col(parent)["name"].alias(f"{parent}_name")] if parent else []
        return rows.select("id", *names, *[F.array_join(F.col(f"{c}_set").cast("array<string>"), ",").alias(f"{c}_set") for c, *_ in (*pairs, *bridges)])

    run.__name__ = f"detail_flat_{name}"
    register(f"{_WITH}\nSELECT {', '.join(['e.id', *made])} FROM {name} e WHERE e.{_LIVE}")(run)


_detail_flat("org", "", "", "net:org_id fac:org_id ix:org_id carrier:org_id campus:org_id")
_detail_flat("net", "org", "org_id", "poc:net_id netfac:net_id netixlan:net_id")
_detail_flat("ix", "org", "org_id", "ixlan:ix_id", "fac:ixfac:ix_id:fac_id")
_detail_flat("ixlan", "ix", "ix_id", "ixpfx:ixlan_id", "net:netixlan:ixlan_id:net_id")
_detail_flat("carrier", "org", "org_id", "carrierfac:carrier_id")
_detail_flat("campus", "org", "org_id", "fac:campus_id")


@register(
    f"""{_WITH}
    SELECT e.id, coalesce((SELECT p.name FROM org p WHERE p.id = e.org_id), '') AS org_name, (SELECT count(*) FROM poc c WHERE c.net_id = e.id AND c.{_LIVE}) AS poc_count,
           (SELECT coalesce(sum(speed), 0) FROM netixlan c WHERE c.net_id = e.id AND c.{_LIVE})::BIGINT AS aggregate_bandwidth FROM net e WHERE e.{_LIVE}"""
)
def service_net(spark: SparkSession, d: str) -> DataFrame:
    return details.details(catalogue(spark, d), "net").select("id", "org_name", "poc_count", "aggregate_bandwidth")


@register(
    f"""{_WITH}
    SELECT e.id, (SELECT count(*) FROM ixpfx c JOIN ixlan v ON c.ixlan_id = v.id WHERE v.ix_id = e.id AND c.{_LIVE} AND v.{_LIVE}) AS prefix_count,
           (SELECT coalesce(sum(speed), 0) FROM netixlan c JOIN ixlan v ON c.ixlan_id = v.id WHERE v.ix_id = e.id AND c.{_LIVE} AND v.{_LIVE})::BIGINT AS aggregate_bandwidth FROM ix e WHERE e.{_LIVE}"""
)
def service_ix(spark: SparkSession, d: str) -> DataFrame:
    return details.details(catalogue(spark, d), "ix").select("id", "prefix_count", "aggregate_bandwidth")


@register(
    f"""{_WITH}
    SELECT e.id, {', '.join(f"(SELECT count(*) FROM {c} c WHERE c.org_id = e.id AND c.{_LIVE}) AS {label}_count" for c, label in (("net", "networks"), ("ix", "exchanges"), ("fac", "facilities"), ("campus", "campuses"), ("carrier", "carriers")))}
    FROM org e WHERE e.{_LIVE}"""
)
def service_org(spark: SparkSession, d: str) -> DataFrame:
    return details.details(catalogue(spark, d), "org").select("id", "networks_count", "exchanges_count", "facilities_count", "campuses_count", "carriers_count")


@register(
    f"""{_WITH}
    SELECT f.fac_id AS owner, f.id, row_number() OVER (PARTITION BY f.fac_id ORDER BY n.name NULLS FIRST, f.id) AS pos
    FROM netfac f LEFT JOIN net n ON n.id = f.net_id WHERE f.{_LIVE} AND f.fac_id IS NOT NULL QUALIFY pos <= 101"""
)
def relation_first_page(spark: SparkSession, d: str) -> DataFrame:
    """The first page of every facility's networks, by the network's name, with one row more."""
    rows = details.related_rows(catalogue(spark, d), "fac", "networks")
    top = joins.top_per_group(rows, ["owner"], details.relation_order("fac", "networks"), details.FRAGMENT + 1, "pos")
    return top.select("owner", "id", F.col("pos").cast("bigint").alias("pos"))


@register(
    "\nUNION ALL ".join(
        [f"{_WITH}\nSELECT 'net' AS type, id, name, '' AS country, '' AS city, asn::BIGINT AS number FROM net WHERE {_LIVE} AND contains(lower(name), '12')"]
        + [f"SELECT '{t}', id, name, '', '', 0::BIGINT FROM {t} WHERE {_LIVE} AND contains(lower(name), '12')" for t in ("fac", "ix")]
    )
)
def search_details(spark: SparkSession, d: str) -> DataFrame:
    cat = catalogue(spark, d)
    return reduce(DataFrame.unionByName, [search.hits(cat, t, "12", details=True) for t in ("net", "fac", "ix")])


_LEFT = "'{\"a\":1' || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE ',\"b\":2' END || '}'"
_RIGHT = "'{\"a\":1,\"b\":2' || CASE WHEN o_orderkey % 5 = 0 THEN ',\"c\":3' ELSE '' END || '}'"


@register(
    """
    SELECT 'orders' AS type, count(*) FILTER (WHERE k % 7 <> 0) AS left_rows, count(*) AS right_rows, count(*) FILTER (WHERE k % 7 = 0) AS only_right,
           'a=' || count(*) FILTER (WHERE k % 7 = 0) || ',b=' || count(*) FILTER (WHERE k % 7 = 0 OR k % 3 = 0) || ',c=' || count(*) FILTER (WHERE k % 5 = 0) AS fields
    FROM (SELECT o_orderkey AS k FROM orders)
    """
)
def diff_report(spark: SparkSession, d: str) -> DataFrame:
    """What a report says of two captures of the orders as JSON objects."""
    orders = _table(spark, d, "orders").select("o_orderkey")
    left = orders.where("o_orderkey % 7 <> 0").select("o_orderkey", F.expr(_LEFT).alias("j"))
    right = orders.select("o_orderkey", F.expr(_RIGHT).alias("j"))
    rows = diff.report({"orders": (left, right)}, "o_orderkey", "j")
    shown = F.array_join(F.transform(F.map_entries("fields"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return rows.withColumn("fields", shown)


_COMPLETED = {"customer": ("c_custkey", "c_name", "c_mktsegment"), "supplier": ("s_suppkey", "s_name"), "part": ("p_partkey", "p_name", "p_brand", "p_type")}


@register(
    "\nUNION ALL ".join(
        f"(SELECT '{name}' AS type, {key} AS id, row_number() OVER (ORDER BY {fields[0]}, {key}) AS rank FROM {name} WHERE {' OR '.join(f'contains(lower({f}), $$er$$)' for f in fields)} ORDER BY {fields[0]}, {key} LIMIT 20)"
        for name, (key, *fields) in _COMPLETED.items()
    )
)
def completions(spark: SparkSession, d: str) -> DataFrame:
    found = search.completions(driver_catalogue(spark, d, *_COMPLETED), list(_COMPLETED), "er")
    return found.select("type", "id", F.col("rank").cast("bigint").alias("rank"))
