"""A tiny native catalogue with one row of each type, and a few more."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import types as T

from weftwork.plans.schema import NATIVE_DDL, Catalogue, native_entities

DAY = datetime(2024, 1, 1)
ROWS = {
    "org": [dict(id=1, name="Zürich Öresund Org", aka="ZO", city="Köln", country="DE"), dict(id=2, name="Other", status="pending"), dict(id=3, name="Gone", status="deleted")],
    "campus": [dict(id=40, org_id=1, name="Campus"), dict(id=41, org_id=1, name="Waiting", status="pending")],
    "fac": [dict(id=30, org_id=1, name="Fac A", city="Frankfurt am Main", country="DE"), dict(id=31, org_id=1, campus_id=40, name="Fac B", status="deleted")],
    "carrier": [dict(id=50, org_id=1, name="Carrier")],
    "carrierfac": [dict(id=51, carrier_id=50, fac_id=30)],
    "ix": [dict(id=20, org_id=1, name="IX One", name_long="Exchange")],
    "ixlan": [dict(id=21, ix_id=20, name="lan", ixf_ixp_member_list_url="http://x", ixf_ixp_member_list_url_visible="Users"), dict(id=22, ix_id=20, name="lan2", ixf_ixp_member_list_url="http://y", ixf_ixp_member_list_url_visible="Public")],
    "ixpfx": [dict(id=23, ixlan_id=21, protocol="IPv4", prefix="192.0.2.0/24"), dict(id=24, ixlan_id=21, protocol="IPv6", prefix="2001:db8::/32")],
    "ixfac": [dict(id=25, ix_id=20, fac_id=31), dict(id=26, ix_id=20, fac_id=30)],
    "net": [
        dict(id=10, org_id=1, asn=13335, name="Cloud Net", updated=datetime(2024, 1, 2), created=datetime(2023, 1, 1), info_unicast=True),
        dict(id=11, org_id=1, asn=6939, name="Hurricane", updated=datetime(2024, 1, 2), created=datetime(2023, 5, 1)),
        dict(id=12, org_id=2, asn=64500, name="café straße", updated=datetime(2024, 1, 3)),
        dict(id=13, org_id=1, asn=64501, name="Dead", updated=datetime(2024, 1, 4), status="deleted"),
        dict(id=14, org_id=1, asn=64502, name="Wait", updated=datetime(2024, 1, 4), status="pending"),
    ],
    "poc": [dict(id=9000, net_id=10, name="Hidden Person", visible="Users"), dict(id=9001, net_id=11, name="Open Person", visible="Public"), dict(id=9002, net_id=12, name="Null Person", visible=None)],
    "netfac": [dict(id=60, net_id=10, fac_id=30, name="Fac A"), dict(id=61, net_id=11, fac_id=30, name="Fac A")],
    "netixlan": [
        dict(id=70, net_id=10, ix_id=20, ixlan_id=21, name="IX One", speed=10000, ipaddr4="192.0.2.1"),
        dict(id=71, net_id=11, ix_id=20, ixlan_id=21, name="IX One", speed=1000, ipaddr4="192.0.2.2"),
        dict(id=72, net_id=13, ix_id=20, ixlan_id=21, name="IX One", speed=1000),
        dict(id=73, net_id=10, ix_id=20, ixlan_id=21, name="IX One", speed=20000),
    ],
}


def frame(spark, name, rows):
    schema = T.StructType.fromDDL(NATIVE_DDL[name])
    plain = {"created": DAY, "updated": DAY, "status": "ok"}
    return spark.createDataFrame([tuple((plain | r).get(f.name) for f in schema.fields) for r in rows], schema)


def catalogue(spark) -> Catalogue:
    return Catalogue(native_entities(), {name: frame(spark, name, rows) for name, rows in ROWS.items()})
