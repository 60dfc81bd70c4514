from __future__ import annotations

import native
import pytest

from weftwork.operators import details


@pytest.fixture(scope="module")
def cat(spark):
    return native.catalogue(spark)


def ids(df):
    return [r["id"] for r in df.collect()]


def one(df, key):
    return df.where(f"id = {key}").collect()[0]


def test_sums_and_counts(cat):
    net = one(details.details(cat, "net"), 10)
    assert (net["poc_count"], net["aggregate_bandwidth"], net["org_name"]) == (0, 30000, "Zürich Öresund Org")
    assert one(details.details(cat, "net", tier="users"), 10)["poc_count"] == 1
    ix = one(details.details(cat, "ix"), 20)
    assert (ix["prefix_count"], ix["aggregate_bandwidth"]) == (2, 32000)
    org = one(details.details(cat, "org"), 1)
    assert [org[f"{r}_count"] for r in ("networks", "exchanges", "facilities", "campuses", "carriers")] == [3, 1, 1, 2, 1]
    assert one(details.details(cat, "campus"), 40)["facilities_count"] == 0
    assert one(details.details(cat, "fac"), 30)["campus_name"] == "" and one(details.details(cat, "carrier"), 50)["org_name"]
    assert details.details(cat, "net").where("id = 13").count() == 0


def test_fragments(cat):
    assert ids(details.fragment(cat, "ix", "participants", 20)) == [70, 71, 72, 73]
    assert ids(details.fragment(cat, "ix", "participants", 20, offset=1, size=2)) == [71, 72, 73]
    assert ids(details.fragment(cat, "fac", "networks", 30)) == [60, 61]
    assert ids(details.fragment(cat, "org", "networks", 1)) == [11, 10, 14]
    for entity, relation in details.RELATIONS:
        assert details.fragment(cat, entity, relation, 1).count() >= 0


def test_eager_load_and_order(cat):
    org = one(details.eager_load(cat, "org", most=2), 1)
    assert [n["id"] for n in org["net_set"]] == [14, 13] and org["ix_set"][0]["id"] == 20
    assert one(details.eager_load(cat, "net"), 10)["org"]["id"] == 1
    assert ids(details.sorted_list(cat, "org", "net.count", True))[0] == 1
    assert ids(details.sorted_list(cat, "net", "netixlan.speed.sum", True))[0] == 10
    assert ids(details.sorted_list(cat, "net", "org.name"))[0] == 12
    assert ids(details.sorted_list(cat, "net", "updated", True)) == [14, 13, 12, 11, 10]
    assert sorted(ids(details.sorted_list(cat, "net", "random"))) == [10, 11, 12, 13, 14]
