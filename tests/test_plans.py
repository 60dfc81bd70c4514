from __future__ import annotations

from datetime import datetime

import native
import pytest
from pyspark.sql import functions as F

from weftwork.plans import cost, filters, paging, query, typed
from weftwork.plans.filters import FilterError


@pytest.fixture(scope="module")
def cat(spark):
    return native.catalogue(spark)


def ids(df):
    return [r["id"] for r in df.select("id").collect()]


def found(cat, name, params, **more):
    return sorted(ids(query.matching(cat, name, params, **more)[0]))


def test_keys():
    assert filters.parse_key("name") == ([], "name", "")
    assert filters.parse_key("org__name__contains") == (["org"], "name", "icontains")
    assert filters.parse_key("a__b__c") == (["a", "b"], "c", "")
    assert filters.parse_key("in") == ([], "in", "")
    assert filters.parse_key("__name") == ([], "", "") == filters.parse_key("name__")


@pytest.mark.parametrize(
    ("params", "want"),
    [
        ({}, [10, 11, 12]),
        ({"name": "CLOUD NET"}, [10]),
        ({"name": ["x", "cafe strasse"]}, [12]),
        ({"name__contains": "STRASSE"}, [12]),
        ({"name__startswith": "CAFÉ"}, [12]),
        ({"name__in": "hurricane, Café Straße"}, [11, 12]),
        ({"asn__in": "6939,13335"}, [10, 11]),
        ({"asn__in": ""}, []),
        ({"asn__gt": "13335"}, [12]),
        ({"info_unicast": "True"}, [10]),
        ({"updated": "2024-01-02"}, [10, 11]),
        ({"updated__gt": "2024-01-02"}, [12]),
        ({"updated__lte": "2024-01-02"}, [10, 11]),
        ({"updated__in": "2024-01-03"}, [12]),
        ({"updated__gte": "1704240000"}, [12]),
        ({"nothing": "x", "org__nothing": "x", "nowhere__name": "x", "a__b__c__d": "1"}, [10, 11, 12]),
        ({"org__name__contains": "oresund"}, [10, 11]),
        ({"org__status": "ok"}, [10, 11, 12]),
        ({"poc__name__contains": "person"}, [11, 12]),
        ({"netfac__fac__name": "fac a"}, [10, 11]),
        ({"netixlan__ixlan__name": "lan"}, [10, 11]),
        ({"org__name__in": ""}, []),
        ({"since": "1704067200"}, [10, 11, 12, 13]),
        ({"since": "0"}, [10, 11, 12]),
        ({"q": "as6939"}, [11]),
        ({"q": "hurr"}, [11]),
        ({"fac__name": "Fac A"}, [10, 11, 12]),
    ],
)
def test_lists(cat, params, want):
    assert found(cat, "net", params) == want


def test_visibility_opens_for_users(cat):
    assert found(cat, "net", {"poc__name__contains": "person"}, tier="users") == [10, 11, 12]
    assert found(cat, "poc", {}) == [9001, 9002] and found(cat, "poc", {}, tier="users") == [9000, 9001, 9002]


def test_deleted_parents_still_match(cat):
    assert found(cat, "ix", {"ixfac__fac__name": "fac b"}) == [20]


def test_two_hops_over_prefixes(cat):
    assert found(cat, "ixpfx", {"ixlan__ix__id": "20"}) == [23, 24]


def test_locations(cat):
    assert found(cat, "fac", {"city": "frankfurt"}) == [30]
    assert found(cat, "fac", {"country": "d"}) == [30] and found(cat, "fac", {"country": "de"}) == [30]
    assert found(cat, "netfac", {"fac__city": "frankfurt"}) == []


def test_campuses_keep_pending_since(cat):
    assert found(cat, "campus", {"since": "1"}) == [40, 41] and found(cat, "campus", {}) == [40]


@pytest.mark.parametrize("params", [{"asn": "x"}, {"info_unicast": "maybe"}, {"asn__contains": "1"}, {"updated": "soon"}, {"limit": "-1"}, {"skip": "x"}, {"since": "y"}, {"org__id": "z"}, {"asn__in": "1,x"}])
def test_errors(cat, params):
    with pytest.raises(FilterError):
        query.matching(cat, "net", params)


def test_unknown_keys_are_listed(cat):
    _, _, compiled = query.matching(cat, "net", {"nothing": "1", "org__no": "2", "asn": "6939", "q": "h"})
    assert compiled.unknown == ["nothing", "org__no"]


def test_order_and_pages(cat):
    assert ids(query.list_rows(cat, "net", {})) == [12, 11, 10]
    assert ids(query.list_rows(cat, "net", {"limit": "1", "skip": "1"})) == [11]
    assert ids(query.list_rows(cat, "net", {"since": "1"})) == [10, 11, 12, 13]
    assert query.list_rows(cat, "net", {"fields": "asn, nothing"}).columns == ["id", "asn", "irr_as_set"]  # a name that ends like a set's
    assert query.served_rows(10, query.QueryOptions(limit=4, skip=8)) == 2 and query.served_rows(3, query.QueryOptions(skip=9)) == 0


def test_point_lookup(cat):
    assert query.get_row(cat, "net", 13).count() == 0 and query.get_row(cat, "net", 14).count() == 1
    assert query.get_row(cat, "net", 13, any_status=True).count() == 1


def test_plans_push_filters_and_use_semi_joins(cat, spark, tmp_path):
    cat.tables["net"].write.parquet(f"{tmp_path}/net")
    stored = type(cat)(cat.entities, cat.tables | {"net": spark.read.parquet(f"{tmp_path}/net")})
    plan = query.list_rows(stored, "net", {"asn": "6939", "org__id": "1", "fields": "asn", "limit": "5"})._jdf.queryExecution().toString()
    assert "LeftSemi" in plan and "EqualTo(asn,6939)" in plan and "TakeOrderedAndProject" in plan
    assert "looking_glass" not in plan.split("== Physical Plan ==")[1]


def test_typed_filters(cat):
    net = cat.tables["net"]
    assert sorted(ids(typed.typed_list(net, typed.LIST_FILTERS["net"], {"name": "DEAD"}))) == [13]
    assert ids(typed.typed_list(net, typed.LIST_FILTERS["net"], {"asn": 6939, "status": "ok"})) == [11]
    for bad in ({"asn": 0}, {"nothing": 1}):
        with pytest.raises(FilterError):
            typed.typed_list(net, typed.LIST_FILTERS["net"], bad)
    with pytest.raises(FilterError):
        typed.typed_list(net, typed.LIST_FILTERS["net"], {"id": 10}, stream=True)
    assert set(typed.LIST_FILTERS) == set(cat.entities)
    for name, spec in typed.LIST_FILTERS.items():
        assert {c.rstrip("~+") for c in spec.split()} <= set(cat.entities[name].schema.names)


@pytest.mark.parametrize(
    ("tree", "want"),
    [
        ({"nameHasPrefix": "H"}, [11]),
        ({"nameContainsFold": "NET"}, [10]),
        ({"not": {"status": "ok"}}, [13, 14]),
        ({"or": [{"asn": 6939}, {"asnGT": 64501}]}, [11, 14]),
        ({"asnIn": []}, []),
        ({"asnNotIn": [6939, 13335], "status": "ok"}, [12]),
        ({"orgIDNEQ": 1}, [12]),
        ({"infoUnicastIsNil": True, "nameEqualFold": "DEAD"}, [13]),
        ({"updatedGTE": datetime(2024, 1, 4)}, [13, 14]),
    ],
)
def test_condition_trees(cat, tree, want):
    assert sorted(ids(cat.tables["net"].where(typed.condition(cat.entities["net"], tree)))) == want


def test_conditions_on_relations(cat):
    assert sorted(ids(typed.related(cat, "org", "net", {"asn": 64500}))) == [2]
    assert sorted(ids(typed.related(cat, "org", "net"))) == [1, 2]


def test_rest_parameters(cat):
    net, entity = cat.tables["net"], cat.entities["net"]
    assert sorted(ids(net.where(typed.rest_predicate(entity, {"name.has": "Net", "asn.gte": 1})))) == [10]
    assert sorted(ids(net.where(typed.rest_predicate(entity, {"name.suffix": "Net", "asn.in": [6939]}, "or")))) == [10, 11]
    assert sorted(ids(net.where(typed.rest_predicate(entity, {"info_unicast.null": True})))) == [11, 12, 13, 14]
    for bad in ({"no.eq": 1}, {"name.like": 1}):
        with pytest.raises(FilterError):
            typed.rest_predicate(entity, bad)


def test_tokens_and_cursors():
    assert paging.decode_token(paging.encode_token(250)) == 250 and paging.encode_token(0) == "" and paging.decode_token("") == 0
    for bad in ("!!", "LTU="):
        with pytest.raises(FilterError):
            paging.decode_token(bad)
    assert [paging.page_size(n) for n in (0, -1, 7, 5000)] == [100, 100, 7, 1000]
    cursor = paging.encode_cursor("nets", 7, "v1", 40)
    assert paging.cursor_offset(cursor, "nets", 7, "v1") == 40
    for scope, parent, version in (("x", 7, "v1"), ("nets", 8, "v1"), ("nets", 7, "v2")):
        with pytest.raises(FilterError):
            paging.cursor_offset(cursor, scope, parent, version)


def test_keyset_pages_cover_all_rows_once(cat):
    keys = [("updated", True), ("created", True), ("id", True)]
    net, seen, last = cat.tables["net"], [], None
    while True:
        page = (net if last is None else net.where(paging.keyset_after(keys, last))).orderBy(*paging.keyset_order(keys)).limit(2).collect()
        if not page:
            break
        seen += [r["id"] for r in page]
        last = [page[-1][k] for k, _ in keys]
    assert seen == [r["id"] for r in paging.stream_rows(net, keys)] and len(seen) == 5


def test_token_pages(cat):
    ordered = cat.tables["net"].orderBy("id")
    rows, token = paging.token_page(ordered, 3)
    assert [r["id"] for r in rows] == [10, 11, 12]
    rows, token = paging.token_page(ordered, 3, token)
    assert [r["id"] for r in rows] == [13, 14] and token == ""


def test_relay(cat):
    keys = [("name", False), ("id", False)]
    whole = [r["id"] for r in cat.tables["net"].orderBy("name", "id").collect()]
    page = paging.relay_connection(cat.tables["net"], keys, first=2)
    assert [e["node"]["id"] for e in page["edges"]] == whole[:2] and page["pageInfo"]["hasNextPage"] and page["totalCount"] == 5
    end = page["edges"][-1]["node"]
    page = paging.relay_connection(cat.tables["net"], keys, last=2, after=[end["name"], end["id"]])
    assert [e["node"]["id"] for e in page["edges"]] == whole[-2:] and page["pageInfo"]["hasPreviousPage"]
    for bad in ({"first": 1, "last": 1}, {"first": -1}, {"last": 1001}):
        with pytest.raises(FilterError):
            paging.relay_page(cat.tables["net"], keys, **bad)
    with pytest.raises(FilterError):
        paging.offset_guard(-1, 5)


def test_numbered_pages(cat):
    ordered = cat.tables["net"].orderBy("id")
    df, meta = paging.numbered_page(ordered, 5, 2, 3)
    assert ids(df) == [13, 14] and meta["last_page"] == 2
    for page, per_page in ((3, 3), (0, 3), (1, 101)):
        with pytest.raises(FilterError):
            paging.numbered_page(ordered, 5, page, per_page)


def test_costs():
    assert cost.check_budget(100, "net", 0, 0).allowed and not cost.check_budget(1001, "net", 0, 1_664_000).allowed
    assert cost.check_budget(1001, "net", 0, 1_664_000).max_rows == 1000
    assert len(cost.ROW_BYTES) == 13 and cost.row_bytes("net", 1) == 2560 and cost.row_bytes("other") == cost.row_bytes("other", 2) == 4096
    assert cost.nested_cost("org", {"net": {"poc": {}, "netixlan": {"ixlan": {"netixlan": {}}}}}) == 1 + 4 * (1 + 4 + 16 * (1 + 1 + 64))
    deep = {"fields": 2, "size": 1000, "children": [{"size": "members", "children": [{"size": "moderate", "fields": 3}]}]}
    assert cost.selection_cost(deep) == 1000 * (2 + 64 * (1 + 16 * 3)) and not cost.check_cost(deep)


def test_deltas(cat):
    assert sorted(ids(paging.delta(cat.tables["net"], since_id=11, updated_since=F.lit("2024-01-03").cast("timestamp")))) == [13, 14]


def test_batches_number_all_rows_over_ranges(spark):
    rows = spark.range(0, 5000, 1, 7).select((F.col("id") * 7919 % 5000).alias("id"), (F.col("id") * 7919 % 5000 / 2500).cast("int").alias("ts"))
    got = paging.numbered(rows, ["ts", "id"])
    assert all(r["id"] == r["at"] for r in got.collect())
    assert {r["id"]: r["batch"] for r in paging.batches(rows, ["ts", "id"], 500).collect()} == {i: i // 500 for i in range(5000)}
    assert paging.numbered(rows.limit(0), ["ts", "id"]).count() == 0
    key = F.struct("ts", "id")
    assert got.withColumn("task", F.spark_partition_id()).groupBy("task").agg(F.max(key)).count() > 1
