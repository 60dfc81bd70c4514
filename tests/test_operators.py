from __future__ import annotations

import native
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftwork.functions import format as fmt
from weftwork.functions import net, text
from weftwork.operators import aggregates, compare, diff, joins, lookup, nested, search


@pytest.fixture(scope="module")
def cat(spark):
    return native.catalogue(spark)


def one(df, key):
    return df.where(F.col("id") == key).collect()[0].asDict(recursive=True)


def keys(items):
    return [i["id"] for i in items]


def test_depths(cat):
    org = one(nested.expand(cat, "org", 1), 1)
    assert org["net_set"] == [10, 11, 14] and org["fac_set"] == [30] and org["campus_set"] == [40, 41]
    org = one(nested.expand(cat, "org"), 1)
    assert keys(org["net_set"]) == [10, 11, 14] and "org_id" not in org["net_set"][0] and org["carrier_set"][0]["name"] == "Carrier"
    net10 = one(nested.expand(cat, "net", 2), 10)
    assert keys(net10["netixlan_set"]) == [70, 73] and net10["poc_set"] == [] and net10["org"]["net_set"] == [10, 11, 14]
    assert "net_set" not in one(nested.expand(cat, "net", 1), 10)["org"]
    assert keys(one(nested.expand(cat, "net", 4, tier="users"), 10)["poc_set"]) == [9000]
    assert set(nested.expand(cat, "net", 0).columns) == set(cat.tables["net"].columns)


def test_through_sets(cat):
    assert one(nested.expand(cat, "ix", 1), 20)["fac_set"] == [31, 30]
    ix = one(nested.expand(cat, "ix", 2), 20)
    assert keys(ix["fac_set"]) == [31, 30] and keys(ix["ixlan_set"]) == [21, 22] and "ix_id" not in ix["ixlan_set"][0]
    assert one(nested.expand(cat, "ixlan", 1), 21)["net_set"] == [10, 11, 13, 10]
    lan = one(nested.expand(cat, "ixlan", 2), 21)
    assert keys(lan["net_set"]) == [10, 11, 10] and keys(lan["ixpfx_set"]) == [23, 24] and lan["ix"]["fac_set"] == [31, 30]


def test_every_type_expands(cat):
    for name in cat.entities:
        for depth in (1, 2):
            assert nested.expand(cat, name, depth).count() == cat.table(name).where("status IN ('ok', 'pending')").count()
    assert one(nested.expand(cat, "fac", 2), 30)["campus"] is None
    assert [nested.clamp_depth(d) for d in (None, -1, 1, 9)] == [2, 0, 1, 4]


def test_redaction_by_tier(cat):
    lans = cat.tables["ixlan"]
    shown = lambda tier: {r["id"]: r["ixf_ixp_member_list_url"] for r in nested.redact(lans, "ixf_ixp_member_list_url", "ixf_ixp_member_list_url_visible", tier).collect()}
    assert shown("public") == {21: None, 22: "http://y"} and shown("users") == {21: "http://x", 22: "http://y"}
    ix = nested.redact_nested(nested.expand(cat, "ix", 2), "ixlan_set", "ixf_ixp_member_list_url", "ixf_ixp_member_list_url_visible", "public")
    assert [x["ixf_ixp_member_list_url"] for x in one(ix, 20)["ixlan_set"]] == [None, "http://y"]
    assert one(nested.wire_row(cat.tables["fac"]), 30)["campus_id"] == 0


def test_compare(spark):
    a = spark.createDataFrame([(1, 5, "x"), (2, 5, "y"), (3, 6, "z"), (4, None, "n")], "id int, k int, v string")
    b = spark.createDataFrame([(1, 5, "p"), (2, 5, "q"), (3, 7, "r")], "id int, k int, v string")
    assert [tuple(r) for r in compare.shared(a, b, "k", "id", ["v"]).select("k", "v_a", "v_b").collect()] == [(5, "y", "p")]
    assert sorted(tuple(r) for r in compare.everything(a, b, "k", "id", ["v"]).select("k", "v_a", "v_b", "shared").collect()) == [(5, "y", "q", True), (6, "z", None, False), (7, None, "r", False)]
    groups = compare.shared_groups(a.select(F.lit(1).alias("g"), "v"), b.select(F.lit(1).alias("g"), "v"), "g", "v").collect()
    assert [tuple(r) for r in groups] == [(1, [])]
    assert compare.bounded(a.orderBy("id"), 2)[1] == 4


def test_search(cat):
    rows = search.grouped(cat, ["net", "org", "fac"], "or").collect()
    assert {(r["type"], r["id"], r["total"]) for r in rows} == {("org", 1, 1)}
    assert search.hits(cat, "net", "x").count() == 0
    page, total = search.page(cat, "net", "as6939")
    assert total == 1 and page.collect()[0]["id"] == 11
    assert search.completions(cat, ["net"], "cloud").collect()[0]["id"] == 10
    assert search.completions(cat, ["org", "net"], "or", only="org").select("type").distinct().collect() == [("org",)]
    assert search.completions(cat, ["net"], "cloud", only="fac").count() == 0
    hit = search.hits(cat, "fac", "fac a", details=True).collect()[0]
    assert (hit["country"], hit["city"], hit["number"]) == ("DE", "Frankfurt am Main", 0) and search.hits(cat, "net", "cloud", details=True).collect()[0]["number"] == 13335


def test_addresses(spark):
    prefixes = spark.createDataFrame([("192.0.2.0/24",), ("192.0.2.128/25",), ("2001:db8::/32",), ("::ffff:0:0/96",), ("bad",), ("0.0.0.0/0",), (None,)], "prefix string")
    addresses = spark.createDataFrame([("192.0.2.200",), ("2001:db8::1",), ("::ffff:192.0.2.1",), ("nonsense",), (None,)], "address string")
    got = sorted(tuple(r) for r in lookup.addresses_in_prefixes(addresses, prefixes).select("address", "prefix").collect())
    assert got == [("192.0.2.200", "0.0.0.0/0"), ("192.0.2.200", "192.0.2.0/24"), ("192.0.2.200", "192.0.2.128/25"), ("2001:db8::1", "2001:db8::/32"), ("::ffff:192.0.2.1", "::ffff:0:0/96")]


def test_address_numbers(spark):
    df = spark.createDataFrame([("10.0.1.2", "10.0.1.77/24"), ("256.0.0.1", "1.2.3.4/33"), ("01.2.3.4", "x"), (None, None)], "a string, p string")
    rows = df.select(net.ipv4_number(F.col("a")).alias("n"), net.ipv4_range(F.col("p")).alias("r")).collect()
    assert rows[0]["n"] == 10 * 2**24 + 258 and tuple(rows[0]["r"]) == (10 * 2**24 + 256, 10 * 2**24 + 511)
    assert [r["n"] for r in rows[1:]] == [None] * 3 and [r["r"] for r in rows[1:]] == [None] * 3
    order = [r["x"] for r in df.select(net.address_number(F.col("a")).alias("x")).collect()]
    assert order[0]["family"] == 4 and order[1] is None or order[1]["family"] is None


def test_diff(spark):
    rows = spark.createDataFrame([(1, "a", "x@y", 5), (2, "b", None, None)], "id long, notes string, email string, n int")
    public = spark.createDataFrame([(1, "a")], "id long, notes string")
    assert [tuple(r) for r in diff.redact(rows, public).orderBy("id").collect()] == [(1, "a", "<auth-only:string>", "<auth-only:number>"), (2, "<auth-only:string>", None, None)]
    assert diff.is_pii("email") and not diff.is_pii("notes")
    left, right = (spark.createDataFrame(r, "id int, json string") for r in ([(1, '{"a":1}')], [(1, '{"a":1,"b":2}'), (2, '{"a":1}')]))
    assert {tuple(r) for r in diff.field_presence(left, right, "id", "json").collect()} == {("b", 1), ("a", 1)}
    assert diff.compare_structure({"a": 1, "b": [{"x": 1}], "c": None}, {"a": "s", "b": [{"y": 1}], "c": 3, "d": 0}) == [
        ("a", "type_mismatch"),
        ("b[0].x", "missing_field"),
        ("b[0].y", "extra_field"),
        ("d", "extra_field"),
    ]
    a, b = T.StructType.fromDDL("x int, y array<struct<p:int>>"), T.StructType.fromDDL("x string, y array<struct<q:int>>")
    assert diff.compare_schemas(a, b) == [("x", "type_mismatch"), ("y[0].p", "missing_field"), ("y[0].q", "extra_field")]
    assert "| b | 1 |" in diff.markdown_report({"net": {"left_rows": 1, "right_rows": 2, "only_right": 1, "fields": {"b": 1}}})


@pytest.mark.parametrize(("given", "want"), [("KÖLN", "koln"), ("Straße", "strasse"), ("Ærø", "aero"), ("Łódź", "lodz"), ("Þór", "thor"), ("①中文", "1中文"), ("é", "e"), ("ı", "i"), ("", "")])
def test_fold(spark, given, want):
    assert text.fold(given) == want
    row = spark.createDataFrame([(given,), (None,)], "s string").select(text.fold_column("s").alias("f"), text.fold_latin(F.col("s")).alias("g")).collect()
    assert row[0]["f"] == want and row[1]["f"] is None and (given[0:1] in "①e" or row[0]["g"] == want)


def test_functions(spark):
    df = spark.createDataFrame([(400_000, "AS13335"), (1_500_000, " as1 "), (1000, "0"), (999, "ASX"), (100_001, "4294967296")], "m long, s string")
    rows = df.select(fmt.format_speed(F.col("m")), fmt.format_bandwidth(F.col("m")), fmt.speed_tier(F.col("m")), text.parse_asn_column(F.col("s"))).collect()
    assert [tuple(r) for r in rows] == [
        ("400G", "400 Gbps", "400G", 13335),
        ("1T", "1.5 Tbps", "400G", 1),
        ("1G", "1 Gbps", "1G", None),
        ("999M", "999 Mbps", "sub-1G", None),
        ("100G", "100 Gbps", "100G", None),
    ]
    assert [text.parse_asn(s) for s in ("AS13335", " as1 ", "0", "ASX", "4294967296", "AS", "+5")] == [13335, 1, None, None, None, None, 5]
    df = spark.createDataFrame([("Köln", "DE", True, None), ("", "DE", False, True), (None, None, False, False)], "a string, b string, u boolean, v boolean")
    assert [tuple(r) for r in df.select(fmt.format_location(F.col("a"), F.col("b")), fmt.format_protocols(F.col("u"), F.lit(False), F.col("v"))).collect()] == [("Köln, DE", "unicast"), ("DE", "IPv6"), ("", "")]
    long = spark.createDataFrame([("abcdefgh\x1b\x07",)], "s string").select(text.truncated(text.strip_control(F.col("s")), 6), fmt.whois_block([("name", F.col("s")), ("none", F.lit(""))])).collect()[0]
    assert tuple(long) == ("abc...", "name:           abcdefgh")
    assert fmt.shown_columns("net-ix", ["name", "speed", "rs", "ipv4", "crossref", "ipv6"], 80) == ["name", "speed", "rs", "ipv4"]
    assert fmt.shown_columns("ix-participants", ["asn", "speed"], 49) == ["asn"] and fmt.shown_columns("ix-prefixes", ["prefix", "dfz"], 0) == ["prefix", "dfz"]
    assert fmt.parse_sections("IX, nets,participants,exchanges, Campuses,carriers") == ["ix", "net", "campus", "carrier"]


def test_aggregates(spark, cat):
    counts = {r["type"]: r["n"] for r in aggregates.table_counts(cat.tables).collect()}
    assert counts["net"] == 5 and len(counts) == 13
    m = spark.createDataFrame([({"a": 1, "b": 5},)], "m map<string,bigint>")
    assert m.select(aggregates.total_of(F.col("m"))).collect()[0][0] == 6
    assert joins.missing_parents(spark.createDataFrame([(1,), (9,), (9,), (None,)], "fk long"), "fk", cat.tables["org"]).collect()[0]["id"] == 9


def test_whole_table_queries_have_no_subset(spark, tmp_path):
    from weftwork.queries import QUERIES

    links = [(s, p, k) for k, (s, p) in enumerate([(1, 7), (40, 7), (40, 7), (40, 3), (900, 5), (900, 99)])]
    spark.createDataFrame(links, "l_suppkey long, l_partkey long, l_orderkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(3, "c"), (5, "e"), (7, "g")], "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    names = {3: "c", 5: "e", 7: "g"}
    assert sorted(map(tuple, QUERIES["join_through"](spark, str(tmp_path)).collect())) == sorted((s, p, names[p]) for s, p, _ in links if p in names)
    assert sorted(map(tuple, QUERIES["nest_through_ids"](spark, str(tmp_path)).collect())) == [(1, "7"), (40, "7,7,3"), (900, "5,99")]


def test_bandwidth_halves_round_as_doubles(spark):
    values = [m * 50_000 for m in range(1, 2000)] + [999, 1000, 999_999, 1_049_999, 1_050_001, 123_456_789]
    shown = spark.createDataFrame([(v,) for v in values], "mbps long").select("mbps", fmt.format_bandwidth(F.col("mbps")).alias("s"))
    brute = lambda v: f"{v / 1e6:.1f} Tbps" if v >= 1_000_000 else f"{v // 1000} Gbps" if v >= 1000 else f"{v} Mbps"
    assert [r for r in map(tuple, shown.collect()) if r[1] != brute(r[0])] == []


def test_ranges_of_any_width(spark):
    """Pairs come out once, whether a range is one number or all of them."""
    ranges = [(0, 2**32 - 1), (5, 5), (6, 5), (10 << 24, (11 << 24) - 1), (3, 1000), (2**32 - 1, 2**32 - 1), (0, 0), (7, 8), (1, 2**31)]
    points = [0, 1, 3, 5, 7, 8, 999, 1000, 1001, 10 << 24, (11 << 24) - 1, 11 << 24, 2**31, 2**31 + 1, 2**32 - 1, 5]
    p = spark.createDataFrame([(i, n) for i, n in enumerate(points)], "i long, n long")
    r = spark.createDataFrame([(j, a, b) for j, (a, b) in enumerate(ranges)], "j long, low long, high long")
    got = sorted((x["i"], x["j"]) for x in lookup.numbers_in_ranges(p, r, "n", "low", "high").select("i", "j").collect())
    assert got == sorted((i, j) for i, n in enumerate(points) for j, (a, b) in enumerate(ranges) if a <= n <= b)
    assert lookup.numbers_in_ranges(p, r.limit(0), "n", "low", "high").count() == 0


def test_percentiles_by_ranges(spark):
    rows = [("a", float(v % 7)) for v in range(100)] + [("b", None), ("c", 1.0), ("c", None), (None, 3.0)] + [("hot", 5.0)] * 300
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r["k"]: (r["p50"], r["p95"], r["p99"]) for r in aggregates.percentiles(df, "v", ["k"]).collect()}
    rank = lambda values, p: sorted(values)[-(-len(values) * p // 100) - 1]
    assert got["a"] == tuple(rank([v for k, v in rows if k == "a"], p) for p in (50, 95, 99))
    assert got["b"] == (None,) * 3 and got["c"] == (1.0,) * 3 and got[None] == (3.0,) * 3 and got["hot"] == (5.0,) * 3 and len(got) == 5
    assert aggregates.percentiles(df.where("k = 'a'"), "v").columns == ["p50", "p95", "p99"]
    assert aggregates.percentiles(df.limit(0), "v", ["k"]).count() == 0
