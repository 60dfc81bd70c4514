"""The page source, the waiting stream and the structure of JSON columns."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from weftwork.operators import structure
from weftwork.sources import pages
from weftwork.streaming import merge, parents

T0 = datetime(2024, 1, 1)


def rows_of(spark, first, days):
    return spark.createDataFrame([(first + k, f"v{k}", T0 + timedelta(days=d), [1, k]) for k, d in enumerate(days)], "id long, v string, updated timestamp, xs array<long>")


def test_only_pages_that_may_hold_rows_are_opened(spark, tmp_path):
    df = rows_of(spark, 0, [0, 1, 2, 3, 3])
    for n, part in enumerate((df.where("id < 3"), df.where("id >= 3"))):
        pages.write_fetch(part, f"{tmp_path}/pages", n)
    whole = pages.read_since(spark, f"{tmp_path}/pages", df.schema)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, df.collect()))
    # An older page that can't be decoded is an error, unless it isn't opened.
    for file in (tmp_path / "pages").glob("fetch=00000000/newest=2024-01-0[12]/part-*"):
        file.write_text("not an envelope\n")
    late = pages.read_since(spark, f"{tmp_path}/pages", df.schema, T0 + timedelta(days=2))
    assert sorted(r["id"] for r in late.collect()) == [2, 3, 4]
    assert late.rdd.getNumPartitions() == len(pages._files(f"{tmp_path}/pages", 0, T0 + timedelta(days=2))) + len(pages._files(f"{tmp_path}/pages", 1, None))
    pushed = pages.read_since(spark, f"{tmp_path}/pages", df.schema).where(F.col("updated") >= F.lit(T0 + timedelta(days=3)))
    assert sorted(r["id"] for r in pushed.collect()) == [3, 4]
    with pytest.raises(Exception, match="JSON|Expecting value"):
        pages.read_since(spark, f"{tmp_path}/pages", df.schema).collect()


def test_rows_of_the_cursor_day_and_missing_columns(spark, tmp_path):
    df = spark.createDataFrame([(1, T0 + timedelta(hours=1)), (2, T0 + timedelta(hours=9)), (3, None)], "id long, updated timestamp")
    pages.write_fetch(df, f"{tmp_path}/p", 0)
    wide = spark.createDataFrame([], "more string, id long, updated timestamp").schema
    got = pages.read_since(spark, f"{tmp_path}/p", wide, T0 + timedelta(hours=5)).collect()
    assert [tuple(r) for r in got] == [(None, 2, T0 + timedelta(hours=9))]
    assert pages.read_since(spark, f"{tmp_path}/p", wide).count() == 3


def test_stream_of_fetches(spark, tmp_path):
    pages.register(spark)
    schema, seen = rows_of(spark, 0, [0]).schema, []
    for n, first in enumerate((0, 10, 20)):
        pages.write_fetch(rows_of(spark, first, [0, 1]), f"{tmp_path}/s", n)
        stream = spark.readStream.format("weft_pages").schema(schema).load(f"{tmp_path}/s")
        running = stream.writeStream.foreachBatch(lambda df, k: seen.append(sorted(r["id"] for r in df.collect()))).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        running.awaitTermination(120)
        running.stop()
    assert [i for batch in seen for i in batch] == [0, 1, 10, 11, 20, 21]


def streams(spark, tmp_path, children, parent_rows):
    for k, rows in enumerate(children):
        spark.createDataFrame(rows, "id long, p long, updated timestamp, v string, arrived timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/child{k}")
    for k, rows in enumerate(parent_rows):
        spark.createDataFrame(rows, "k long, arrived timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/parent{k}")
    read = lambda glob, ddl: spark.readStream.schema(ddl).parquet(f"{tmp_path}/{glob}")
    return read("child*", "id long, p long, updated timestamp, v string, arrived timestamp"), read("parent*", "k long, arrived timestamp")


def run(passed, tmp_path):
    running = parents.merge_waiting(passed, f"{tmp_path}/table", f"{tmp_path}/orphans", f"{tmp_path}/check", "id", "updated", buckets=4)
    assert running.awaitTermination(150)


def test_children_wait_and_late_ones_never_pass(spark, tmp_path):
    """Two runs of one stream: a child waits in the state, its newer version replaces it, a late one doesn't."""
    day = lambda n: T0 + timedelta(days=n)
    children, parent = streams(spark, tmp_path, [[(1, 7, day(1), "first", T0), (2, 8, day(1), "here", T0), (3, 9, day(1), "alone", T0), (None, 8, day(1), "x", T0), (4, None, day(1), "x", T0)]], [[(8, T0)]])
    schema = spark.createDataFrame([], "id long, p long, updated timestamp, v string").schema
    passed = lambda c, p: parents.waiting_children(c, p, "p", "id", "k", "updated", shares=3)
    keep = lambda df: df.drop("arrived")
    run(passed(keep(children), parent), tmp_path)
    assert {r["id"]: r["v"] for r in merge.newest_version(spark, f"{tmp_path}/table", schema).collect()} == {2: "here"}
    spark.createDataFrame([(1, 7, day(2), "second", T0), (2, 8, day(0), "late", T0)], "id long, p long, updated timestamp, v string, arrived timestamp").write.parquet(f"{tmp_path}/child5")
    spark.createDataFrame([(7, T0)], "k long, arrived timestamp").write.parquet(f"{tmp_path}/parent5")
    run(passed(keep(children), parent), tmp_path)
    assert {r["id"]: r["v"] for r in merge.newest_version(spark, f"{tmp_path}/table", schema).collect()} == {1: "second", 2: "here"}


def test_children_wait_in_a_join_of_streams(spark, tmp_path):
    """No Python and no call a parent; values pass unchanged, a parent that arrives again passes nothing again."""
    children, parent = streams(spark, tmp_path, [[(k, k % 2, T0, 'a"\n', T0) for k in range(20)]], [[(0, T0), (0, T0), (5, T0)]])
    passed = parents.waiting_children(children.drop("arrived"), parent, "p", "id", "k", "updated", shares=3)
    assert "InPandas" not in passed._jdf.queryExecution().analyzed().toString()
    seen = []
    for again in (False, True):
        if again:
            spark.createDataFrame([(0, T0), (1, T0)], "k long, arrived timestamp").write.parquet(f"{tmp_path}/parent7")
        batch = lambda df, n: seen.append(sorted((r["state"], r["id"], r["updated"], r["v"]) for r in df.collect()))
        assert passed.writeStream.foreachBatch(batch).option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start().awaitTermination(150)
    at = spark.createDataFrame([(T0,)], "t timestamp").first()["t"]
    assert seen == [[("kept", k, at, 'a"\n') for k in range(first, 20, 2)] for first in (0, 1)]


def test_timers_end_the_wait(spark, tmp_path):
    hour = lambda n: T0 + timedelta(hours=n)
    children, parent = streams(spark, tmp_path, [[(1, 7, T0, "gone", hour(0)), (2, 8, T0, "here", hour(0))]], [[(8, hour(0))]])
    passed = parents.waiting_children(children, parent, "p", "id", "k", "updated", shares=2, arrived="arrived", wait_ms=3_600_000)
    run(passed, tmp_path)
    # Later arrivals move the watermark of both streams past the wait.
    spark.createDataFrame([(3, 8, T0, "later", hour(5))], "id long, p long, updated timestamp, v string, arrived timestamp").write.parquet(f"{tmp_path}/child9")
    spark.createDataFrame([(99, hour(5))], "k long, arrived timestamp").write.parquet(f"{tmp_path}/parent9")
    run(passed, tmp_path)
    orphans = spark.read.schema("id long, p long, updated timestamp, v string").option("recursiveFileLookup", True).parquet(f"{tmp_path}/orphans")
    assert [(r["id"], r["v"]) for r in orphans.collect()] == [(1, "gone")]
    assert {r["id"] for r in merge.newest_version(spark, f"{tmp_path}/table", orphans.schema).collect()} == {2, 3}


def test_structure(spark):
    left = spark.createDataFrame([('{"a":1,"b":{"c":[1,"x",null]},"d":null,"e":[{"f":true}]}',), ('{"a":2.5,"e":[]}',), (None,), ("not json",)], "j string")
    found = {(r["path"], r["kind"]): r["n"] for r in structure.paths(left, "j").collect()}
    assert found == {
        ("$", "object"): 2, ("$.a", "number"): 2, ("$.b", "object"): 1, ("$.b.c", "array"): 1, ("$.b.c[]", "number"): 1, ("$.b.c[]", "string"): 1,
        ("$.b.c[]", "null"): 1, ("$.d", "null"): 1, ("$.e", "array"): 2, ("$.e[]", "object"): 1, ("$.e[].f", "bool"): 1,
    }
    right = spark.createDataFrame([('{"a":"1","b":[1],"d":5,"e":[{"g":1}],"h":{"i":1}}',)], "j string")
    differ = {tuple(r) for r in structure.compare_paths(structure.paths(left, "j"), structure.paths(right, "j")).collect()}
    assert differ == {("$.a", "type_mismatch"), ("$.b", "type_mismatch"), ("$.e[].f", "missing_field"), ("$.e[].g", "extra_field"), ("$.h", "extra_field")}
    assert structure.paths(left.limit(0), "j").count() == 0
    other = structure.paths(spark.createDataFrame([("[1]",)], "j string"), "j")
    assert {tuple(r) for r in structure.compare_paths(structure.paths(left, "j"), other).collect()} == {("$", "type_mismatch")}


def test_structure_of_shapes(spark, tmp_path):
    """Equal shapes are walked once, whatever their values; names and values that look like JSON, escapes, spaces and long strings."""
    texts = [
        r' { "a\"#:1" : "x\\" , "b c":[ -1.5e+3,0 , true,false,null,"]" ], "{\u0041":{"":[[ ],{ }]} } ', r'{"t":"tru\ne","n":"null, 1: [{","0":"\"0\"","e":"","l":null,"x":12345678901234567890123}',
        '{"k":"' + "ab\\n" * 50_000 + '"}', "null", " 7 ", '"s"', "[1, [2, [3]]]", '[true, 1] x "', '{"a":1,"a":2}', "[1,]", "{'a':1}", "01", "NaN", "", '"\x01"',
    ]

    def walk(value, path, out):
        kind = {dict: "object", list: "array", str: "string", bool: "bool", type(None): "null"}.get(type(value), "number")
        out.append((path, kind))
        for key, inner in value.items() if kind == "object" else [(None, v) for v in value] if kind == "array" else []:
            walk(inner, f"{path}[]" if key is None else f"{path}.{key}", out)

    import json
    from collections import Counter

    want: list = []
    for text in texts[:8]:
        # What follows the first value of a text is not looked at.
        walk(json.JSONDecoder().raw_decode(text.strip())[0], "$", want)
    df = spark.createDataFrame([(t,) for t in texts for _ in range(2)], "j string")
    found = {(r["path"], r["kind"]): r["n"] for r in structure.paths(df, "j").collect()}
    assert found == {k: 2 * n for k, n in Counter(want).items()}
    numbered = spark.range(1000).selectExpr("concat('{\"a\":', id, ',\"b\":[\"', id, '\",', IF(id % 2 = 0, 'true', 'false'), ']}') AS j")
    assert numbered.select(structure.shape_of(F.col("j"))).distinct().count() == 1


def test_levels_are_walked_from_stored_shapes(spark, tmp_path):
    """Grouped paths; what is returned doesn't read the table again for each level."""
    spark.range(100).selectExpr("id % 2 AS g", "concat('{\"a\":[', id, ',{\"b\":', id, '}]}') AS j").write.parquet(f"{tmp_path}/t")
    found = structure.paths(spark.read.parquet(f"{tmp_path}/t"), "j", ("g",))
    want = {("$", "object"), ("$.a", "array"), ("$.a[]", "number"), ("$.a[]", "object"), ("$.a[].b", "number")}
    assert {tuple(r) for r in found.collect()} == {(g, path, kind, 50) for g in (0, 1) for path, kind in want}
    assert not [f for f in found.inputFiles() if str(tmp_path) in f]


def test_rows_are_outlined_by_one_replacement(spark, tmp_path):
    """Equal outlines are counted before anything is parsed; texts that the pattern doesn't reach the end of are parsed, and valid texts aren't confused with odd ones."""
    import re

    spark.range(1000).selectExpr("concat('{\"a\":', id, ',\"b\":[\"', id, '\",', IF(id % 2 = 0, 'true', 'false'), ']}') AS j").write.parquet(f"{tmp_path}/t")
    counted = structure.outlines(spark.read.parquet(f"{tmp_path}/t"), "j")
    plan = counted._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"regexp_replace\(", plan)) == 1
    assert [r["n"] for r in counted.collect()] == [1000]
    valid = ["7", "1e9999999999", "9" * 150, "null\x03x", "-0.5e+07 ", "true", '"x"', "[1] x", '[1] \x01', '{"e\\u0001":1,"tru":[true,"e"]}', "[" + "9" * 150 + "]", '["' + "x" * (structure.SHORT + 1) + '"]', "[" + ",".join(["null", "true", '"a"'] * 9000) + "]"]
    odd = ["7.", "07", "7-8", "7x", "[1.5.5]", "[tru\x01]", "[\x01]", "\x01", '"\x01', '"\x01"', "e\x01", "[1e5e]", "[truefalse]", "[1 2]", r'["\x"]', r'["\u12"]', "[--1]", "[nulltrue]", '{"a":1,"a":"b"}', "[" + "1" * 1100 + ".5]"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(valid + odd)], "id int, j string")
    assert {r["id"] for r in df.where(F.try_parse_json("j").isNotNull()).collect()} == set(range(len(valid)))
    found = structure.paths(df, "j", ("id",)).where("path = '$'").collect()
    kinds = ["number", "number", "number", "null", "number", "bool", "string", "array", "array", "object", "array", "array", "array"]
    assert sorted((r["id"], r["kind"], r["n"]) for r in found) == [(k, kind, 1) for k, kind in enumerate(kinds)]


def test_pages_are_compressed_and_staging_adds_no_shuffle(spark, tmp_path):
    import glob

    from weftwork.sources import envelope

    rows = spark.range(2000).selectExpr("id", "concat('name of ', id) AS name", "timestamp'2024-01-01' AS updated")
    envelope.write_pages(rows, f"{tmp_path}/pages", F.floor(F.col("id") / 250))
    files = glob.glob(f"{tmp_path}/pages/part-*")
    assert files and all(f.endswith(".gz") for f in files)
    read = envelope.read_pages(spark, f"{tmp_path}/pages", rows.schema)
    store = merge.Store(spark, f"{tmp_path}/store", {"org": rows.schema})
    written = []
    plain = merge.Store._dealt
    try:
        merge.Store._dealt = lambda self, df, path: (written.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange ")), plain(self, df, path))[1]
        staged = store.stage("v", "org", merge.newest_arrivals(read))
    finally:
        merge.Store._dealt = plain
    assert written == [1] and sorted(tuple(r) for r in staged.collect()) == sorted(tuple(r) for r in rows.collect())
    assert len(store.touched("v", "org")) == 16


def test_address_bits_against_the_standard_library(spark):
    """Every spelling: what is an address, and its bits."""
    import ipaddress
    import random

    from weftwork.functions import net

    rng, texts = random.Random(7), ["", None, "::", "::1", "1::", "1::2::3", ":::", ":1", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8:9", "1:2:3:4:5:6:7::", "1:2:3:4:5:6:7:8::", "::ffff:192.0.2.1", "1::1.2.3.4", "1:2:3:4:5:6:1.2.3.4"]
    texts += ["1:2:3:4:5:6:7:1.2.3.4", "::1.2.3", "::1.2.3.256", "1.2.3.4", "01.2.3.4", "1.2.3.4.5", "12345::", "g::", "FE80::ABCD", "fe80::1%eth0", "1.2.3.4:1::", "-1::", "1 ::", "::1/64"]
    for _ in range(300):
        n = rng.getrandbits(128) & rng.getrandbits(128) & (rng.getrandbits(128) if rng.random() < 0.5 else -1)
        texts.append(rng.choice([str, lambda a: a.exploded, lambda a: str(a).upper()])(ipaddress.IPv6Address(n)))
        texts.append(str(ipaddress.IPv4Address(rng.getrandbits(32))))

    def want(text):
        try:
            a = ipaddress.ip_address(text)
        except ValueError:
            return None
        signed = lambda x: x - (1 << 64) if x >> 63 else x
        return (a.version, signed(int(a) >> 64), signed(int(a) & (1 << 64) - 1))

    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", net.address_bits(F.col("t")).alias("b"))
    assert [(r["t"], r["b"] and tuple(r["b"])) for r in df.collect()] == [(t, want(t)) for t in texts]
    assert "Python" not in df._jdf.queryExecution().toString()
    order = df.select("t", net.address_number(F.col("t")).alias("n")).where("n IS NOT NULL").orderBy("n.family", "n.high", "n.low").collect()
    numbers = [(ipaddress.ip_address(r["t"]).version, int(ipaddress.ip_address(r["t"]))) for r in order]
    assert numbers == sorted(numbers)


def test_prefix_bits_against_the_standard_library(spark):
    import ipaddress

    from weftwork.functions import net
    from weftwork.operators import lookup

    prefixes = [f"2001:db8:ffff:8000::8000:1/{n}" for n in range(0, 130)] + [f"203.0.113.77/{n}" for n in range(0, 34)] + ["::/x", "1.2.3.4", "::1", "1.2.3.4/8/8", "1.2.3.4/", None]

    def want(text):
        try:
            n = ipaddress.ip_network(text, strict=False)
        except ValueError:
            return None
        signed = lambda x: x - (1 << 64) if x >> 63 else x
        return (n.version, n.prefixlen, signed(int(n.network_address) >> 64), signed(int(n.network_address) & (1 << 64) - 1))

    df = spark.createDataFrame([(p,) for p in prefixes], "prefix string")
    assert [r["b"] and tuple(r["b"]) for r in df.select(net.prefix_bits(F.col("prefix")).alias("b")).collect()] == [want(p) for p in prefixes]
    found = lookup.addresses_in_prefixes(spark.createDataFrame([("203.0.113.99",), ("2001:db8:ffff:8000::1",), ("nothing",)], "address string"), df)
    assert "Python" not in found._jdf.queryExecution().toString() and "CartesianProduct" not in found._jdf.queryExecution().toString()
    inside = lambda a, p: want(p) is not None and ipaddress.ip_address(a) in ipaddress.ip_network(p, strict=False)
    assert sorted(tuple(r) for r in found.collect()) == sorted((a, p) for a in ("203.0.113.99", "2001:db8:ffff:8000::1") for p in prefixes if inside(a, p))


def test_footers_answer_without_data(spark, tmp_path):
    from weftwork.operators import aggregates

    spark.range(10, 500).repartition(3).write.parquet(f"{tmp_path}/t")
    df = aggregates.from_footers(spark, f"{tmp_path}/t", ["id"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [COUNT(*), MIN(id), MAX(id)]" in plan
    assert tuple(df.first()) == (490, 10, 499)
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown") == "false"


def test_sides_in_one_shuffle(spark):
    from weftwork.operators import compare

    rows = [(1, 1, "a", 10), (1, 2, "a", 11), (1, 3, "b", 12), (1, 4, "b", 13), (2, 5, "a", 14), (3, 6, "b", 15), (None, 7, "a", 16), (4, 8, "c", 17)]
    df = spark.createDataFrame(rows, "k long, at long, side string, v long")
    out = compare.sides(df, F.col("side") == "a", F.col("side") == "b", "k", "at", ["v"], b_last=False)
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert sorted(tuple(r) for r in out.collect()) == [(1, 11, 12, True), (2, 14, None, False), (3, None, 15, False)]


def test_selections(spark):
    """Limits at every level, empty sets, missing parents, pruned scans and unknown names."""
    import native

    from weftwork.plans.filters import FilterError
    from weftwork.plans.selection import Selection, select

    cat = native.catalogue(spark)
    spots = Selection(["id", "speed"], order=["-speed"], first=1)
    asked = Selection(["name"], {"id__in": "10,11,12"}, ["-id"], 2, {"org": Selection(["name"], {"name__contains": "other"}), "netixlan": spots, "poc": Selection(["id"])})
    rows = [r.asDict(recursive=True) for r in select(cat, "net", asked).collect()]
    assert sorted(rows, key=lambda r: r["name"]) == [
        {"name": "Hurricane", "org": None, "netixlan": [{"id": 71, "speed": 1000}], "poc": [{"id": 9001}]},
        {"name": "café straße", "org": {"name": "Other"}, "netixlan": [], "poc": [{"id": 9002}]},
    ]
    deep = select(cat, "org", Selection(["id"], {"id": "1"}, edges={"net": Selection(["id"], order=["id"], edges={"netixlan": Selection(["id"], first=2)})})).first().asDict(recursive=True)
    assert [(n["id"], [x["id"] for x in n["netixlan"]]) for n in deep["net"]] == [(10, [70, 73]), (11, [71]), (13, [72]), (14, [])]
    assert select(cat, "net", Selection(["id"], first=0)).count() == 0
    for wrong in (Selection(["nothing"]), Selection(["id"], order=["-nothing"]), Selection(["id"], edges={"nothing": Selection(["id"])}), Selection(["id"], first=-1)):
        with pytest.raises(FilterError):
            select(cat, "net", wrong)


def test_numbers_of_a_repeated_key(spark):
    """A key with most rows spreads over the ranges, and numbers have no gap."""
    from weftwork.plans import paging

    df = spark.range(1000).select(F.when(F.col("id") < 900, 5).otherwise(F.col("id")).alias("k"), F.when(F.col("id") % 2 == 0, F.col("id")).alias("v"))
    rows = paging.numbered(df, ["k"], "at").collect()
    assert sorted(r["at"] for r in rows) == list(range(1000))
    assert [r["k"] for r in sorted(rows, key=lambda r: r["at"])] == sorted(r["k"] for r in rows)
    weighted = paging.numbered(spark.createDataFrame([(1, 3), (2, 4), (None, 2)], "k int, w int"), ["k"], "at", F.col("w")).collect()
    assert {r["k"]: r["at"] for r in weighted} == {None: 0, 1: 2, 2: 5}


def decoded(data):
    """(number, value) of a message's fields: the other way round, by hand."""
    def varint(at):
        value = shift = 0
        while True:
            value |= (data[at] & 127) << shift
            shift, at = shift + 7, at + 1
            if not data[at - 1] & 128:
                return value, at

    out, at = [], 0
    while at < len(data):
        tag, at = varint(at)
        value, at = varint(at)
        if tag & 7 == 2:
            value, at = bytes(data[at : at + value]), at + value
        out.append((tag >> 3, value))
    return out


def test_wire_rows_are_decoded_again(spark):
    from weftwork.functions import proto

    numbers = [0, 1, 127, 128, 300, 2**31, 2**63 - 1, -1, -(2**63), None]
    texts = ["", "x", "é" * 200, None]
    rows = [(n, t, None if n is None else n % 2 == 1, [t, None, ""], T0 + timedelta(microseconds=1_500_000) if n else datetime(1969, 12, 31, 23, 59, 59, 500_000)) for n in numbers for t in texts]
    df = spark.createDataFrame(rows, "n long, t string, b boolean, ts array<string>, at timestamp")
    c = F.col
    wire = proto.message([proto.number_field(1, c("n")), proto.bytes_field(2, c("t")), proto.number_field(3, c("b")), proto.number_field(4, c("n"), True), proto.repeated_field(500, c("ts")), proto.timestamp_field(501, c("at"))])
    epoch = datetime(1970, 1, 1)
    for r in df.withColumn("wire", wire).collect():
        want = [(1, r["n"] % 2**64)] if r["n"] else []
        want += [(2, r["t"].encode())] if r["t"] else []
        want += [(3, 1)] if r["b"] else []
        want += [(4, r["n"] % 2**64)] if r["n"] is not None else []
        want += [(500, t.encode()) for t in r["ts"] if t is not None]
        got = decoded(r["wire"])
        assert got[:-1] == want
        seconds, micros = divmod(int((r["at"] - epoch) / timedelta(microseconds=1)), 1_000_000)
        assert got[-1][0] == 501 and decoded(got[-1][1]) == [(1, seconds % 2**64)] + ([(2, micros * 1000)] if micros else [])


def test_index_reads_fewer_files(spark, tmp_path):
    from weftwork.operators import textindex

    words = ["Köln tower", "Berlin hall", "straße yard", "Paris dock", "x", "", None]
    df = spark.createDataFrame([(i, None if words[i % 7] is None else f"{words[i % 7]} {i}", "City" if i % 50 else "Odd") for i in range(700)], "id long, a string, b string")
    path = f"{tmp_path}/index"
    textindex.build(df, path, ["a", "b"], folders=16)
    whole = spark.read.parquet(f"{path}/rows")
    for text in ("koln", "KÖLN TOWER 7", "strasse", "odd", "x", "berlin hall 1", "nothing like it", "", "12"):
        got = textindex.search(spark, path, ["a", "b"], text)
        assert got.columns == df.columns
        want = {r["id"] for r in df.collect() if any(v is not None and fold_of(text) in fold_of(v) for v in (r["a"], r["b"]))}
        assert {r["id"] for r in got.collect()} == want, text
    assert len(textindex.folders_with(spark, path, "köln")) < 8 and textindex.folders_with(spark, path, "nothing like it") == [] and textindex.folders_with(spark, path, "ab") is None
    plan = textindex.search(spark, path, ["a", "b"], "köln")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and textindex.FOLDER in plan.split("PartitionFilters: [")[1].split("]")[0] and whole.count() == 700


def fold_of(text):
    from weftwork.functions.text import fold

    return fold(text)
