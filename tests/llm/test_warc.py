from __future__ import annotations

import gzip
import hashlib
import os
from base64 import b32encode
from collections import Counter

from weftwork.llm import warc

PAGES = [
    (3, "http://a.example/x y", "<p>one\r\n\r\nWARC/1.1\r\nContent-Length: 0\r\n\r\n</p>"),
    (1, "http://b.example/", "<p>same é中</p>"),
    (2, None, "<p>same é中</p>"),
    (2, None, "<p>same é中</p>"),
    (4, "http://c.example", None),
    (5, "http://d.example/\r\nX: 1", ""),
    (None, "http://e.example", "<p>same é中</p>"),
    (6, "http://f.example", "x" * 300_000),
]


def write(spark, tmp_path, rows=PAGES, name="warc"):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = f"{tmp_path}/{name}"
    warc.write_archives(warc.with_decisions(pages), path, most_bytes=1 << 13)
    return path


def test_round_trip(spark, tmp_path):
    records = warc.read_records(spark, write(spark, tmp_path))
    assert Counter(r["type"] for r in records.collect()) == {"request": 8, "metadata": 8, "response": 4, "revisit": 4}
    captures = warc.assemble(records).collect()
    assert len(captures) == 8
    for c in captures:
        assert c["request"]["payload"] == b"" and len(c["metadata"]) == 1 and c["metadata"][0]["payload"].startswith(b"pageBytes: ")
    by_page = {c["response"]["page_id"]: c["response"] for c in captures}
    assert by_page[3]["payload"].decode() == PAGES[0][2] and by_page[6]["payload_bytes"] == 300_000


def test_revisits_point_to_the_smallest_page(spark, tmp_path):
    rows = warc.resolve_revisits(warc.assemble(warc.read_records(spark, write(spark, tmp_path)))).collect()
    digest = lambda t: b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    got = Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in rows)
    same = len(PAGES[1][2].encode())
    assert got == Counter(
        [
            (3, len(PAGES[0][2]), digest(PAGES[0][2]), "response", None),
            (1, same, digest(PAGES[1][2]), "response", None),
            (2, same, digest(PAGES[1][2]), "revisit", 1),
            (2, same, digest(PAGES[1][2]), "revisit", 1),
            (None, same, digest(PAGES[1][2]), "revisit", 1),
            (4, 0, digest(""), "response", None),
            (5, 0, digest(""), "revisit", 4),
            (6, 300_000, digest("x" * 300_000), "response", None),
        ]
    )


def test_no_archive_is_larger_than_asked(spark, tmp_path):
    """However sizes are spread: large pages lie together among small ones."""
    rows = [(i, f"http://a.example/{i}", "x" * n) for i, n in enumerate([*[10] * 200, *[30_000] * 12, *[900] * 100, 500_000, 70_000, *[10] * 100])]
    path = write(spark, tmp_path, rows)
    sizes = {}
    for name in os.listdir(path):
        if name.endswith(".gz"):
            with gzip.open(f"{path}/{name}") as f:
                sizes[name] = (len(data := f.read()), sum(1 for h, _ in warc.parse(data) if h["warc-type"] == "metadata"))
    assert sum(n for _, n in sizes.values()) == len(rows)
    assert all(size <= 1 << 13 or n == 1 for size, n in sizes.values())
    assert warc.captures_per_archive(0) > 6000 and warc.captures_per_archive(len(warc.CLASS_BYTES)) == 1


def test_the_result_comes_through_the_transactions(spark, tmp_path):
    """Both joins of the assembly are in the plan, archives are parsed once, and records left out are missed."""
    records = warc.read_records(spark, write(spark, tmp_path))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    resolved = plan(warc.resolve_revisits(warc.assemble(records)))
    assert "MapInArrow" not in resolved
    for df in (warc.assemble(records), warc.resolve_revisits(warc.assemble(records).where("response.type = 'response'"))):
        assert plan(df).count("Join Inner") >= 1 and plan(df).count("Join LeftOuter") >= 1
    rows = warc.resolve_revisits(warc.assemble(records.where("type <> 'request'"))).collect()
    assert {(r["request_uri"], r["n_concurrent"]) for r in rows} == {(None, 1)}
    rows = warc.resolve_revisits(warc.assemble(records.where("type <> 'metadata'"))).collect()
    assert {r["metadata_bytes"] for r in rows} == {None}
    by_page = {r["page_id"]: r for r in warc.resolve_revisits(warc.assemble(records)).collect()}
    assert by_page[3]["request_uri"] == "http://a.example/x%20y" and by_page[6]["metadata_bytes"] == 300_000 and by_page[5]["n_concurrent"] == 2


def test_minimum_size_keeps_small_payloads(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    assert warc.with_decisions(pages, min_bytes=1000).where("NOT is_response").count() == 0


def test_links_in_both_directions(spark):
    fields = "record_id string, type string, concurrent_to array<string>, refers_to string, target string, page_id long, headers map<string,string>, payload binary, payload_bytes long, payload_digest string"
    blank = (None, "t", None, {}, b"", 0, "d")
    rows = [
        ("r1", "response", ["q1", "m3"], *blank),
        ("q1", "request", None, *blank),
        ("m1", "metadata", ["r1"], *blank),
        ("m2", "metadata", ["nowhere"], *blank),
        ("m3", "metadata", ["r1", "nowhere"], *blank),
        ("r2", "response", [], *blank),
    ]
    got = {c["capture_id"]: c for c in warc.assemble(spark.createDataFrame(rows, fields)).collect()}
    assert got["r1"]["request"]["record_id"] == "q1" and [m["record_id"] for m in got["r1"]["metadata"]] == ["m1", "m3"]
    assert got["r2"]["request"] is None and got["r2"]["metadata"] is None and got.keys() == {"r1", "r2"}


def _comparable(captures):
    part = lambda p: p and (p["type"], p["record_id"], p["target"], bytes(p["payload"]))
    head = lambda r: (r["record_id"], r["type"], r["refers_to"], r["target"], r["page_id"], sorted(r["headers"].items()), bytes(r["payload"]), r["payload_bytes"], r["payload_digest"])
    return sorted((c["capture_id"], part(c["request"]), head(c["response"]), c["metadata"] and [part(m) for m in c["metadata"]]) for c in captures.collect())


def test_captures_hold_their_payloads(spark, tmp_path):
    """The query's nested rows are those of the join over all records, payloads with them."""
    path = f"{tmp_path}/archives"
    captures = warc.captured(spark.createDataFrame(PAGES, "page_id long, url string, html string"), path)
    assert _comparable(captures) == _comparable(warc.assemble(warc.read_records(spark, path)))
    texts = {c["response"]["page_id"]: bytes(c["response"]["payload"]).decode() for c in captures.collect() if c["response"]["type"] == "response"}
    assert texts[3] == PAGES[0][2] and texts[6] == "x" * 300_000
    assert "Join" not in captures._jdf.queryExecution().optimizedPlan().toString()


def test_links_between_archives(spark, tmp_path):
    record = lambda kind, name, links, body=b"b": b"".join([b"WARC/1.1\r\nWARC-Type: ", kind, b"\r\nWARC-Record-ID: ", name, *[b"\r\nWARC-Concurrent-To: " + x for x in links], b"\r\nContent-Length: %d\r\n\r\n" % len(body), body, b"\r\n\r\n"])
    path = tmp_path / "far"
    path.mkdir()
    (path / "1.warc").write_bytes(record(b"response", b"r1", [b"q1", b"m9"]) + record(b"metadata", b"m1", [b"r1", b"r2"]))
    (path / "2.warc").write_bytes(record(b"request", b"q1", []) + record(b"response", b"r2", []) + record(b"metadata", b"m2", [b"r1", b"r1", b"nowhere"]))
    (path / "3.warc").write_bytes(record(b"metadata", b"m9", [b"r1"]) + record(b"response", b"r3", []))
    got = _comparable(warc.read_captures(spark, str(path)))
    assert got == _comparable(warc.assemble(warc.read_records(spark, str(path))))
    by_id = {c[0]: c for c in got}
    assert by_id["r1"][1][1] == "q1" and [m[1] for m in by_id["r1"][3]] == ["m1", "m2", "m9"] and [m[1] for m in by_id["r2"][3]] == ["m1"] and by_id["r3"][3] is None


def test_repeated_headers():
    record = b"WARC/1.1\r\nWARC-Concurrent-To: <a>\r\nWARC-Type: metadata\r\nWARC-Concurrent-To: <b>\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"
    assert [(h["warc-concurrent-to"], block) for h, block in warc.parse(record)] == [("<a> <b>", b"hi")]


def test_empty_and_extra_columns(spark, tmp_path):
    assert warc.resolve_revisits(warc.captured(spark.createDataFrame([], "page_id long, url string, html string"), f"{tmp_path}/none")).count() == 0
    assert warc.with_decisions(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    pages = spark.createDataFrame([(1, "u", "h", "x")], "page_id long, url string, html string, payload string")
    assert warc.with_decisions(pages).count() == 1
