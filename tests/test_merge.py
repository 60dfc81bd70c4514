from __future__ import annotations

import json
from datetime import datetime, timedelta, timezone

import native
import pytest
from pyspark.sql import types as T

from weftwork.operators import joins
from weftwork.plans.schema import NATIVE_DDL
from weftwork.sources import envelope
from weftwork.streaming import merge

T1, T2, ZERO = datetime(2024, 1, 1), datetime(2024, 1, 2), datetime(1900, 1, 1)


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, v string, updated timestamp, status string")


def test_gate(spark):
    old = frame(spark, [(1, "old", T2, "ok"), (2, "old", T1, "deleted"), (3, "old", None, "ok"), (4, "old", ZERO, "ok"), (5, "old", T1, "ok")])
    new = frame(spark, [(1, "late", T1, "ok"), (2, "back", T2, "ok"), (3, "new", None, "ok"), (4, "new", ZERO, "ok"), (5, "same", T1, "ok"), (6, "first", T1, "ok")])
    got = {r["id"]: (r["v"], r["status"]) for r in merge.merge(old, new).collect()}
    assert got == {1: ("old", "ok"), 2: ("back", "ok"), 3: ("new", "ok"), 4: ("new", "ok"), 5: ("old", "ok"), 6: ("first", "ok")}
    assert {r["id"]: r["v"] for r in merge.merge(old, new, full=True).collect()}[1] == "late"
    assert {r["kind"]: r["n"] for r in merge.changed_counts(old, new).collect()} == {"new": 1, "replaced": 3, "skipped": 2}


def test_overlay_and_drain(spark):
    both = merge.overlay(frame(spark, [(1, "a", T1, "ok"), (2, "a", T1, "ok")]), frame(spark, [(2, "b", T2, "deleted"), (3, "b", T2, "deleted")]), "id")
    assert sorted((r["id"], r["v"]) for r in both.collect()) == [(1, "a"), (2, "b"), (3, "b")]
    assert [r["id"] for r in merge.drain(both, 1, 1).collect()] == [2]


def test_cycle(spark, tmp_path):
    store = merge.Store(spark, str(tmp_path))
    cat = native.catalogue(spark)
    staged = {n: cat.tables[n] for n in ("org", "campus", "fac", "ix", "ixlan", "net", "netixlan")}
    extra = [dict(id=90, net_id=99, ixlan_id=21), dict(id=91, net_id=10, ixlan_id=21, net_side_id=77, ix_side_id=30), dict(id=92, net_id=0, ixlan_id=21)]
    staged["netixlan"] = staged["netixlan"].union(native.frame(spark, "netixlan", extra))
    result = merge.run_cycle(store, staged)
    assert result.orphans == {("netixlan", "net", "net_id", "drop"): 1, ("netixlan", "fac", "net_side_id", "null"): 1}
    rows = {r["id"]: r for r in store.read("netixlan").collect()}
    assert 90 not in rows and rows[91]["net_side_id"] is None and rows[91]["ix_side_id"] == 30 and 92 in rows
    assert result.counts["net"] == 5 and store.read("poc").count() == 0

    later = native.frame(spark, "net", [dict(id=13, org_id=1, asn=1, name="Back", updated=datetime(2025, 1, 1)), dict(id=10, org_id=1, asn=2, name="Late", updated=datetime(2020, 1, 1))])
    merge.run_cycle(store, {"net": later})
    nets = {r["id"]: (r["name"], r["status"]) for r in store.read("net").collect()}
    assert nets[13] == ("Back", "ok") and nets[10][0] == "Cloud Net" and len(nets) == 5 and store.read("netixlan").count() == len(rows)
    assert merge.cursors({"net": store.read("net")})["net"] == datetime(2025, 1, 1)


def test_arrival_order_and_untouched_types(spark, tmp_path):
    store = merge.Store(spark, str(tmp_path))
    orgs, nets = native.frame(spark, "org", [dict(id=1, name="One")]), [dict(id=10, org_id=1, name="Newer", updated=T2), dict(id=10, org_id=1, name="Last", updated=T1)]
    both = native.frame(spark, "net", nets[:1]).withColumn("_arrival", native_arrival(1)).unionByName(native.frame(spark, "net", nets[1:]).withColumn("_arrival", native_arrival(2)))
    first = merge.run_cycle(store, {"org": orgs, "net": both})
    assert [r["name"] for r in store.read("net").collect()] == ["Last"] and store.read("net").columns == T.StructType.fromDDL(NATIVE_DDL["net"]).names
    second = merge.run_cycle(store, {"net": native.frame(spark, "net", [dict(id=11, org_id=1, name="More")])})
    # Only the bucket of the new row is of the second version.
    places = store.places(second.version)
    assert set(places["org"].values()) == {first.version} and sorted(places["net"].values()) == [first.version, second.version]
    third = merge.run_cycle(store, {"net": native.frame(spark, "net", [dict(id=10, org_id=1, name="Third", updated=datetime(2025, 1, 1))])})
    assert sorted(store.places(third.version)["net"].values()) == [second.version, third.version]
    store.vacuum(keep=1)
    assert store.read("net").count() == 2 and store.read("org").count() == 1 and store.current() == third.version
    assert not (tmp_path / "versions" / first.version / "net").exists() and not list((tmp_path / "staging").iterdir())
    assert (tmp_path / "versions" / first.version / "org").exists() and (tmp_path / "versions" / second.version / "net").exists()


def native_arrival(n):
    from pyspark.sql import functions as F

    return F.struct(F.lit(n).cast("bigint").alias("page"), F.lit(0).alias("at"))


def test_staging_falls_back(spark, tmp_path):
    store = merge.Store(spark, str(tmp_path))
    live = native.frame(spark, "org", [dict(id=1, name="One"), dict(id=2, name="Two")])
    gone = native.frame(spark, "org", [dict(id=2, name="Two", status="deleted", updated=T2)])

    def source(broken):
        def read(since):
            if since is None:
                return live
            if broken:
                raise OSError("no increment")
            return gone

        return read

    def staged(broken, cursor, mode):
        rows, increment = merge.stage_type(store, "v", "org", source(broken), cursor, mode)
        return sorted((r["id"], r["status"]) for r in rows.collect()), increment

    assert staged(False, T1, "incremental") == ([(2, "deleted")], True)
    assert staged(False, None, "incremental") == ([(1, "ok"), (2, "ok")], False)
    assert staged(False, T1, "full") == ([(1, "ok"), (2, "deleted")], False)
    assert staged(True, T1, "incremental") == ([(1, "ok"), (2, "ok")], False)
    with pytest.raises(OSError):
        staged(True, T1, "full")


def test_backfill(spark, tmp_path):
    known = native.catalogue(spark).tables
    asked = []

    def lookup(name, ids):
        asked.append((name, sorted(r["id"] for r in ids.collect())))
        return known[name]

    spots = native.frame(spark, "netfac", [dict(id=60, net_id=10, fac_id=30), dict(id=61, net_id=12, fac_id=30), dict(id=62, net_id=99, fac_id=30)])
    for n, (most, until, rows) in enumerate([(100, None, {60, 61}), (1, None, set()), (100, T1.replace(tzinfo=timezone.utc), set())]):
        asked.clear()
        store = merge.Store(spark, f"{tmp_path}/{n}")
        result = merge.run_cycle(store, {"netfac": spots}, lookup=lookup, most=most, until=until)
        assert {r["id"] for r in store.read("netfac").collect()} == rows
        if n == 0:
            assert asked == [("net", [10, 12, 99]), ("fac", [30]), ("org", [1, 2])] and result.backfilled == {"net": 2, "fac": 1, "org": 2}
        else:
            assert asked == ([("net", [10])] if n == 1 else [])


@pytest.mark.parametrize("most, broadcast", [(100, True), (1, False)])
def test_many_keys_arent_broadcast(spark, tmp_path, monkeypatch, most, broadcast):
    """The driver builds what is broadcast, so keys above a number are shuffled, though Spark takes them for small; rows are the same."""
    monkeypatch.setattr(joins, "BROADCAST_ROWS", most, raising=False)
    plans = {}
    for step, named in (("stage", lambda version, name: name), ("write", lambda version, name: f"{name}.merged")):
        plain = getattr(merge.Store, step)

        def noted(store, version, name, df, plain=plain, named=named):
            plans[named(version, name)] = df._jdf.queryExecution().executedPlan().toString()
            return plain(store, version, name, df)

        monkeypatch.setattr(merge.Store, step, noted)
    known, store = native.catalogue(spark).tables, merge.Store(spark, str(tmp_path))
    merge.run_cycle(store, {n: known[n] for n in ("org", "fac", "ix", "ixlan", "net")})
    plans.clear()
    spots = [dict(id=i, net_id=n, ixlan_id=x, net_side_id=s) for i, n, x, s in [(1, 10, 21, 30), (2, 98, 22, 77), (3, 99, 21, None), (4, 97, 21, None), (5, 11, 29, 31)]]
    found = native.frame(spark, "net", [dict(id=98, org_id=1, name="Found"), dict(id=99, org_id=1, name="Found")])
    result = merge.run_cycle(store, {"netixlan": native.frame(spark, "netixlan", spots)}, lookup=lambda name, ids: found if name == "net" else known[name])
    assert {(r["id"], r["net_side_id"]) for r in store.read("netixlan").collect()} == {(1, 30), (2, None), (3, None)}
    assert result.backfilled["net"] == 2 and result.orphans == {("netixlan", "net", "net_id", "drop"): 1, ("netixlan", "ixlan", "ixlan_id", "drop"): 1, ("netixlan", "fac", "net_side_id", "null"): 1}
    assert {name: "Broadcast" in plans[name] for name in ("net.asked", "net.found", "netixlan.merged")} == dict.fromkeys(("net.asked", "net.found", "netixlan.merged"), broadcast)
    checked, orphans = merge.check_keys("netixlan", native.frame(spark, "netixlan", spots), {n: store.read(n) for n in ("net", "ixlan", "fac")})
    assert checked.count() == 3 and orphans.count() == 3
    assert ("Broadcast" in checked._jdf.queryExecution().executedPlan().toString()) == broadcast


def test_null_and_zero_keys_stay(spark, tmp_path):
    """A null required key counts as 0, as 0 it passes; an optional one may be null or 0."""
    store = merge.Store(spark, str(tmp_path))
    rows = [dict(id=i, org_id=k, campus_id=c, name="x") for i, k, c in [(10, 1, None), (11, None, 0), (12, 0, 5), (13, 9, 5), (14, 1, 5)]]
    result = merge.run_cycle(store, {"org": native.frame(spark, "org", [dict(id=1, name="One")]), "fac": native.frame(spark, "fac", rows)})
    assert {r["id"]: (r["org_id"], r["campus_id"]) for r in store.read("fac").collect()} == {10: (1, None), 11: (0, 0), 12: (0, None), 14: (1, None)}
    assert result.orphans == {("fac", "org", "org_id", "drop"): 1, ("fac", "campus", "campus_id", "null"): 2} and result.counts == {"org": 1, "fac": 4}
    checked, orphans = merge.check_keys("fac", native.frame(spark, "fac", rows), {"org": store.read("org"), "campus": store.read("campus")})
    assert checked.count() == 4 and {tuple(r) for r in merge.orphan_summary(orphans).collect()} == {("fac", "campus", "campus_id", "null", 2), ("fac", "org", "org_id", "drop", 1)}


def test_all_rows_orphaned(spark, tmp_path):
    store = merge.Store(spark, str(tmp_path))
    result = merge.run_cycle(store, {"net": native.frame(spark, "net", [dict(id=1, org_id=7, name="x"), dict(id=2, org_id=8, name="y")])})
    assert result.orphans == {("net", "org", "org_id", "drop"): 2} and result.counts == {"net": 0} and store.read("net").count() == 0


def test_cycle_stores_folds_and_runs_one_job_a_type(spark, tmp_path):
    store = merge.Store(spark, str(tmp_path))
    cat = native.catalogue(spark)
    merge.run_cycle(store, {n: cat.tables[n] for n in ("org", "net")})
    assert {r["id"]: r["name_fold"] for r in store.read("net", folds=True).collect()}[12] == "cafe strasse"
    assert "name_fold" not in store.read("net").columns
    # Staged rows merge with one job that writes: the counts of rows and orphans come with it.
    writes = []
    plain = merge.Store._dealt
    merge.Store._dealt = lambda self, df, path: (writes.append(path), plain(self, df, path))[1]
    try:
        merge.run_cycle(store, {"net": cat.tables["net"]})
    finally:
        merge.Store._dealt = plain
    assert [w.split("/")[0] for w in writes] == ["staging", "versions"]


def test_merge_rewrites_only_what_it_touches(spark, tmp_path):
    path = str(tmp_path / "table")
    rows = [(i, "old", T1, "ok") for i in range(500)]
    merge.merge_keyed(path, frame(spark, rows), "id", "updated", buckets=32)
    files = lambda: {str(p.relative_to(path)) for p in (tmp_path / "table").rglob("*.parquet")}
    before = files()
    touched = merge.merge_keyed(path, frame(spark, [(3, "new", T2, "ok"), (7, "late", datetime(2020, 1, 1), "ok"), (1000, "first", T1, "ok")]), "id", "updated", buckets=32)
    assert 1 <= len(touched) <= 3
    changed = {f.split("/")[0] for f in before ^ files()}
    assert changed == {f"{merge.BUCKET}={b}" for b in touched}
    got = {r["id"]: r["v"] for r in merge.newest_version(spark, path, frame(spark, []).schema).collect()}
    assert len(got) == 501 and (got[3], got[7], got[1000], got[8]) == ("new", "old", "first", "old")
    again = merge.merge_keyed(path, frame(spark, [(3, "new", T2, "ok")]), "id", "updated", buckets=32)
    assert len(again) == 1 and {r["id"]: r["v"] for r in merge.newest_version(spark, path, frame(spark, []).schema).collect()} == got
    assert merge.merge_keyed(path, frame(spark, []), "id", "updated", buckets=32) == []


def test_faults_of_queries_are_no_reason_to_read_in_full(spark, tmp_path):
    store, live, notes = merge.Store(spark, str(tmp_path)), native.frame(spark, "org", [dict(id=1, name="One")]), {}
    with pytest.raises(Exception, match="UNRESOLVED_COLUMN"):
        merge.stage_type(store, "v", "org", lambda since: live if since is None else live.select("nothing"), T1)
    merge.stage_type(store, "v", "org", lambda since: live if since is None else spark.read.parquet(str(tmp_path / "missing")), T1, fallbacks=notes)
    assert list(notes) == ["org"] and "PATH_NOT_FOUND" in notes["org"]


def test_scheduled_stream(spark, tmp_path):
    frame(spark, [(1, "a", T1, "ok")]).write.parquet(f"{tmp_path}/in")
    seen = []
    running = merge.scheduled(spark.readStream.schema("id long, v string, updated timestamp, status string").parquet(f"{tmp_path}/in"), lambda df, n: seen.append(df.count()), f"{tmp_path}/checkpoint", "1 second")
    running.processAllAvailable()
    running.stop()
    assert sum(seen) == 1


def test_failed_cycle_changes_nothing(spark, tmp_path):
    store = merge.Store(spark, str(tmp_path))
    org = native.frame(spark, "org", [dict(id=1, name="One")])
    merge.run_cycle(store, {"org": org})
    before = store.current()
    from pyspark.sql import functions as F

    with pytest.raises(Exception, match="stop"):
        merge.run_cycle(store, {"org": org.withColumn("name", F.raise_error(F.lit("stop")).cast("string")).withColumn("updated", F.lit(T2))})
    assert store.current() == before and store.read("org").collect()[0]["name"] == "One"


def test_modes_and_log(spark, tmp_path):
    day = timedelta(days=1)
    assert merge.effective_mode("incremental", None, T2, day) == "full" and merge.effective_mode("incremental", T1, T1 + day / 2, day) == "incremental"
    assert merge.effective_mode("full", T1, T1, day) == "full" and merge.retry_delays() == [30.0, 120.0, 480.0]
    log = f"{tmp_path}/log"
    first = merge.run_started(spark, log, T1)
    second = merge.run_started(spark, log, T2)
    merge.run_completed(spark, log, second, T2, T2 + day, "success", {"net": 5})
    states = merge.run_states(spark, log, stale_before=T2)
    assert {r["id"]: r["status"] for r in states.collect()} == {first: "failed", second: "success"}
    assert merge.last_run(states, "success").collect()[0]["object_counts"] == {"net": 5}


def test_stream_equals_batch(spark, tmp_path):
    schema = T.StructType.fromDDL("id long, v string, updated timestamp, status string")
    for k, rows in enumerate(([(1, "a", T1, "ok"), (2, "a", T2, "ok")], [(1, "b", T2, "ok"), (2, "late", T1, "ok")])):
        frame(spark, rows).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        merge.merge_stream(stream, f"{tmp_path}/table", f"{tmp_path}/checkpoint", "id", "updated").awaitTermination()
        assert merge.newest_version(spark, f"{tmp_path}/table", schema).count() == 2, k
    assert {r["id"]: r["v"] for r in merge.newest_version(spark, f"{tmp_path}/table", schema).collect()} == {1: "b", 2: "a"}


def test_folds(spark):
    cat = native.catalogue(spark)
    rows = {r["id"]: r["name_fold"] for r in merge.with_folds(cat.tables["net"], cat.entities["net"]).collect()}
    assert rows[12] == "cafe strasse"


def test_envelopes(spark, tmp_path):
    rows = [{"id": 1, "name": "One", "unknown": 5, "created": "2024-01-01T00:00:00Z", "updated": "2024-01-01T00:00:00Z", "status": "ok"}, {"id": 2, "name": "Two"}]
    (tmp_path / "org.json").write_text(json.dumps({"meta": {"generated": 1}, "data": rows}))
    df = envelope.read_native(spark, f"{tmp_path}/org.json", "org")
    assert df.columns == T.StructType.fromDDL(NATIVE_DDL["org"]).names and sorted(r["id"] for r in df.collect()) == [1, 2]
    text = "".join(envelope.stream_envelope(df.select("id", "name"), {"n": 2}, flush=1))
    assert json.loads(text) == {"meta": {"n": 2}, "data": [{"id": 1, "name": "One"}, {"id": 2, "name": "Two"}]}
    assert json.loads("".join(envelope.stream_envelope(df.limit(0)))) == {"meta": {}, "data": []}
    assert json.loads(envelope.single_envelope(df.where("id = 2").select("id")))["data"] == [{"id": 2}]
    raw = envelope.read_raw(spark, f"{tmp_path}/org.json")
    assert envelope.parse_rows(raw, "value", df.schema).count() == 2
    envelope.write_json_rows(df, f"{tmp_path}/lines")
    assert envelope.read_lines(spark, f"{tmp_path}/lines", df.schema).count() == 2
    assert envelope.since(df, datetime(2024, 1, 1)).count() == 1 and envelope.since(df, None).count() == 2
    assert envelope.proto_columns(df, {"id": "identifier"}).columns == ["identifier"]
