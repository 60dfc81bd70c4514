from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import oracle
import pytest
from conftest import SF, has_tables

from weftwork.llm import exactdedup, queries


def brute(rows):
    groups = defaultdict(list)
    for i, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append(i)
    out = Counter()
    for text, ids in groups.items():
        known = sorted(i for i in ids if i is not None)
        keep = known[0] if known else None
        for k, i in enumerate(known + [None] * (len(ids) - len(known))):
            out[i, keep, len(ids), k == 0, hashlib.sha256(text.encode()).hexdigest()] += 1
    return out


def resolved(df):
    return Counter(tuple(r) for r in exactdedup.resolve(df).collect())


def test_fixture_rows(docs, empty, clashing):
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert resolved(docs) == want
    assert resolved(clashing) == want
    assert resolved(empty) == Counter()


def test_groups_across_partitions(spark):
    """A text with most rows, and texts that begin alike, over more partitions than texts."""
    rows = [(i, "hot  text") for i in range(3000)] + [(None, "hot\ttext")] * 3 + [(i % 50, "x" * 100 + str(i % 7)) for i in range(400)] + [(i, None) for i in range(900)] + [(7, "y " * 200_000)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "23")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        assert resolved(df) == brute(rows)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_small_batches(spark):
    """Runs that end, go on and begin at the borders of Arrow batches."""
    rows = [(i, "abcde"[i * i % 5] * (1 + i % 3)) for i in range(200)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for n in ("1", "2", "7"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)
            assert resolved(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_one_digest_for_two_texts_is_an_error():
    import pyarrow as pa

    with pytest.raises(ValueError):
        exactdedup._same_as_before(pa.array([b"d", b"d"]), pa.array(["a", "b"]), None, None)


def test_chain_of_ends():
    rows, links = exactdedup.chained([(0, 1, b"a", 1, 2), (0, 2, b"b", 5, 3), (2, 3, b"b", 9, 4), (3, 1, b"b", 20, 1), (3, 2, b"c", 0, 1)])
    assert links == [(0, 2), (2, 3)]
    assert rows == [(0, 1, 1, 2, True), (0, 2, 5, 8, True), (2, 3, 5, 8, False), (3, 1, 5, 8, False), (3, 2, 0, 1, True)]


@pytest.mark.skipif(not has_tables(), reason="the tables aren't there")
def test_query_against_sql(spark):
    assert oracle.mismatch(queries.op12_exact_dedup(spark, SF), queries.oracle_sql()["op12_exact_dedup"], oracle.connect(SF)) is None
