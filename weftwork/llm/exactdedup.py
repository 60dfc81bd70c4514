"""Exact dedup by content sort.

Each run of white space becomes one space.  Rows are range-partitioned by sampled splitters over (the
text's first characters, the digest of all its bytes, id, row) and sorted so in each partition by Spark's external
sort: equal texts lie side by side, smallest id first, and a text with a third of all rows
spreads over partitions, as its rows differ by id.  Splitters hold a text's beginning and digest only, so what the
driver samples is bounded however long texts are.  Neighbours of equal digest are compared in full, in
a partition and across its borders; a difference would be a broken digest and raises an error.

A partition gives its rows with what it knows of their group.  A group that goes on in the next partition is
completed from one row for each end of a partition.

Defined results: null counts as empty, so null, empty and texts of other length in white space are told apart only as
the rule says.  A null id comes after all others; a group of null ids keeps one of them, and its ``keep_id`` is null.
Of repeated rows one stays.  An empty table gives an empty result.  A very long text is read by the task that
has it, whole.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftwork.llm import common

#: Characters of the text's beginning that order it before its digest does.
HEAD_CHARS = 64

RUNS = "doc_id long, digest binary, part int, first_id long, run_rows long, leads boolean, ends int, edge_text string"
#: A run at its partition's start, at its end.
AT_START, AT_END = 1, 2
EDGES = "part int, ends int, keep_id long, total long, holds_first boolean"


def normalised(text: Column) -> Column:
    """The text with each run of white space as one space; null becomes empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), common.SPACE_PATTERN, " ")


def content_sorted(documents: DataFrame) -> DataFrame:
    """doc_id, digest and normalised text, in the order of content over all partitions."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row_id"), normalised(F.col("text")).alias("text"))
    rows = rows.withColumn("head", F.substring("text", 1, HEAD_CHARS)).withColumn("digest", F.unhex(F.sha2("text", 256)))
    order = [F.col("head"), F.col("digest"), F.col("doc_id").asc_nulls_last(), F.col("row_id")]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "digest", "text")


def _same_as_before(digests: pa.Array, texts: pa.Array, digest: bytes | None, text: str | None) -> np.ndarray:
    """Whether each row's text equals the text before it; ``digest`` and ``text`` are those before the first."""
    same = np.zeros(len(digests), dtype=bool)
    alike = np.zeros(len(digests), dtype=bool)
    same[0], alike[0] = digests[0].as_py() == digest, text is not None and texts[0].as_py() == text
    if len(digests) > 1:
        same[1:] = pc.equal(digests.slice(1), digests.slice(0, len(digests) - 1)).to_numpy(zero_copy_only=False)
        alike[1:] = pc.equal(texts.slice(1), texts.slice(0, len(texts) - 1)).to_numpy(zero_copy_only=False)
    if (same & ~alike).any():
        raise ValueError("two texts have one digest")
    return same


def _rows(ids: pa.Array, digest: pa.Array, part: int, first: pa.Array, size: np.ndarray, leads: np.ndarray, ends: int = 0, edge_text: str | None = None) -> pa.RecordBatch:
    n = len(ids)
    texts = pa.array([edge_text] + [None] * (n - 1) if edge_text is not None else [None] * n, pa.string())
    columns = [ids, digest, pa.array(np.full(n, part, np.int32)), first, pa.array(size.astype(np.int64)), pa.array(leads), pa.array(np.full(n, ends, np.int32)), texts]
    return pa.RecordBatch.from_arrays(columns, names=[c.split(" ")[0] for c in RUNS.split(", ")])


class _OpenRun:
    """The last run so far: of its rows only the ids are kept."""

    def __init__(self, digest: bytes, text: str, ends: int):
        self.digest, self.text, self.ends = digest, text, ends
        self.ids: list[pa.Array] = []

    def rows(self, part: int, more_ends: int = 0) -> Iterator[pa.RecordBatch]:
        ends, size, first = self.ends | more_ends, sum(map(len, self.ids)), self.ids[0][0].as_py()
        for k, ids in enumerate(self.ids):
            n = len(ids)
            leads = np.zeros(n, dtype=bool)
            leads[0] = k == 0
            text = self.text if ends and k == 0 else None
            yield _rows(ids, pa.array([self.digest] * n, pa.binary()), part, pa.array([first] * n, pa.int64()), np.full(n, size), leads, ends, text)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, run = TaskContext.get().partitionId(), None
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, digests, texts = batch.column("doc_id"), batch.column("digest"), batch.column("text")
        same = _same_as_before(digests, texts, run and run.digest, run and run.text)
        starts = np.flatnonzero(~same)
        if run is not None and (head := int(starts[0]) if len(starts) else len(ids)):
            run.ids.append(ids.slice(0, head))
        if not len(starts):
            continue
        first_of_part = run is None
        if run is not None:
            yield from run.rows(part)
        if first_of_part and len(starts) > 1:
            # The partition's first run ends in this batch: it is an end as well.
            run = _OpenRun(digests[0].as_py(), texts[0].as_py(), AT_START)
            run.ids.append(ids.slice(0, int(starts[1])))
            yield from run.rows(part)
            starts, first_of_part = starts[1:], False
        if len(starts) > 1:
            sizes = np.diff(starts)
            low, high = int(starts[0]), int(starts[-1])
            leads = np.zeros(high - low, dtype=bool)
            leads[starts[:-1] - low] = True
            first = ids.take(pa.array(np.repeat(starts[:-1], sizes)))
            yield _rows(ids.slice(low, high - low), digests.slice(low, high - low), part, first, np.repeat(sizes, sizes), leads)
        last = int(starts[-1])
        run = _OpenRun(digests[last].as_py(), texts[last].as_py(), AT_START if first_of_part else 0)
        run.ids.append(ids.slice(last))
    if run is not None:
        yield from run.rows(part, AT_END)


def chained(edges: list[tuple[int, int, bytes, int | None, int]]) -> tuple[list[tuple], list[tuple[int, int]]]:
    """(rows of ``EDGES``, pairs of partitions that a group joins) from (part, ends, digest, first id, rows)
    of the runs at partitions' ends: a partition's first run goes on with the last run of the one before if digests agree."""
    chains: list[list[tuple]] = []
    links = []
    for edge in sorted(edges, key=lambda e: (e[0], not e[1] & AT_START)):
        before = chains[-1][-1] if chains else None
        if before and before[1] & AT_END and edge[1] & AT_START and before[2] == edge[2]:
            links.append((before[0], edge[0]))
            chains[-1].append(edge)
        else:
            chains.append([edge])
    rows = [(e[0], e[1], chain[0][3], sum(x[4] for x in chain), k == 0) for chain in chains for k, e in enumerate(chain)]
    return rows, links


def _confirm(runs: DataFrame, links: list[tuple[int, int]]) -> None:
    """Compare the texts of groups that go on across a border of partitions, in full."""
    spark = runs.sparkSession
    edge = runs.where("edge_text IS NOT NULL")
    pairs = spark.createDataFrame(links, "before int, after int")
    last = edge.where(F.col("ends").bitwiseAND(AT_END) != 0).select(F.col("part").alias("before"), F.col("edge_text").alias("last_text"))
    first = edge.where(F.col("ends").bitwiseAND(AT_START) != 0).select(F.col("part").alias("after"), F.col("edge_text").alias("first_text"))
    if pairs.join(last, "before").join(first, "after").where("last_text <> first_text").limit(1).count():
        raise ValueError("two texts have one digest")


def resolve(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text).

    The sort runs now; the returned plan reads its rows, without texts, and one row for each partition's end.
    """
    spark = documents.sparkSession
    common.ship_package(spark)
    runs = common.materialize(content_sorted(documents).mapInArrow(_runs, RUNS), "runs")
    ends = runs.where("ends > 0 AND leads").select("part", "ends", "digest", "first_id", "run_rows").collect()
    rows, links = chained([(r["part"], r["ends"], bytes(r["digest"]), r["first_id"], r["run_rows"]) for r in ends])
    if links:
        _confirm(runs, links)
    # Two rows for a partition at most.
    edges = F.broadcast(spark.createDataFrame(rows, EDGES))
    at_edge = F.col("total").isNotNull()
    return runs.join(edges, ["part", "ends"], "left").select(
        "doc_id",
        F.when(at_edge, F.col("keep_id")).otherwise(F.col("first_id")).alias("keep_id"),
        F.coalesce("total", "run_rows").alias("group_size"),
        (F.col("leads") & F.coalesce("holds_first", F.lit(True))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def resolve_sql() -> str:
    """DuckDB SQL for the same rows, where ids are unique."""
    return r"""
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
        WINDOW w AS (PARTITION BY t)"""
