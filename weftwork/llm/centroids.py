"""Centroid clustering of whole-number vectors, exact at every size.

Vectors become rows of matrices (blocks) of whole numbers.  A block meets all centroids in one matrix
product: |x|^2 - 2 x.c + |c|^2 in float64.  With m and c the largest components of a block and of the
centroids and d components, no term or partial sum exceeds d (m + c)^2; below 2^53 every one is a whole number that
float64 holds, so the result is exact in any order of summation.  Blocks above that bound are compared in
whole numbers, of 64 bits where d (m + c)^2 is below 2^63, else of any length.  ``treeAggregate`` adds
the blocks' sums and counts, as whole numbers of any length; the driver sees ``k`` centroids.

Blocks are a Parquet table of the shared folder, in the narrowest type that holds them, so that a round reads
numbers and no lists, and a lost executor costs the blocks of its tasks only.

Defined results: a vector is left out if it is null, has another length, or a component that is null or
not finite, or not finite times the scale.  Repeated rows are vectors of their own.  A null id is
kept; its vector starts as a centroid only when there are too few others.  Rows of equal hash start in the
order of their vectors.  With fewer vectors than centroids there are as many centroids as vectors, and none of an empty
table, whose result is empty.  Distances and sums that 64 bits can't hold are null, and clusters are still exact.
Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftwork.llm import common

BLOCKS = "ids array<bigint>, n int, kind string, data binary"
RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
BLOCK_ROWS = 4096
#: Below this float64 holds every whole number, and below the other 64 bits do.
FLOAT_EXACT = 1 << 53
LONG_EXACT = 1 << 63

Centroids = Sequence[Sequence[int]]
#: Vectors, sums of vectors and sums of distances by centroid, as numbers of any length.
Sums = tuple[np.ndarray, np.ndarray, np.ndarray]


def usable(embedding: Column, dims: int, scale: float) -> Column:
    """Whether a vector has ``dims`` components, all finite, also times the scale."""
    fine = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale) < float("inf")))
    return F.coalesce((F.size(embedding) == dims) & fine, F.lit(False))


def packed(whole: np.ndarray) -> tuple[str, bytes]:
    """The narrowest type that holds a matrix of whole float64 numbers, and its bytes."""
    most = np.abs(whole).max(initial=0)
    kind = "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<f8"
    return kind, whole.astype(kind).tobytes()


def unpacked(kind: str, data: bytes, dims: int) -> np.ndarray:
    return np.frombuffer(data, kind).reshape(-1, dims).astype(np.float64)


def _blocks(dims: int, scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(start, BLOCK_ROWS)
                values = part.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                kind, data = packed(np.floor(scale * values.reshape(-1, dims)))
                ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column("vec_id").cast(pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array([part.num_rows], pa.int32()), pa.array([kind]), pa.array([data], pa.binary())], names=["ids", "n", "kind", "data"])

    return run


def whole_numbers(block: np.ndarray, reach: int) -> np.ndarray:
    """The block as 64-bit numbers where squared distances fit them, else as Python's."""
    if block.shape[1] * reach * reach < LONG_EXACT:
        return block.astype(np.int64)
    return np.array([int(v) for v in block.ravel()], dtype=object).reshape(block.shape)


def nearest(block: np.ndarray, centroids: Centroids) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centroid, the smallest of equals; squared distance) of each row, exactly."""
    reach = int(np.abs(block).max(initial=0)) + max(abs(v) for c in centroids for v in c)
    if block.shape[1] * reach * reach < FLOAT_EXACT:
        c = np.array(centroids, dtype=np.float64)
        away = (block * block).sum(axis=1)[:, None] - 2.0 * (block @ c.T) + (c * c).sum(axis=1)
        own = away.argmin(axis=1)
        return own, away[np.arange(len(block)), own].astype(np.int64)
    rows = whole_numbers(block, reach)
    own, best = np.zeros(len(rows), dtype=np.int64), None
    for number, centroid in enumerate(centroids):
        gap = rows - np.array(centroid, dtype=rows.dtype)
        away = (gap * gap).sum(axis=1)
        if best is None:
            best = away
        else:
            closer = (away < best).astype(bool)
            own[closer], best[closer] = number, away[closer]
    return own, best


def block_sums(block: np.ndarray, own: np.ndarray, distance: np.ndarray, k: int) -> Sums:
    """What a block adds to each centroid: vectors, their sum, their distances' sum."""
    counts = np.bincount(own, minlength=k).astype(object)
    if len(block) * int(np.abs(block).max(initial=0)) < FLOAT_EXACT:
        of = np.zeros((k, len(block)))
        of[own, np.arange(len(block))] = 1.0
        sums = (of @ block).astype(np.int64).astype(object)
    else:
        rows = whole_numbers(block, LONG_EXACT)
        sums = np.zeros((k, block.shape[1]), dtype=object)
        for number in np.unique(own):
            sums[number] += rows[own == number].sum(axis=0)
    inertia = np.zeros(k, dtype=object)
    np.add.at(inertia, own, distance.astype(object))
    return counts, sums, inertia


def totals(blocks: DataFrame, centroids: Centroids, dims: int) -> Sums:
    """Counts, sums and inertia of all blocks by nearest centroid."""
    k = len(centroids)

    def step(so_far: Sums, row) -> Sums:
        block = unpacked(row["kind"], row["data"], dims)
        return add(so_far, block_sums(block, *nearest(block, centroids), k))

    def add(a: Sums, b: Sums) -> Sums:
        return a[0] + b[0], a[1] + b[1], a[2] + b[2]

    zero = np.zeros(k, dtype=object), np.zeros((k, dims), dtype=object), np.zeros(k, dtype=object)
    return blocks.select("kind", "data").rdd.treeAggregate(zero, step, add)


def moved(centroids: Centroids, sums: Sums) -> list[list[int]]:
    """Each centroid's vectors' mean, rounded down; centroids without vectors stay."""
    counts, added, _ = sums
    return [[int(v) // int(n) for v in added[i]] if n else list(centroids[i]) for i, n in enumerate(counts)]


def starts(kept: DataFrame, k: int, scale: float, seed: str) -> list[list[int]]:
    """The ``k`` vectors whose ids hash to the smallest values, in that order."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).asc_nulls_last()
    return [[math.floor(scale * float(x)) for x in r["embedding"]] for r in kept.orderBy(order, "embedding").limit(k).collect()]


def _fitting(value: int) -> int | None:
    return int(value) if int(value) < LONG_EXACT else None


def _assigned(centroids: Centroids, inertia: Sequence[int], dims: int):
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    each, whole = [_fitting(v) for v in inertia], _fitting(sum(int(v) for v in inertia))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_cluster, by_digest = pa.array(each, pa.int64()), pa.array(digests, pa.string())
        for batch in batches:
            for i in range(batch.num_rows):
                block = unpacked(batch.column("kind")[i].as_py(), batch.column("data")[i].as_py(), dims)
                own, distance = nearest(block, centroids)
                fits = pa.array(distance) if distance.dtype == np.int64 else pa.array([_fitting(v) for v in distance], pa.int64())
                at = pa.array(own.astype(np.int32))
                ids = batch.column("ids")[i].values
                columns = [ids, at, fits, by_cluster.take(at), pa.array([whole] * len(own), pa.int64()), by_digest.take(at)]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    return run


def cluster(embeddings: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: float = 256.0, seed: str = "2") -> DataFrame:
    """One row per usable vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Starts and rounds run now; the last assignment runs with the returned plan, over the table of blocks.
    """
    spark = embeddings.sparkSession
    common.ship_package(spark)
    slim = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    kept = slim.where(usable(F.col("embedding"), dims, scale))
    centroids = starts(kept, k, scale, seed)
    if not centroids:
        return spark.createDataFrame([], RESULT)
    blocks = common.materialize(kept.mapInArrow(_blocks(dims, scale), BLOCKS), "blocks")
    for _ in range(rounds):
        centroids = moved(centroids, totals(blocks, centroids, dims))
    _, _, inertia = totals(blocks, centroids, dims)
    return blocks.mapInArrow(_assigned(centroids, list(inertia), dims), RESULT)


def cluster_sql(k: int = 40, rounds: int = 5, dims: int = 64, seed: str = "2") -> str:
    """DuckDB SQL for the same rows, one line of sums for each round."""
    steps = [
        f"""kept AS MATERIALIZED (
            SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS xs FROM embeddings
            WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims}),
        v AS MATERIALIZED (SELECT rid, unnest(range({dims})) AS d, unnest(xs) AS x FROM kept),
        s AS (SELECT rid, row_number() OVER (ORDER BY sha256('{seed}:' || vec_id) NULLS LAST, xs) - 1 AS num FROM kept),
        c0 AS MATERIALIZED (SELECT num, d, x FROM s JOIN v USING (rid) WHERE num < {k})"""
    ]
    for i in range(rounds + 1):
        steps.append(f"e{i} AS (SELECT rid, num, sum((v.x - c.x) * (v.x - c.x))::HUGEINT AS away FROM v JOIN c{i} c USING (d) GROUP BY rid, num)")
        steps.append(f"a{i} AS MATERIALIZED (SELECT rid, min(away * {k} + num) AS pair FROM e{i} GROUP BY rid)")
        if i < rounds:
            mean = "(sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*)"
            steps.append(f"m{i} AS (SELECT pair % {k} AS num, d, ({mean})::BIGINT AS x FROM a{i} JOIN v USING (rid) GROUP BY 1, 2)")
            steps.append(f"c{i + 1} AS MATERIALIZED (SELECT num, d, x FROM m{i} UNION ALL SELECT num, d, x FROM c{i} WHERE num NOT IN (SELECT num FROM m{i}))")
    last = f"""SELECT vec_id, (pair % {k})::INT AS cluster, (pair // {k})::BIGINT AS distance,
            (sum(pair // {k}) OVER (PARTITION BY pair % {k}))::BIGINT AS cluster_inertia, (sum(pair // {k}) OVER ())::BIGINT AS inertia,
            sha256(text) AS centroid_sha256
        FROM a{rounds} JOIN kept USING (rid) JOIN (SELECT num, string_agg(x::VARCHAR, ',' ORDER BY d) AS text FROM c{rounds} GROUP BY num) t ON t.num = pair % {k}"""
    return "WITH " + ",\n".join(steps) + "\n" + last
