from __future__ import annotations

import hashlib
import math
from collections import Counter

import oracle
import pytest
from conftest import SF, has_tables

from weftwork.llm import centroids, queries

DDL = "vec_id long, embedding array<double>, cluster string, ids string, n string"


def brute(rows, k, rounds, dims):
    kept = [(i, [math.floor(256.0 * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x * 256.0) for x in v)]
    key = lambda i: (i is None, hashlib.sha256(f"2:{i}".encode()).hexdigest())
    centres = [v for _, v in sorted(kept, key=lambda r: (key(r[0]), r[1]))[:k]]
    away = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    own = lambda v: min(range(len(centres)), key=lambda j: (away(v, centres[j]), j))
    for _ in range(rounds):
        members = [[] for _ in centres]
        for _, v in kept:
            members[own(v)].append(v)
        centres = [[sum(c) // len(m) for c in zip(*m)] if m else old for m, old in zip(members, centres)]
    rows = [(i, own(v), away(v, centres[own(v)])) for i, v in kept]
    sums = Counter()
    for _, c, d in rows:
        sums[c] += d
    fit = lambda n: n if n < 2**63 else None
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return Counter((i, c, fit(d), fit(sums[c]), fit(sum(sums.values())), digest[c]) for i, c, d in rows)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", "y", "z") for i, v in rows], DDL)


ODD = [
    (1, [0.5, -0.25, 3.0]),
    (1, [0.5, -0.25, 3.0]),
    (2, [0.1, 0.2, 0.3]),
    (3, None),
    (4, [1.0, None, 2.0]),
    (5, [1.0, float("nan"), 2.0]),
    (6, [1.0, float("-inf"), 2.0]),
    (7, [1.0, 2.0]),
    (None, [-7.0, 2.0, 2.0]),
    (9, []),
    (10, [0.0, 0.0, 0.0]),
    (11, [1e308, 0.0, 0.0]),
    *[(20 + i, [i % 3 / 7, i % 5 / 9, -(i % 4) / 3]) for i in range(40)],
]


@pytest.mark.parametrize("more", [[], [(100, [3e6, -3e6, 1.0])], [(100, [9e15, 1.0, -9e15])], [(100, [1e30, -1e25, 3.0]), (101, [-1e30, 5.0, 1e300])]], ids=["float64", "above 2^53", "above 2^63", "huge"])
def test_equals_brute_force(spark, more):
    rows = ODD + more
    got = Counter(tuple(r) for r in centroids.cluster(frame(spark, rows).repartition(3), k=5, rounds=4, dims=3).collect())
    assert got == brute(rows, 5, 4, 3)


def test_ties_fewer_vectors_than_centroids_and_empty(spark):
    rows = [(i, [float(i % 2)] * 3) for i in range(4)]
    got = Counter(tuple(r) for r in centroids.cluster(frame(spark, rows), k=40, rounds=3, dims=3).collect())
    assert got == brute(rows, 40, 3, 3)
    none = centroids.cluster(frame(spark, [(1, [1.0])]), k=4, dims=3)
    assert none.collect() == [] and none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


@pytest.mark.skipif(not has_tables(), reason="the tables aren't there")
def test_query_against_sql(spark):
    assert oracle.mismatch(queries.op11_centroids(spark, SF), queries.oracle_sql()["op11_centroids"], oracle.connect(SF)) is None
