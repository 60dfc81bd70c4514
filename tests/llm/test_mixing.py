from __future__ import annotations

import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from weftwork.llm import mixing


def water_fill(sizes, weights, share, most):
    """Targets by rounds: cut what is above its limit, share the excess among the rest."""
    budget, cut, limit = share * sum(sizes.values()), {}, {s: most * n for s, n in sizes.items()}
    while True:
        rest = [s for s in sizes if s not in cut]
        left = budget - sum(cut.values())
        total = sum(weights[s] for s in rest)
        target = {s: left * weights[s] / total for s in rest}
        over = [s for s in rest if target[s] > limit[s]]
        if not over:
            return cut | target
        cut |= {s: limit[s] for s in over}


def brute(rows, weights=(5, 2, 1), share=1.5, most=2.0):
    sizes = defaultdict(int)
    docs = []
    for doc_id, text, source in rows:
        n = len((text or "").encode().split())
        sizes[source] += n
        h = int(hashlib.md5(f"{'null' if doc_id is None else doc_id}:{text or ''}".encode()).hexdigest()[:9], 16)
        docs.append((doc_id, source, n, h))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    target = water_fill(dict(sizes), {s: weights[i % 3] for i, s in enumerate(order)}, share, most)
    out = []
    for source in order:
        copies = int(target[source] // sizes[source]) if sizes[source] else 0
        need, run = target[source] - copies * sizes[source], 0
        for i, _, n, _ in sorted((d for d in docs if d[1] == source), key=lambda d: d[3]):
            more = n > 0 and need > 0 and run + n / 2 <= need
            run += n
            out.append((str(i), n, sizes[source], round(target[source], 6), (copies + more) * n))
    return sorted(out)


def rows_of(df):
    return [(r["doc_id"], r["text"], r["source"]) for r in df.select("doc_id", "text", "source").collect()]


def test_against_sorting(docs, spark):
    more = spark.range(400).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 17).cast("int")).alias("text"), F.concat(F.lit("s"), F.col("id") % 5 % 4).alias("source"))
    for df in (docs.select("doc_id", "text", "source"), more):
        got = sorted((str(r["doc_id"]), r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in mixing.take(df).collect())
        assert got == brute(rows_of(df))


def test_repeated_rows_come_near_the_target(spark):
    """A source of one row many times, one of two such rows, and others beside them."""
    rows = spark.range(900).select(F.lit(1).cast("long").alias("doc_id"), F.lit("seven words are in this short text").alias("text"), F.lit("a").alias("source"))
    rows = rows.union(spark.range(400).select(F.col("id") % 2, F.lit("three more words"), F.lit("b"))).union(spark.range(300).select("id", F.lit("w x"), F.lit("c")))
    got = sorted((str(r["doc_id"]), r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in mixing.take(rows).collect())
    assert got == brute(rows_of(rows))
    taken = defaultdict(int)
    for r in mixing.take(rows.repartition(5)).collect():
        taken[r["source"], r["target"]] += r["taken"]
    assert all(abs(words - target) <= 7 for (_, target), words in taken.items())


def test_budgets_are_nested(spark):
    df = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("five words in this text").alias("text"), F.lit("a").alias("source"))
    small, large = (({r["doc_id"] for r in mixing.take(df, share=s).where("taken > 0").collect()}) for s in (0.2, 0.6))
    assert small < large and abs(len(small) - 100) <= 1 and abs(len(large) - 300) <= 1


def test_empty_and_clashing(empty, clashing, docs):
    assert mixing.take(empty).count() == 0
    assert mixing.take(clashing).count() == docs.count()
