from __future__ import annotations

import random
from collections import defaultdict

import numpy as np

from weftwork.llm import neardup


def shingles(text):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute(rows, percent):
    sets = {i: shingles(t) for i, t in rows}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def corpus(n, seed):
    """Chains of edited copies, groups with a shared passage, and single documents."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(4000)]
    rows, passage = [], [rng.choice(vocabulary) for _ in range(60)]
    while len(rows) < n:
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 8, 60, 150, 400]))]
        if rng.random() < 0.3:
            base[:0] = passage
        for _ in range(rng.choice([1, 1, 1, 2, 5, 25])):
            rows.append((len(rows), " ".join(base)))
            base = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                base[rng.randrange(len(base))] = rng.choice(vocabulary)
    return rows


def check(spark, rows, percent, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = neardup.group(df, percent=percent, **more).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute(rows, percent)
    heads = defaultdict(int)
    for r in got:
        heads[r["component_id"]] += r["kept_row"]
    assert set(heads.values()) == {1}


def test_against_all_pairs(spark):
    check(spark, corpus(400, 1), 85)
    check(spark, corpus(300, 2), 80)


def test_large_nodes_are_split_and_blocked(spark):
    """With small limits the same result comes from deeper trees and from blocks."""
    check(spark, corpus(250, 3), 85, node_limit=6, depth=3)
    check(spark, corpus(120, 4), 85, node_limit=4, depth=0)


def test_parts_of_a_cluster():
    """To contract, parts share the first member; else every pair meets; no part is larger than asked, but for single members."""
    sizes = np.array([5, 3, 9, 1, 1, 7, 40, 2, 2])
    linear = neardup.parts_of(sizes, True, most=20, most_rows=4)
    assert all(part[0] == 0 and len(part) <= 4 for part in linear) and sorted(i for part in linear for i in part[1:]) == list(range(1, 9))
    assert all(sizes[part].sum() <= 20 or len(part) == 2 for part in linear)
    pairs = neardup.parts_of(sizes, False, most=20)
    assert {(i, j) for part in pairs for i in part for j in part if i < j} == {(i, j) for i in range(9) for j in range(i + 1, 9)}
    assert neardup.parts_of(sizes, False) == neardup.parts_of(sizes, True) == [list(range(9))]


def test_parts_of_bounded_size_give_the_same(spark, monkeypatch):
    rows = corpus(200, 6)
    monkeypatch.setattr(neardup.parts_of, "__defaults__", (400, 3))
    check(spark, rows, 85)


def test_cases(docs):
    rows = {}
    for r in neardup.group(docs, percent=85).collect():
        rows.setdefault(r["doc_id"], []).append((r["component_id"], r["kept_row"]))
    assert sorted(rows[2]) == [(1, False), (1, False)] and rows[1] == [(1, True)]
    for alone in (4, 5, 6, 7, 8):
        assert rows[alone] == [(alone, True)]
    assert rows[None] == [(None, True)]


def test_empty_and_clashing(empty, clashing, docs):
    assert neardup.group(empty).count() == 0
    assert neardup.group(clashing, keep=("size",)).count() == docs.count()


def test_components_of_a_long_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (5, 5)], "a long, b long")
    got = {r["node"]: r["root"] for r in neardup.components(chain).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}
