from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import oracle
import pytest
from conftest import SF, has_tables
from pyspark.sql import functions as F

from weftwork.llm import collocations, queries


def brute(rows, least, percent):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            n[lang or "und"] += len(words)
            for m in range(1, 5):
                for i in range(len(words) - m + 1):
                    f[lang or "und", tuple(words[i : i + m])] += 1
    many = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    top = defaultdict(int)
    for (lang, ws), a in many.items():
        for m in range(2, len(ws)):
            for i in range(len(ws) - m + 1):
                top[lang, ws[i : i + m]] = max(top[lang, ws[i : i + m]], a)
    out = Counter()
    for (lang, ws), a in many.items():
        if (lang, ws) in top and 100 * top[lang, ws] >= percent * a:
            continue
        score, _, le, r = min((2_000_000 * a // (f[lang, ws[:k]] + f[lang, ws[k:]]), k, f[lang, ws[:k]], f[lang, ws[k:]]) for k in range(1, len(ws)))
        out[lang, " ".join(ws), a, le, r, n[lang], score] += 1
    return out


def mined(df, least=2, percent=80):
    return Counter(tuple(r) for r in collocations.mine(df, least, percent).collect())


def pairs(df):
    return [(r["lang"], r["text"]) for r in df.collect()]


def test_fixture_rows(docs, empty, clashing):
    want = brute(pairs(docs), 2, 80)
    assert want and mined(docs) == want
    assert mined(clashing) == want
    assert mined(empty) == Counter()


def test_odd_words(spark):
    """Overlaps, control characters inside words, words that begin alike, one word only, cuts of equal score."""
    texts = [("en", "a a a a a a! A b\ta b"), ("en", "a\x01 b a\x01 b. a b; a b c d a b c d"), (None, "x y x y"), ("und", "x y\nx y"), ("en", "É é É é   z\x1cq z\x1cq"), ("de", "solo " * 500), ("fr", " \t "), ("fr", None), ("es", ". , ; : ! ?")]
    df = spark.createDataFrame(texts, "lang string, text string").repartition(3)
    for least in (1, 2, 3):
        assert mined(df, least) == brute(texts, least, 80)


def test_chunks_and_partitions(spark):
    """Counts over many chunks; phrases never cross texts or chunks."""
    rng = np.random.default_rng(3)
    rows = [(["en", "fr"][i % 2], " ".join(f"w{int(x)}" + ".," * int(x % 11 == 0) for x in rng.zipf(1.3, 60) % 40)) for i in range(300)]
    df = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    assert mined(df, 12) == brute(rows, 12, 80)


def test_ranks(docs):
    mined_rows = collocations.mine(docs, 2)
    got = [tuple(r) for r in collocations.best(mined_rows, 3).orderBy("lang", "rank").collect()]
    want = []
    every = sorted(brute(pairs(docs), 2, 80))
    for lang in sorted({r[0] for r in every}):
        rows = sorted((r for r in every if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))[:3]
        want += [(lang, k + 1, *r[1:]) for k, r in enumerate(rows)]
    assert got == want


def test_score_beyond_64_bits(spark):
    big = 1 << 61
    phrases = spark.createDataFrame([([1], big), ([2], big), ([1, 2], big)], "ids array<bigint>, a long")
    row = collocations.scored(phrases).first()
    assert (row["l"], row["r"], row["score"]) == (big, big, 1_000_000)


@pytest.mark.skipif(not has_tables(), reason="the tables aren't there")
def test_query_against_sql(spark):
    df = queries.op13_collocations(spark, SF)
    assert df.where(F.col("rank") == 1).count() > 0
    assert oracle.mismatch(df, queries.oracle_sql()["op13_collocations"], oracle.connect(SF)) is None
