from __future__ import annotations

import math
import random
import re
from collections import Counter

import oracle
import pytest

from weftwork.llm import quality, queries

SF = "/root/testdata/sf0.001"


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {k for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for k in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_statistics(docs, spark):
    extra = ["a b c d e a b c d e f", "x x x x x x x", "same\nsame\n \nother\nsame", "#*$%&|<> é b\x1cc", "one", "a\n\n\nb " * 50]
    rows = [(i, t) for i, t in enumerate([*[r["text"] for r in docs.collect()], *extra])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    got = {r["doc_id"]: tuple(r[n] for n in names) for r in quality.with_statistics(df).collect()}
    assert got == {i: brute(t) for i, t in rows}


def test_base_failed_never_kept(docs):
    for r in quality.judge(docs).collect():
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])


def test_posterior_tells_junk(spark):
    good = [f"Clear sentence number {i} speaks about matter {i * 7} in plain words.\nIt has a second line of text for reader {i} who has patience, time and a lamp to see by." for i in range(150)]
    junk = [" ".join(f"w{i}x{k}***" for k in range(40)) for i in range(20)]
    df = spark.createDataFrame(list(enumerate(good + junk)), "doc_id long, text string")
    kept = {r["doc_id"] for r in quality.judge(df).where("kept").collect()}
    assert kept == set(range(150))


def planted(spark, n=6000, seed=4):
    """Votes of seven rules of known accuracy on documents of which three of four are good."""
    rng = random.Random(seed)
    rules = tuple(quality.Rule(f"r{i}", "", "") for i in range(7))
    truth = {r.name: (1 - 0.02 * (i + 1), 0.5 + 0.06 * i) for i, r in enumerate(rules)}
    rows = []
    for k in range(n):
        good = rng.random() < 0.75
        votes = []
        for r in rules:
            right = rng.random() < truth[r.name][not good]
            votes.append(quality.ABSTAIN if rng.random() < 0.15 else quality.GOOD if good == right else quality.BAD)
        rows.append((k, good, *votes))
    return rules, truth, spark.createDataFrame(rows, "k long, good boolean, " + ", ".join(f"v_{r.name} int" for r in rules))


def test_planted_accuracies_are_found_and_do_not_hang_on_the_constant(spark):
    rules, truth, voted = planted(spark)
    voted = voted.cache()
    verdicts = {}
    for pseudo in (0.1, 1.0, 20.0):
        model = quality.fit(voted, rules, pseudo=pseudo)
        got = model.accuracy(rules)
        assert all(abs(got[name][side] - truth[name][side]) < 0.04 for name in truth for side in (0, 1))
        assert abs(math.exp(model.good[0]) - 0.75) < 0.02
        verdicts[pseudo] = {r["k"]: r["kept"] == r["good"] for r in voted.select("k", "good", (model.log_odds(rules) >= 0).alias("kept")).collect()}
        assert sum(verdicts[pseudo].values()) > 0.96 * voted.count()
    assert sum(verdicts[0.1][k] != verdicts[20.0][k] for k in verdicts[1.0]) < 0.005 * voted.count()


def test_rounds_end_where_the_likelihood_does(spark):
    rules, _, voted = planted(spark, 1500)
    voted = voted.cache()
    a, b = (quality.fit(voted, rules, tolerance=t) for t in (1e-8, 1e-11))
    assert all(abs(x - y) < 0.01 for x, y in zip((*a.good, *a.bad), (*b.good, *b.bad)))


def test_empty_and_clashing(empty, clashing, docs):
    assert quality.judge(empty).count() == 0
    assert quality.judge(clashing).count() == docs.count()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    assert oracle.mismatch(queries.queries()[name](spark, SF), queries.oracle_sql()[name], oracle.connect(SF)) is None
