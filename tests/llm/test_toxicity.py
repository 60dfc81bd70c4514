from __future__ import annotations

import random

import numpy as np

from weftwork.llm import toxicity


def labelled(spark, n=900, seed=1):
    rng = random.Random(seed)
    plain = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "ru") for b in ("ta", "ne", "so") for c in ("x", "lu", "pi", "da")]
    rows = []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randint(5, 120))]
        toxic = int(rng.random() < 0.2)
        if toxic:
            for _ in range(rng.randint(1, 4)):
                words[rng.randrange(len(words))] = rng.choice(["badword", "uglyterm", "vileno" + rng.choice(["lu", "ta", "so", "xi"])])
        rows.append((i, " ".join(words), rng.choice(["en", "de"]), toxic))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")


def fit(rows):
    return toxicity.fit(rows, rows.select("doc_id", "toxic"))


def test_held_out_accuracy(spark):
    rows = labelled(spark)
    net = toxicity.fit(rows, rows.where("doc_id % 4 <> 2").select("doc_id", "toxic"))
    got = toxicity.score(rows, net).join(rows.select("doc_id", "toxic"), "doc_id").where("doc_id % 4 = 2").collect()
    hits = sum(r["score"] >= 0.3 for r in got if r["toxic"])
    alarms = sum(r["score"] >= 0.3 for r in got if not r["toxic"])
    assert hits >= 0.95 * sum(r["toxic"] for r in got) and alarms <= 0.03 * len(got)
    assert set(net.thresholds) <= {"en", "de"}


def test_scores_of_whole_texts_in_parts(spark):
    """A long text scores as the network scores it in one go."""
    net = fit(labelled(spark, 300))
    words = [f"w{i}" for i in range(9000)]
    words[8500] = "badword"
    features = np.array([toxicity.word_features(w, net.shape) for w in words])
    assert np.isclose(toxicity.Scorer(net).logits([" ".join(words)])[0], net.logit(features), atol=1e-4)
    assert np.isclose(toxicity.Scorer(net, most_words=10).logits(["badword x", ""])[1], net.bias)


def test_query_scores_against_the_network_text_by_text(spark):
    """What the query returns is the whole network's answer on each whole text, cut by the same rule as in training."""
    rng = random.Random(3)
    rows = labelled(spark, 300)
    odd = [(1000 + i, sep.join(rng.choice(["badword", "kata", "lone", "Uglyterm!"]) for _ in range(k)), "en", 0) for i, (sep, k) in enumerate([("\x1c", 5), ("\u00a0", 9), ("\u2028", 3), (" ", 9000), ("", 1), (" ", 0)])]
    every = rows.union(spark.createDataFrame([*odd, (2000, None, None, None), (None, "badword", "de", 1)], rows.schema))
    net = fit(every)
    texts = {r["doc_id"]: r["text"] or "" for r in every.collect()}
    for r in toxicity.score(every, net).collect():
        words = toxicity.split_words(texts[r["doc_id"]])
        features = np.array([toxicity.word_features(w, net.shape) for w in words], np.int64).reshape(-1, 1 + len(net.shape.prefixes))
        want = net.probability(np.array([net.logit(features)]))[0]
        assert abs(r["score"] - want) < 1e-4


def test_repeated_rows_are_counted(spark):
    """The bound holds for rows, however often one repeats, and equal rows train as often as they come."""
    rows = labelled(spark, 60)
    many = rows.union(rows.where("doc_id = 1").crossJoin(spark.range(500)).drop("id"))
    assert fit(many) is not None
    a, b = (toxicity.fit(df, rows.select("doc_id", "toxic"), most_rows=100) for df in (many, many.repartition(7)))
    assert (a.embed == b.embed).all()


def test_same_twice(spark):
    rows = labelled(spark, 300)
    a, b = fit(rows), fit(rows.repartition(3))
    assert (a.embed == b.embed).all() and a.thresholds == b.thresholds


def test_cases(docs, empty, clashing, spark):
    net = fit(labelled(spark, 200))
    assert toxicity.score(docs, net).count() == docs.count() == toxicity.score(clashing, net).count()
    assert toxicity.score(empty, net).count() == 0
    none = fit(spark.createDataFrame([], "doc_id long, text string, lang string, toxic int"))
    assert none is None and {r["score"] for r in toxicity.score(docs, none).collect()} == {0.0}
    one_kind = fit(spark.createDataFrame([(1, "a b", "en", 0), (2, "c", None, 0)], "doc_id long, text string, lang string, toxic int"))
    assert all(r["score"] < 0.01 for r in toxicity.score(docs, one_kind).collect())


def test_training_takes_whole_texts(spark):
    """What stands behind thousands of words trains and calibrates like what stands before them."""
    rng = random.Random(5)
    plain = [f"{a}{b}" for a in ("ka", "lo", "mi", "ru") for b in ("ta", "ne", "so", "pi")]
    rows = []
    for i in range(120):
        toxic = i % 3 == 0
        words = [rng.choice(plain) for _ in range(4200)] + (["badword"] if toxic else []) + [rng.choice(plain) for _ in range(5)]
        rows.append((i, " ".join(words), "en", int(toxic)))
    net = fit(spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int"))
    late, none = net.probability(toxicity.Scorer(net).logits([rows[0][1], rows[1][1]]))
    assert late >= 0.5 > none
