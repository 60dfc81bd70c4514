from __future__ import annotations

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from weftwork.llm import tokencounts

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_every_prefix(library):
    counter, rng = tokencounts.PrefixCounter(PATH), random.Random(3)
    parts = ["a", "the", " ", " ", "\n", "\t", "'", "'s", "'re", "'ll", "'ve", "re", "1", "23", "é", "ß", "中文", "🙂", ".", "!!", "<|endoftext|>", "<|end", "ing", " of", " ", "\xa0", "AAAA", "----", "\r\n"]
    for _ in range(250):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        want = [len(library.encode(text[:i], add_special_tokens=False).ids) for i in range(len(text) + 1)]
        assert counter.prefix_counts(text).tolist() == want, repr(text)


def test_table_answers_budgets(docs, library):
    for r in tokencounts.prefix_table(docs, PATH).join(docs.select("doc_id", "text").distinct(), "doc_id").collect():
        text = r["text"] or ""
        count = lambda n: len(library.encode(text[:n], add_special_tokens=False).ids)
        assert (r["n_tokens"], r["n_bytes"]) == (count(len(text)), len(text.encode()))
        if len(text) < 2000:
            for n in (0, 1, len(text) // 2, len(text)):
                assert tokencounts.count_at(r["deltas"], n) == count(n)
            best = tokencounts.longest_within(r["deltas"], 7)
            assert count(best) <= 7 and all(count(n) > 7 for n in range(best + 1, len(text) + 1))


def test_empty_and_clashing(empty, clashing, docs):
    assert tokencounts.prefix_table(empty, PATH).count() == 0
    assert tokencounts.prefix_table(clashing, PATH).count() == docs.count()


def test_columns_answer_budget_questions(docs):
    """For every document and several budgets: the library's own count of the prefix, and of one character more."""
    library = Tokenizer.from_file(PATH)
    table = tokencounts.prefix_table(docs.where("length(text) < 1000 OR text IS NULL"), PATH)
    budgets = table.select("*", F.explode(F.array(*map(F.lit, (0, 1, 3, 17, 5000)))).alias("budget"))
    asked = budgets.withColumn("within", tokencounts.characters_within("deltas", "budget")).withColumn("at", tokencounts.tokens_at("deltas", "within"))
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    n = 0
    for r in asked.collect():
        text = texts[r["doc_id"]]
        count = lambda k: len(library.encode(text[:k], add_special_tokens=False).ids)
        assert r["at"] == count(r["within"]) <= r["budget"]
        assert all(count(k) > r["budget"] for k in range(r["within"] + 1, len(text) + 1))
        n += 1
    assert n > 40
    none = table.select(tokencounts.tokens_at(F.lit(None).cast("binary"), F.lit(3)).alias("x")).first()["x"]
    assert none is None


def test_long_pieces_cost_a_step_a_byte(library):
    """A megabyte without a break, in some seconds, and the library's count at the end and at some prefixes."""
    import time

    counter, rng = tokencounts.PrefixCounter(PATH), random.Random(5)
    text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(1_000_000))
    began = time.process_time()
    counts = counter.prefix_counts(text)
    assert time.process_time() - began < 10
    for n in (1, 77, 5_000, 100_000):
        assert counts[n] == len(library.encode(text[:n], add_special_tokens=False).ids)
    assert not counter.known


def test_budget_in_the_same_pass(docs, library):
    for r in tokencounts.prefix_table(docs, PATH, budget=9).join(docs.select("doc_id", "text").distinct(), "doc_id").collect():
        text = r["text"] or ""
        count = lambda k: len(library.encode(text[:k], add_special_tokens=False).ids)
        assert r["within"] == tokencounts.longest_within(r["deltas"], 9) and count(r["within"]) <= 9
        assert r["within"] == len(text) or count(r["within"] + 1) > 9
