from __future__ import annotations

import random
import struct

import public_tokenizers
from tokenizers import Tokenizer

from weftwork.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def whole_ids(text):
    return [*Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids, 1]


def test_pieces_rebuild_every_document(docs):
    rows = packing.pack(docs, PATH).collect()
    assert len({r["sequence_id"] for r in rows}) == len(rows)
    got = {}
    for r in rows:
        ids = struct.unpack(f"<{r['length']}I", r["token_ids"])
        assert r["length"] & (r["length"] - 1) == 0 and r["length"] <= 2048 and 1 << r["bucket"] == r["length"] and r["offset"] == 0
        got.setdefault(r["doc_id"], []).append((r["start"], ids, r["doc_tokens"]))
    texts = {}
    for r in docs.collect():
        texts.setdefault(r["doc_id"], []).append(r["text"])
    assert got.keys() == texts.keys()
    for doc, parts in got.items():
        want = whole_ids(texts[doc][0])
        assert {p[2] for p in parts} == {len(want)}
        for _ in texts[doc]:
            at = 0
            while at < len(want):
                part = next(p for p in parts if p[0] == at)
                parts.remove(part)
                assert list(part[1]) == want[at : at + len(part[1])]
                at += len(part[1])
        assert not parts


def test_words_give_what_the_library_gives():
    tokenizer, library = packing.WordTokenizer(PATH, most_words=50), Tokenizer.from_file(PATH)
    rng = random.Random(4)
    parts = ["a", "The", " ", "  ", "\n", "\t", "'", "'s", "'Re", "É", "ß", "İ", "Σ", "中文", "🙂", ".", "!!", "<|endoftext|>", "<|ENDOFTEXT|>", "1", "23", "é", " ", "...", "$", "ing"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(600)]
    for at in range(0, 600, 50):
        for text, data in zip(texts[at : at + 50], tokenizer.encode(texts[at : at + 50])):
            assert list(struct.unpack(f"<{len(data) // 4}I", data)) == library.encode(text, add_special_tokens=False).ids, text


def test_binary_lengths():
    assert packing.binary_lengths(0, 8) == []
    assert packing.binary_lengths(8 * 2 + 5, 8) == [8, 8, 4, 1]
    assert packing.binary_lengths(7, 2048) == [4, 2, 1]


def test_empty_and_clashing(empty, clashing, docs, tmp_path):
    assert packing.pack(empty, PATH).count() == 0
    pieces = packing.pack(clashing, PATH)
    assert pieces.count() == packing.pack(docs, PATH).count()
    packing.write_buckets(pieces, f"{tmp_path}/buckets")
    assert {tuple(r) for r in docs.sparkSession.read.parquet(f"{tmp_path}/buckets/bucket=0").select("length").collect()} == {(1,)}
