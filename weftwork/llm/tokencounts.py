"""Exact token counts at every prefix, by dynamic programming.

For byte-pair encoding, the encoding of a prefix is not a prefix of the encoding.
But the *last token* of each prefix's encoding follows from earlier prefixes:
token ``t`` ends the encoding of ``s[:i]`` if and only if it fits behind the last
token of ``s[:i - len(t)]``, that is, if re-encoding the two together gives the
two again.  So one pass over a piece of text gives the number of tokens of
each of its prefixes.  The library cuts a text into pieces (pre-tokens) first, and
tokens never cross them, so the tables of the pieces add up to the table of the text;
where a cut itself depends on what follows (white space, contractions), the prefixes
that end there are counted apart.

Which tokens end at a place is asked of an automaton of the vocabulary's tokens, so a long piece costs a step for each byte and
token that ends there, not one for each length a token may have.  Pieces of up to 64 characters are remembered, a bounded number of them.

``prefix_table`` stores the counts and answers one budget in the same pass; ``count_at`` and ``longest_within``, or for whole tables the
columns ``tokens_at`` and ``characters_within``, answer truncation and budget questions from them
without encoding anything again.

Defined results: null and empty texts have the one-entry table [0].  Null doc_id
is kept.  Repeated rows give repeated results; an empty table gives an empty result.  A very long text is
one table, of two bytes a character, in the task that has it.  Other columns are ignored.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from operator import sub

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftwork.llm import common

TABLE = "doc_id long, n_bytes long, n_tokens long, deltas binary, within long"
#: Longer pieces aren't remembered, so memory is bounded in bytes.
KEPT_CHARS = 64

#: Fixed value: how the byte-level vocabulary cuts a text into pieces.
PIECE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_alphabet() -> dict[int, str]:
    """Byte to the printable character that stands for it in the vocabulary file."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, shift = {b: chr(b) for b in printable}, 0
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + shift)
            shift += 1
    return out


class PrefixCounter:
    """Token counts of all prefixes of a text, for one byte-level vocabulary."""

    def __init__(self, path: str, most_pieces: int = 1_000_000):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        back = {c: b for b, c in byte_alphabet().items()}
        to_bytes = lambda token: bytes(back[c] for c in token)
        special = {t["content"] for t in model["added_tokens"]}
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.ids = {to_bytes(t): i for t, i in model["model"]["vocab"].items() if t not in special}
        self.bytes_of = {i: b for b, i in self.ids.items()}
        self.ending = ahocorasick.Automaton()
        for token, i in self.ids.items():
            self.ending.add_word(token.decode("latin-1"), (i, len(token)))
        self.ending.make_automaton()
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for order, merge in enumerate(model["model"]["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            a, b = self.ids[to_bytes(left)], self.ids[to_bytes(right)]
            made = self.ids[self.bytes_of[a] + self.bytes_of[b]]
            self.rank[a, b] = (order, made)
            if made not in self.parts:
                self.parts[made] = (a, b, order)
        self.pieces = regex.compile(PIECE_PATTERN)
        self.spaces = regex.compile(r"\s\s")
        self.blank = regex.compile(r"\s+").fullmatch
        self.most_pieces = most_pieces
        self.known: dict[str, bytes] = {}
        self.fits: dict[tuple[int, int], bool] = {}

    def _fit(self, left: int, right: int) -> bool:
        """Whether the encoding of both tokens' bytes together is just the two.

        Undo the later-made merge step by step: if at some point the two facing
        parts merge earlier than the step that was undone, the pair would not
        have survived.
        """
        limit, ok = float("inf"), True
        a, b = left, right
        while True:
            if (made := self.rank.get((a, b))) is not None and made[0] < limit:
                ok = False
                break
            in_a, in_b = self.parts.get(a), self.parts.get(b)
            order_a = in_a[2] if in_a else -1
            order_b = in_b[2] if in_b else -1
            # The part made last is opened first; of equal parts the left one is
            # made first, so the right one is opened.
            if order_a > order_b:
                limit, a = order_a, in_a[1]
            elif in_b:
                limit, b = order_b + 1, in_b[0]
            else:
                break
        if len(self.fits) > 2_000_000:
            self.fits.clear()
        self.fits[left, right] = ok
        return ok

    def bytes_prefixes(self, data: bytes) -> list[int]:
        """Token counts of data[:1], data[:2], ... for a piece of text."""
        counts, last, fits = [0], [-1], self.fits
        # Longest tokens come first of those that end at a place; just one of them fits.
        for at, (token, length) in self.ending.iter(data.decode("latin-1")):
            if len(counts) > at + 1:
                continue
            start = at + 1 - length
            if start:
                pair = (last[start], token)
                fit = fits.get(pair)
                if fit is None:
                    fit = self._fit(*pair)
                if not fit:
                    continue
            counts.append(counts[start] + 1)
            last.append(token)
        if len(counts) != len(data) + 1:
            raise ValueError("the vocabulary lacks a byte")
        return counts[1:]

    def piece(self, text: str) -> bytes:
        """The change of the count at each character of a piece."""
        if (known := self.known.get(text)) is None:
            data = text.encode()
            counts = self.bytes_prefixes(data)
            if len(data) != len(text):
                counts = [counts[e - 1] for e in np.cumsum([len(c.encode()) for c in text]).tolist()]
            known = struct.pack(f"<{len(counts)}h", counts[0], *map(sub, counts[1:], counts))
            if len(text) <= KEPT_CHARS:
                if len(self.known) > self.most_pieces:
                    self.known.clear()
                self.known[text] = known
        return known

    def _count(self, piece: str) -> int:
        return int(np.frombuffer(self.piece(piece), "<i2").sum())

    def _stretch(self, text: str) -> bytes:
        """Changes of the count at each character of a text without special tokens.

        Prefixes end inside pieces; where the prefix alone would be cut elsewhere
        than the whole text is, the affected counts are set from the prefix's own cut.
        """
        found = self.pieces.findall(text)
        out = b"".join(map(self.piece, found))
        if "'" in text or self.spaces.search(text):
            whole, at = np.cumsum(np.frombuffer(out, "<i2").astype(np.int64)), 0
            counts = whole.copy()
            for i, p in enumerate(found):
                # A run of white space gives its last character away to what follows;
                # the prefix that ends with that character does not.
                if i and self.blank(found[i - 1]) and self.blank(p[0]):
                    before = at - len(found[i - 1])
                    base = whole[before - 1] if before else 0
                    counts[at] = base + self._count(text[before : at + 1])
                # The prefix that ends inside a contraction has none yet.
                if p in ("'re", "'ve", "'ll"):
                    base = whole[at - 1] if at else 0
                    counts[at + 1] = base + self._count("'") + self._count(p[1])
                at += len(p)
            out = np.diff(counts, prepend=0).astype("<i2").tobytes()
        return out

    def changes(self, text: str) -> bytes:
        """The stored form: the change of the count at each character."""
        if self.special is None or not self.special.search(text):
            return self._stretch(text)
        out, at = [], 0
        for m in self.special.finditer(text):
            # Prefixes that end inside the special string hold it as plain text.
            head = self._stretch(text[at : m.start()])
            plain = np.frombuffer(self._stretch(text[at : m.end() - 1]), "<i2").astype(np.int64)
            base = int(np.frombuffer(head, "<i2").sum())
            counts = np.concatenate([np.cumsum(np.frombuffer(head, "<i2").astype(np.int64)), np.cumsum(plain)[len(head) // 2 :], [base + 1]])
            out.append(np.diff(counts, prepend=0).astype("<i2").tobytes())
            at = m.end()
        out.append(self._stretch(text[at:]))
        return b"".join(out)

    def prefix_counts(self, text: str) -> np.ndarray:
        """Token counts of text[:0], text[:1], ..., text."""
        return np.concatenate([[0], np.cumsum(np.frombuffer(self.changes(text), "<i2").astype(np.int64))])


def count_at(deltas: bytes, prefix: int) -> int:
    """Tokens of the first ``prefix`` characters, from the stored table."""
    return int(np.frombuffer(deltas, "<i2")[:prefix].astype(np.int64).sum())


def longest_within(deltas: bytes, budget: int) -> int:
    """Characters of the longest prefix of at most ``budget`` tokens."""
    counts = np.concatenate([[0], np.cumsum(np.frombuffer(deltas, "<i2").astype(np.int64))])
    return int(np.flatnonzero(counts <= budget)[-1])


@F.pandas_udf(T.LongType())
def tokens_at(deltas: pd.Series, prefix: pd.Series) -> pd.Series:
    """Column form of ``count_at``: stored tables and numbers of characters; null where either is."""
    return pd.Series([None if d is None or p is None or p != p else count_at(d, int(p)) for d, p in zip(deltas, prefix)], dtype="Int64")


@F.pandas_udf(T.LongType())
def characters_within(deltas: pd.Series, budget: pd.Series) -> pd.Series:
    """Column form of ``longest_within``: stored tables and budgets of tokens; null where either is."""
    return pd.Series([None if d is None or b is None or b != b else longest_within(d, int(b)) for d, b in zip(deltas, budget)], dtype="Int64")


_COUNTERS: dict[str, PrefixCounter] = {}


def prefix_counter(path: str) -> PrefixCounter:
    if path not in _COUNTERS:
        _COUNTERS[path] = PrefixCounter(path)
    return _COUNTERS[path]


def _tables(path: str, budget: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = prefix_counter(path)
        for whole in batches:
            for batch in common.slices(whole, "text"):
                texts = [text or "" for text in batch.column("text").to_pylist()]
                tables = [counter.changes(text) for text in texts]
                totals = [int(np.frombuffer(t, "<i2").sum(dtype=np.int64)) for t in tables]
                within = [len(text) if n <= budget else longest_within(table, budget) for text, table, n in zip(texts, tables, totals)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"),
                        pa.array([len(t.encode()) for t in texts], pa.int64()),
                        pa.array(totals, pa.int64()),
                        pa.array(tables, pa.binary()),
                        pa.array(within, pa.int64()),
                    ],
                    names=["doc_id", "n_bytes", "n_tokens", "deltas", "within"],
                )

    return run


def prefix_table(documents: DataFrame, vocabulary: str, budget: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, ``deltas``: for each character of the text, the
    change of the token count as a little-endian signed 16-bit integer; and ``within``: the characters of the
    longest prefix of at most ``budget`` tokens."""
    common.ship_package(documents.sparkSession)
    slim = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(_tables(vocabulary, budget), TABLE)
