"""Packing by power-of-two decomposition.

Every document is tokenised, closed with an end id and cut into pieces whose
lengths are powers of two: as many pieces of ``max_length`` as fit, then the
binary digits of the rest, longest first.  Each piece is a sequence of its own,
so no sequence crosses documents and none needs padding; training batches are
formed inside a bucket of equal lengths.

Defined results: a null or empty text yields one piece, the end id alone.  A null
``doc_id`` is kept as null.  Repeated rows are packed once each.  An empty table
gives an empty result.  Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftwork.llm import common

PIECES = "doc_id long, start long, length long, doc_tokens long, bucket int, token_ids binary"

#: Words of these letters alone are one pre-token: letters of Latin-1 and ASCII.
_LETTERS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+\Z")
#: Such a word followed by ASCII marks (no apostrophe) is two pre-tokens.
_MARKED = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!\"#$%&()*+,\-./:;=?@\[\\\]^_`{}~]+)\Z")


#: Longer words aren't remembered.
KEPT_CHARS = 64


class WordTokenizer:
    """Ids of whole texts from a word-level memory over the ``tokenizers`` library.

    The vocabulary drops white space and never merges across it, so a text's ids
    are those of its space-separated words in order.  Words met before are
    looked up; new ones are encoded together, and plain words are told apart in
    the joined result by the tokens that end a word.
    """

    def __init__(self, path: str, most_words: int = 800_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.ends = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)], bool)
        self.most_words = most_words
        self.known: dict[str, bytes] = {"": b""}

    def _encode(self, words: list[str]) -> None:
        plain = [w for w in words if w.isalpha() and _LETTERS.match(w)]
        if plain:
            ids = np.array(self.tokenizer.encode(" ".join(plain), add_special_tokens=False).ids, np.uint32)
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(plain):
                raise ValueError("word ends of the vocabulary do not match the words")
            data, start = ids.astype("<u4").tobytes(), 0
            for word, stop in zip(plain, (stops * 4).tolist()):
                self.known[word] = data[start:stop]
                start = stop
        rest = [w for w in words if w not in self.known]
        for word, encoded in zip(rest, self.tokenizer.encode_batch(rest, add_special_tokens=False)):
            self.known[word] = np.array(encoded.ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        if len(self.known) > self.most_words:
            self.known = {"": b""}
        split = [_lowered(text).replace("\n", " ").split(" ") for text in texts]
        new: set[str] = set()
        for words in split:
            new.update(words)
        new.difference_update(self.known)
        marked, single = {}, set()
        for word in new:
            if not word.isalpha() and (m := _MARKED.match(word)):
                marked[word] = m.groups()
                single.update(m.groups())
            else:
                single.add(word)
        single.difference_update(self.known)
        if single:
            self._encode(list(single))
        known = self.known
        for word, (core, tail) in marked.items():
            known[word] = known[core] + known[tail]
        look = known.__getitem__
        out = [b"".join(map(look, words)) for words in split]
        for word in (*marked, *single):
            # Memory is bounded in bytes, too: what is longer than any word isn't kept.
            if len(word) > KEPT_CHARS:
                known.pop(word, None)
        return out


def _lowered(text: str) -> str:
    """Lower case where that is surely what the vocabulary does: in Latin-1 texts
    that hold no opening of a special token."""
    if not text.isascii():
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return text
    return text if "<|" in text else text.lower()


_TOKENIZERS: dict[str, WordTokenizer] = {}


def word_tokenizer(path: str) -> WordTokenizer:
    """One tokenizer for each vocabulary and worker process."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def binary_lengths(n: int, max_length: int) -> list[int]:
    """The lengths of the pieces of ``n`` tokens, longest first."""
    whole, rest = divmod(n, max_length)
    return [max_length] * whole + [1 << k for k in range(max_length.bit_length() - 2, -1, -1) if rest >> k & 1]


def _pieces(path: str, end_id: int, max_length: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = word_tokenizer(path)
        for whole in batches:
            for batch in common.slices(whole, "text"):
                texts = [text or "" for text in batch.column("text").to_pylist()]
                data = [ids + end for ids in tokenizer.encode(texts)]
                totals = [len(ids) // 4 for ids in data]
                cut = [binary_lengths(n, max_length) for n in totals]
                lengths = np.array([n for part in cut for n in part], np.int64)
                counts = np.array([len(part) for part in cut], np.int64)
                owner = np.repeat(np.arange(len(cut)), counts)
                ends = np.cumsum(lengths)
                doc_start = np.cumsum(totals) - totals
                offsets = np.concatenate([[0], ends * 4]).astype(np.int32)
                ids = pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(b"".join(data))])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(pa.array(owner)),
                        pa.array(ends - lengths - doc_start[owner]),
                        pa.array(lengths),
                        pa.array(np.array(totals, np.int64)[owner]),
                        pa.array(np.log2(lengths).astype(np.int32)),
                        ids,
                    ],
                    names=["doc_id", "start", "length", "doc_tokens", "bucket", "token_ids"],
                )

    return run


def pack(documents: DataFrame, vocabulary: str, end_id: int = 1, max_length: int = 2048) -> DataFrame:
    """The pieces of all documents, each a sequence by itself.

    Columns: doc_id, start, length, doc_tokens, bucket (log2 of the length),
    token_ids (little-endian unsigned 32-bit), sequence_id (unique), offset (0).
    No shuffle: a task cuts the documents it reads.
    """
    if max_length < 1 or max_length & (max_length - 1):
        raise ValueError("max_length must be a power of two")
    common.ship_package(documents.sparkSession)
    slim = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(_pieces(vocabulary, end_id, max_length), PIECES).withColumns({"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Write the sequences to one folder for each length, so that a reader of a
    folder gets rows of one fixed shape."""
    pieces.write.partitionBy("bucket").parquet(path)
