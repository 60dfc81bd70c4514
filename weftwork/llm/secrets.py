"""Secret scans: fixed patterns, and character Markov models on what they leave.

Two models of first order give the likelihood of each character after the one before: one
learnt from random strings, one from ordinary identifiers and words.  In a run of
key-like characters, each part whose log-likelihood ratio is high enough is a secret.
Both models and the threshold come from labelled samples of bounded size: generated ones, names of
Python's standard library, and what a sample of the corpus shows: values that the patterns found are random, other words
ordinary.  Identifiers of public form (UUIDs, dates and times) are no secrets and aren't scored.

Defined results: null and empty texts have no spans.  Spans are offsets in code points, end
exclusive.  A model's span never overlaps a pattern's.  Repeated rows give repeated
results; an empty table gives an empty result, and models of the generated samples alone; extra
columns pass through where kept.  A very long text is scanned whole, in the task that has it.
"""

from __future__ import annotations

import glob
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftwork.llm import common

#: The kinds in order, their patterns and least lengths.
KINDS = ("assign", "access", "hex", "markov")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_LEAST = 12
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
ACCESS_LEAST = 18
HEX = re.compile(r"[0-9a-f]{16,}")
#: What the models look at: runs of key-like characters, without what the patterns found in them.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")

#: Identifiers of public form: UUIDs, and dates with or without a time.
PUBLIC = re.compile(
    r"(?<![A-Za-z0-9])(?:[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}|(?:19|20)\d\d-[01]\d-[0-3]\d(?:[T_-][0-2]\d(?:[-_]?[0-5]\d){1,2}(?:Z|[+-]\d{4})?)?)(?![A-Za-z0-9])", re.ASCII
)

#: Words from which ordinary identifiers are put together.
COMMON_WORDS = (
    "account action address agent amount answer array attribute backend batch block body branch buffer build button cache "
    "callback cell channel character check child client cluster code collection color column command comment config connection "
    "content context control count create current customer data database date default delete depth device document domain "
    "driver element empty engine entry error event example export factory field file filter first flag folder format frame "
    "function global graph group handler hash header height helper history host image import index info input instance "
    "integer interface item iterator job key label language last layer layout length level library line link list loader local "
    "location logger main manager map master match matrix member memory message method metric model module name network next "
    "node notification number object offset operation option order output owner package page parameter parent parser path "
    "pattern payload picture plugin point policy pool position prefix price process product profile project property protocol "
    "provider query queue random range record reference region register release report request resource response result role "
    "root route rule sample schema scope search section select server service session setting shape shard signal simple size "
    "source stage start state status storage stream string style summary system table target task template test text thread "
    "time title total trace transfer type unit update upload user utility value variable vector version view volume weight "
    "widget width window worker wrapper write year zone"
).split()

#: Words from which long words without a break are put together, as several languages do.
PROSE_WORDS = (
    "the that with which from this have they there their about would other thing never after where these being under between nation "
    "action session ending reading working water people little ever only hand land house ably able ness ment ship hood less father "
    "und die der ein eine nicht auch nach schaft fahrt heit keit lich ung gesellschaft versicherung arbeit zeit haus schule recht "
    "verwaltung schiff donau dampf kraft werk wagen freund freiheit be ver zer ent an auf aus schrift sprache schutz pflicht ach zusch "
    "les des une que dans pour elle sont avec mais tout ment tion eau eaux aux eur euse ique ais ait oir oire peux jeux chateau "
    "gouvernement en au oui ai re anticonstitutionnellement los las una que por para con como pero mente cion ado ada idad ero oso "
    "es as os gue miento ciudad trabajo siempre entonces sin embargo desafortunadamente haha hehe hihi jaja oh ah"
).split()

_LOW, _HIGH = 33, 127
_SIZE = _HIGH - _LOW + 1


def _codes(token: str) -> np.ndarray:
    return np.frombuffer(token.encode("ascii", "replace"), np.uint8).astype(np.int64).clip(_LOW, _HIGH) - _LOW


@dataclass
class MarkovPair:
    """Log-likelihood ratios of first and following characters, and the threshold."""

    first: np.ndarray
    step: np.ndarray
    threshold: float

    def ratios(self, token: str) -> np.ndarray:
        """For each character the log-likelihood under the random model minus that under the ordinary one."""
        codes = _codes(token)
        return np.concatenate([self.first[codes[:1]], self.step[codes[:-1], codes[1:]]])

    def parts(self, token: str, free: list[tuple[int, int]] | None = None) -> list[tuple[int, int]]:
        """(start, end) of all parts of a token whose sums reach the threshold, the best of each stretch first
        and then what lies beside it; ``free`` are the stretches to look at, or the whole token."""
        ratios, out, left = self.ratios(token), [], list(free if free is not None else [(0, len(token))])
        while left:
            low, high = left.pop()
            start, end, total = best_part(ratios[low:high])
            if total >= self.threshold:
                # A word of letters and digits is taken whole: its ends may look ordinary by chance.
                start, end = low + start, low + end
                while start > low and token[start].isalnum() and token[start - 1].isalnum():
                    start -= 1
                while end < high and token[end].isalnum() and token[end - 1].isalnum():
                    end += 1
                out.append((start, end))
                left += [(low, start), (end, high)]
        return sorted(out)


def best_part(ratios: np.ndarray) -> tuple[int, int, float]:
    """(start, end, sum) of the consecutive values with the largest sum."""
    if not len(ratios):
        return 0, 0, -np.inf
    sums = np.concatenate([[0.0], np.cumsum(ratios)])
    gain = sums[1:] - np.minimum.accumulate(sums[:-1])
    end = int(gain.argmax())
    return int(sums[: end + 1].argmin()), end + 1, float(gain[end])


def _model(tokens: list[str], smoothing: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    first, step = np.full(_SIZE, smoothing), np.full((_SIZE, _SIZE), smoothing)
    for token in tokens:
        codes = _codes(token)
        if len(codes):
            first[codes[0]] += 1
            np.add.at(step, (codes[:-1], codes[1:]), 1)
    return np.log(first / first.sum()), np.log(step / step.sum(axis=1, keepdims=True))


def train(random_tokens: list[str], ordinary_tokens: list[str], odds: float = 8.0, alarms: float = 0.005) -> MarkovPair:
    """Fit both models on four of five samples and set the threshold.

    A part is a secret where the ratio outweighs ``odds``, the logarithm of how many ordinary runs come
    with a random one (3,000).  Where more than the share ``alarms`` of the ordinary samples set aside, of those long
    enough to be looked at, would still be taken, the threshold rises until no more are.
    """
    fit = lambda tokens: _model([t for i, t in enumerate(tokens) if i % 5])
    (r_first, r_step), (o_first, o_step) = fit(random_tokens), fit(ordinary_tokens)
    pair = MarkovPair(r_first - o_first, r_step - o_step, 0.0)
    aside = sorted((best_part(pair.ratios(t))[2] for t in ordinary_tokens[::5] if CANDIDATE.fullmatch(t)), reverse=True)
    allowed = int(alarms * len(aside))
    pair.threshold = max(odds, float(np.nextafter(aside[allowed], np.inf)) if aside else odds)
    return pair


def labelled_random(n: int = 4000, seed: int = 11) -> list[str]:
    """Random strings in the alphabets that keys use."""
    rng = np.random.default_rng(seed)
    upper, lower, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    alphabets = [upper + lower + digits, upper + lower + digits + "+/", upper + lower + digits + "-_", upper + digits, lower + digits]
    out = []
    for i in range(n):
        alphabet = np.array(list(alphabets[i % len(alphabets)]))
        out.append("".join(rng.choice(alphabet, int(rng.integers(16, 65)))))
    return out


def labelled_ordinary(n: int = 8000, seed: int = 12) -> list[str]:
    """Identifiers, paths and versions put together from common words."""
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        words = [COMMON_WORDS[k] for k in rng.integers(0, len(COMMON_WORDS), int(rng.integers(2, 6)))]
        if i % 3 == 0:
            words.insert(int(rng.integers(0, len(words) + 1)), str(rng.integers(0, 3000)))
        style = i % 6
        if style == 0:
            out.append("_".join(words))
        elif style == 1:
            out.append("-".join(words))
        elif style == 2:
            out.append(words[0] + "".join(w.capitalize() for w in words[1:]))
        elif style == 3:
            out.append("/".join(words))
        elif style == 4:
            out.append("_".join(words).upper())
        else:
            out.append("".join(w.capitalize() for w in words))
    return out


def labelled_prose(n: int = 6000, seed: int = 13) -> list[str]:
    """Long words of several languages, and rulers of one character."""
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        word = "".join(PROSE_WORDS[k] for k in rng.integers(0, len(PROSE_WORDS), int(rng.integers(2, 9))))
        out.append(word.capitalize() if i % 4 == 0 else word.upper() if i % 40 == 1 else word)
    for c in "-_=+/":
        out += [c * int(k) for k in rng.integers(16, 60, 10)]
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of what the fixed patterns find."""
    out = []
    low = text.lower()
    if any(k in low for k in ("password", "passwd", "secret", "token", "api")):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def _without_public(run: str, low: int, high: int) -> Iterator[tuple[int, int]]:
    """The stretches of run[low:high] between identifiers of public form."""
    for m in PUBLIC.finditer(run, low, high):
        yield low, m.start()
        low = m.end()
    yield low, high


def model_spans(text: str, pair: MarkovPair, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, kind, end) of what the models add."""
    if not any(len(w) >= 16 for w in text.split()):
        return []
    out = []
    for m in CANDIDATE.finditer(text):
        at, free = 0, []
        for s, _, e in base:
            if s < m.end() and m.start() < e:
                free.append((at, s - m.start()))
                at = max(at, e - m.start())
        free.append((at, len(m[0])))
        free = [part for a, b in free for part in _without_public(m[0], a, b)]
        free = [(a, b) for a, b in free if a < b]
        out += [(m.start() + a, 3, m.start() + b) for a, b in pair.parts(m[0], free)]
    return out


SPANS = "spans array<struct<kind:string,start:int,`end`:int>>"


def _scan(names: list[str], pair: MarkovPair, mark: str | None):
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in common.slices(whole, "text"):
                found, clean = [], []
                for text in batch.column("text").to_pylist():
                    base = base_spans(text or "")
                    spans = sorted([*base, *model_spans(text or "", pair, base)])
                    found.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans])
                    if mark is not None:
                        clean.append(text if not spans else _redact(text, [(s, e) for s, _, e in spans], mark))
                more = {"spans": pa.array(found, kind)} | ({"redacted": pa.array(clean, pa.string())} if mark is not None else {})
                yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], *more.values()], names=[*names, *more])

    return run


def _samples(most_length: int):
    """Texts to (random, token): values of the base patterns, and other words of key-like characters."""
    word = re.compile(r"[A-Za-z0-9+/_=-]{6,}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in common.slices(whole, "text"):
                found: set[tuple[bool, str]] = set()
                for text in batch.column("text").to_pylist():
                    at = 0
                    for start, kind, end in [*base_spans(text or ""), (len(text or ""), None, 0)]:
                        found.update((False, w) for w in word.findall(text or "", at, max(at, start)))
                        if kind is not None and kind != KINDS.index("hex"):
                            found.update((True, w) for w in word.findall(text, start, end)[-1:])
                        at = max(at, end)
                kept = sorted(pair for pair in found if len(pair[1]) <= most_length)
                yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in kept], pa.bool_()), pa.array([t for _, t in kept], pa.string())], names=["random", "token"])

    return run


def corpus_samples(documents: DataFrame, most_texts: int = 4000, most_tokens: int = 10_000, most_length: int = 200) -> tuple[list[str], list[str]]:
    """(random, ordinary) tokens of the corpus, for training.

    From whole texts with the smallest hashes, about ``most_texts`` different ones in a table without repeats;
    of each kind at most ``most_tokens`` different tokens of at most ``most_length`` characters come to the
    driver, those with the smallest hashes.  Hexadecimal digits are left to the pattern.
    """
    common.ship_package(documents.sparkSession)
    texts = documents.select(F.col("text").cast("string").alias("text"))
    n = texts.count()
    if not n:
        return [], []
    share = min(1.0, most_texts / n)
    drawn = texts.where(F.pmod(F.xxhash64("text"), F.lit(1 << 40)) < int(share * (1 << 40)))
    tokens = drawn.mapInArrow(_samples(most_length), "random boolean, token string").distinct()
    first = lambda random: tokens.where(F.col("random") == random).orderBy(F.xxhash64("token"), "token").limit(most_tokens)
    rows = [(r["random"], r["token"]) for r in first(True).union(first(False)).collect()]
    return [t for random, t in rows if random], [t for random, t in rows if not random]


def labelled_names(most: int = 12_000) -> list[str]:
    """Identifiers that the sources of Python's standard library use, those with the smallest hashes."""
    names: set[str] = set()
    for path in sorted(glob.glob(f"{os.path.dirname(os.__file__)}/*.py")):
        with open(path, encoding="utf-8", errors="ignore") as source:
            names.update(re.findall(r"[A-Za-z_][A-Za-z0-9_/-]{7,199}", source.read()))
    return sorted(names, key=lambda name: xxhash.xxh64_intdigest(name))[:most]


@cache
def _generated() -> tuple[tuple[str, ...], tuple[str, ...]]:
    return tuple(labelled_random()), tuple(labelled_ordinary() + labelled_prose() + labelled_names())


def trained_pair(documents: DataFrame | None = None) -> MarkovPair:
    """The pair of models of the production query, from generated samples and from those of ``documents``."""
    random, ordinary = ([], []) if documents is None else corpus_samples(documents)
    return train([*_generated()[0], *random], [*_generated()[1], *ordinary])


def scan(documents: DataFrame, pair: MarkovPair, keep: tuple[str, ...] = ("doc_id",), mark: str | None = None) -> DataFrame:
    """``keep`` columns and ``spans``, sorted by start and then by kind; with a ``mark`` also ``redacted``, the text
    with every span, or run of overlapping spans, replaced by it.  No shuffle."""
    common.ship_package(documents.sparkSession)
    more = T.StructType.fromDDL(SPANS + (", redacted string" if mark is not None else ""))
    fields = [documents.schema[c] for c in keep if c not in more.names]
    names = [f.name for f in fields]
    schema = T.StructType([*fields, *more.fields])
    text = [] if "text" in names else [F.col("text").cast("string").alias("text")]
    return documents.select(*names, *text).mapInArrow(_scan(names, pair, mark), schema)


def spans_text(spans: Column) -> Column:
    """kind:start:end of all spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _redact(text: str, spans: list[tuple[int, int]], mark: str) -> str:
    """The text with every (start, end), or run of overlapping ones, replaced; spans come in order.  One pass."""
    parts, at = [], 0
    for start, end in spans:
        if start >= at:
            parts += (text[at:start], mark)
        at = max(at, end)
    return "".join([*parts, text[at:]])


def redacted(text: Column, spans: Column, mark: str = "<secret>") -> Column:
    """The text with every span, or run of overlapping spans, replaced by ``mark``; null texts stay null."""

    @F.pandas_udf(T.StringType())
    def run(texts: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
        return pd.Series([t if t is None else _redact(t, list(zip(a, b)), mark) for t, a, b in zip(texts, starts, ends)], dtype=object)

    return run(text, spans["start"], spans["end"])
