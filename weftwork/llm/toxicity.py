"""Toxicity by a convolutional text classifier trained in numpy.

A word is the sum of hashed embeddings: of itself and of its first letters, so that
inflected forms share what their stem has learnt.  Filters of several widths slide over
the words of the whole text; the largest answer of each filter (max pooling) feeds
one logistic unit.  The text alone is looked at.

Training takes labelled rows up to ``most_rows``, a documented bound: those with the smallest
hash of their id, drawn by Spark.  One part of them starts the embeddings: the first dimension
of a bucket is the log-odds of toxic texts among those that hold it, so that max pooling
looks at telling words from the start.  Another part trains all weights by gradient
steps.  The last calibrates: one scale for scores, and a decision threshold for each language.

Scoring is one pass without a shuffle.  A filter's answer is a sum of terms, one for each
word it covers, so words are projected onto all filters once and remembered.

Defined results: null, empty and blank texts get the score of no evidence (the pooled
values of an empty text are 0).  Rows without a label don't train; a null doc_id or label doesn't either.
Repeated rows count as often as they come.  Words are what ``str.split`` tells apart, in training as in scoring;
a very long text is scored in parts that overlap.  Without labelled rows of both kinds the score is
the share of toxic labels, or 0.  An empty table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftwork.llm import common

#: Fixed value: characters that are not part of a word's identity at its ends.
_EDGES = ".,;:!?\"'()[]{}<>*#$%&|-_=+/\\~`^@"


@dataclass
class Shape:
    """Sizes of the network and of its training."""

    buckets: int = 1 << 17
    dims: int = 8
    widths: tuple[int, ...] = (1, 2, 3)
    filters: int = 8
    prefixes: tuple[int, ...] = (4, 5, 6, 7)
    epochs: int = 6
    rate: float = 0.02
    batch: int = 32
    seed: int = 7


def word_features(word: str, shape: Shape) -> list[int]:
    """Buckets of a word and of its first letters."""
    core = word.lower().strip(_EDGES)
    out = [xxhash.xxh32_intdigest(core) % shape.buckets]
    for n in shape.prefixes:
        out.append(xxhash.xxh32_intdigest(f"{n}:{core[:n]}") % shape.buckets if len(core) > n else out[0])
    return out


def split_words(text: str) -> list[str]:
    """The one rule by which training and scoring cut a text."""
    return text.split()


@dataclass
class Network:
    shape: Shape
    embed: np.ndarray
    convs: list[np.ndarray]
    conv_bias: list[np.ndarray]
    out: np.ndarray
    bias: float
    scale: float = 1.0
    shift: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)

    @staticmethod
    def fresh(shape: Shape) -> Network:
        rng = np.random.default_rng(shape.seed)
        embed = (rng.standard_normal((shape.buckets, shape.dims)) * 0.05).astype(np.float32)
        convs = [(rng.standard_normal((w, shape.dims, shape.filters)) * (1.5 / np.sqrt(w * shape.dims))).astype(np.float32) for w in shape.widths]
        bias = [np.zeros(shape.filters, np.float32) for _ in shape.widths]
        out = (rng.standard_normal(shape.filters * len(shape.widths)) * 0.1).astype(np.float32)
        return Network(shape, embed, convs, bias, out, 0.0)

    def pooled(self, words: np.ndarray):
        """Pooled answers of all filters, and where each was found."""
        values, places = [], []
        for width, conv, bias in zip(self.shape.widths, self.convs, self.conv_bias):
            n = len(words) - width + 1
            if n < 1:
                values.append(np.zeros(self.shape.filters, np.float32))
                places.append(None)
                continue
            answer = words[:n] @ conv[0]
            for k in range(1, width):
                answer += words[k : k + n] @ conv[k]
            at = answer.argmax(axis=0)
            values.append(np.maximum(answer[at, np.arange(self.shape.filters)] + bias, 0))
            places.append(at)
        return np.concatenate(values), places

    def logit(self, features: np.ndarray) -> float:
        words = self.embed[features].sum(axis=1) if len(features) else np.zeros((0, self.shape.dims), np.float32)
        return float(self.pooled(words)[0] @ self.out + self.bias)

    def probability(self, logits: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * logits + self.shift, -30, 30)))


class _Adagrad:
    def __init__(self, value: np.ndarray, rate: float):
        self.seen, self.rate = np.full(value.shape, 0.1, np.float32), rate

    def step(self, value: np.ndarray, grad: np.ndarray) -> None:
        self.seen += grad * grad
        value -= self.rate * grad / np.sqrt(self.seen)


def log_odds_start(net: Network, texts: Sequence[np.ndarray], labels: np.ndarray, doubt: float = 3.0) -> None:
    """Set the first dimension of every bucket from the texts that hold it.

    Odds are smoothed and shrunk by how few texts hold the bucket; buckets that no text holds keep 0.
    Half of the filters start by looking at that dimension, in one of their words.
    """
    counts = np.zeros((2, net.shape.buckets), np.float32)
    for features, label in zip(texts, labels):
        counts[int(label), np.unique(features)] += 1
    n0, n1 = max(1, int((labels == 0).sum())), max(1, int((labels == 1).sum()))
    odds = np.log((counts[1] + 0.5) / (n1 + 1)) - np.log((counts[0] + 0.5) / (n0 + 1))
    sure = counts.sum(axis=0)
    net.embed[:, 0] = np.where(sure > 0, odds * sure / (sure + doubt), 0) / 4
    half = net.shape.filters // 2
    for c, (width, conv) in enumerate(zip(net.shape.widths, net.convs)):
        for f in range(half):
            conv[f % width, 0, f] = 1.0
            net.out[c * net.shape.filters + f] = 1.0 / (half * len(net.shape.widths))


def train(texts: Sequence[np.ndarray], labels: np.ndarray, net: Network) -> None:
    """Fit the network to feature matrices (words x features) and 0/1 labels, in place."""
    shape = net.shape
    rng = np.random.default_rng(shape.seed + 1)
    seen_embed = np.full(net.embed.shape, 0.1, np.float32)
    steps = [_Adagrad(c, shape.rate) for c in net.convs]
    bias_steps = [_Adagrad(b, shape.rate) for b in net.conv_bias]
    out_step = _Adagrad(net.out, shape.rate * 2)
    share = float(np.clip(labels.mean(), 1e-3, 1 - 1e-3))
    net.bias = float(np.log(share / (1 - share)))
    for _ in range(shape.epochs):
        order = rng.permutation(len(texts))
        for first in range(0, len(order), shape.batch):
            g_conv = [np.zeros_like(c) for c in net.convs]
            g_bias = [np.zeros_like(b) for b in net.conv_bias]
            g_out, g_last = np.zeros_like(net.out), 0.0
            rows, grads = [], []
            batch = order[first : first + shape.batch]
            for i in batch:
                features = texts[i]
                if not len(features):
                    continue
                words = net.embed[features].sum(axis=1)
                pooled, places = net.pooled(words)
                z = float(pooled @ net.out + net.bias)
                error = np.float32((1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[i]) / len(batch))
                g_out += error * pooled
                g_last += float(error)
                back = error * net.out * (pooled > 0)
                for c, (width, at) in enumerate(zip(shape.widths, places)):
                    if at is None:
                        continue
                    own = back[c * shape.filters : (c + 1) * shape.filters]
                    g_bias[c] += own
                    for k in range(width):
                        g_conv[c][k] += words[at + k].T * own
                        rows.append(features[at + k])
                        grads.append((net.convs[c][k] * own).T)
            for value, step, grad in zip([*net.convs, *net.conv_bias, net.out], [*steps, *bias_steps, out_step], [*g_conv, *g_bias, g_out]):
                step.step(value, grad)
            net.bias -= 0.5 * g_last
            if rows:
                at = np.concatenate(rows)
                grad = np.concatenate(grads)
                ids, inverse = np.unique(at.ravel(), return_inverse=True)
                total = np.zeros((len(ids), shape.dims), np.float32)
                np.add.at(total, inverse, np.repeat(grad, at.shape[1], axis=0))
                seen_embed[ids] += total * total
                net.embed[ids] -= shape.rate * total / np.sqrt(seen_embed[ids])


def calibrate(net: Network, logits: np.ndarray, labels: np.ndarray, langs: list[str | None]) -> None:
    """Scale the logits on rows that didn't train, then set a threshold for each
    language: the score that separates its labels best, or 0.5 with too few of them."""
    a, b = 1.0, 0.0
    for _ in range(300):
        p = 1 / (1 + np.exp(-np.clip(a * logits + b, -30, 30)))
        error = p - labels
        a, b = a - 0.05 * float((error * logits).mean()) - 0.0005 * (a - 1), b - 0.05 * float(error.mean())
    net.scale, net.shift = max(a, 0.05), b
    scores = net.probability(logits)
    for lang in {x for x in langs if x is not None}:
        own = np.array([x == lang for x in langs])
        s, y = scores[own], labels[own]
        if y.sum() >= 5 and (1 - y).sum() >= 5:
            cuts = np.unique(np.round(s, 3))
            right = [(2 * ((s >= c) & (y == 1)).sum() / max(1, (s >= c).sum() + y.sum()), -abs(c - 0.5)) for c in cuts]
            net.thresholds[lang] = float(cuts[max(range(len(cuts)), key=right.__getitem__)])


class _Texts:
    """Feature matrices of texts, kept as numbers of words: 4 bytes a word of a text."""

    def __init__(self, numbers: list[np.ndarray], table: np.ndarray):
        self.numbers, self.table = numbers, table

    def __len__(self) -> int:
        return len(self.numbers)

    def __getitem__(self, i: int) -> np.ndarray:
        return self.table[self.numbers[i]]


def fit(documents: DataFrame, labels: DataFrame, most_rows: int = 10_000, shape: Shape | None = None) -> Network | None:
    """Train on documents (doc_id, text, lang) that labels (doc_id, toxic) cover.

    At most ``most_rows`` rows come to the driver, one partition after the other, and stay as numbers
    of words; each takes part with its whole text, as in scoring.  Labels are drawn before they are
    joined, so the broadcast side is bounded by ``most_rows``; equal rows are counted before texts of
    labelled rows are shuffled, and what is ordered in one task are keys of fixed size.
    """
    shape = shape or Shape()
    usable = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).distinct()
    n = usable.count()
    if not n:
        return None
    order = F.xxhash64("doc_id", F.lit("train"))
    share = min(1.0, 1.1 * most_rows / n)
    drawn = usable.where(F.pmod(order, F.lit(1 << 40)) < int(share * (1 << 40)))
    drawn = drawn.orderBy(order, "doc_id", "toxic").limit(2 * most_rows)
    texts_of = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    joined = texts_of.join(F.broadcast(drawn), "doc_id")
    key = F.struct(order.alias("o"), F.sha1(F.coalesce("text", F.lit(""))).alias("d"), "toxic", "lang")
    counted = joined.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n"), F.first("text").alias("text"))
    counted = common.materialize(counted, "labelled")
    times, left, last = {}, most_rows, None
    for row in counted.select("key", "n").orderBy("key").limit(most_rows).toLocalIterator():
        if left <= 0:
            break
        last = row["key"]
        times[tuple(last)] = min(left, row["n"])
        left -= row["n"]
    drawn_rows = []
    numbers, labels, langs, parts, known, table = [], [], [], [], {}, array("i")
    for row in counted.where(F.col("key.o") <= last["o"]).select("key", "text").toLocalIterator() if last else ():
        if tuple(row["key"]) not in times:
            continue
        words = split_words(row["text"] or "")
        own = np.empty(len(words), np.int32)
        for i, word in enumerate(words):
            if (number := known.get(word)) is None:
                if len(known) >= 200_000:
                    known.clear()
                number = known[word] = len(table) // (1 + len(shape.prefixes))
                table.extend(word_features(word, shape))
            own[i] = number
        drawn_rows.append((tuple(row["key"]), own))
    known.clear()
    # Partitions come in any order; rows take part in the order of their keys, nulls first.
    for own_key, own in sorted(drawn_rows, key=lambda r: [(v is not None, v) for v in r[0]]):
        for _ in range(times[own_key]):
            numbers.append(own)
            labels.append(own_key[2])
            langs.append(own_key[3])
            parts.append(own_key[0] % 10)
    texts = _Texts(numbers, np.array(table, np.int32).reshape(-1, 1 + len(shape.prefixes)))
    y, part = np.array(labels, np.float32), np.array(parts)
    net = Network.fresh(shape)
    pick = lambda mask: (_Texts([numbers[i] for i in np.flatnonzero(mask)], texts.table), y[mask])
    if len(set(y[part < 4])) < 2 or len(set(y[(part >= 4) & (part < 8)])) < 2:
        net.out[:] = 0
        share = float(np.clip(y.mean(), 1e-6, 1 - 1e-6))
        net.bias = float(np.log(share / (1 - share)))
        return net
    log_odds_start(net, *pick(part < 4))
    train(*pick((part >= 4) & (part < 8)), net)
    rest = np.flatnonzero(part >= 8)
    if len(rest) >= 10 and 0 < y[rest].sum() < len(rest):
        calibrate(net, np.array([net.logit(texts[i]) for i in rest]), y[rest], [langs[i] for i in rest])
    return net


class Scorer:
    """Scores whole texts with a memory of projected words."""

    def __init__(self, net: Network, most_words: int = 250_000, most_chars: int = 32 << 20):
        self.net, self.most_words, self.most_chars = net, most_words, most_chars
        self.chars = 0
        self.columns = np.concatenate([conv[k] for conv in net.convs for k in range(len(conv))], axis=1)
        self.known: dict[str, int] = {}
        self.rows = np.empty((1024, self.columns.shape[1]), np.float32)

    def _learn(self, words: list[str]) -> None:
        features = np.array([word_features(w, self.net.shape) for w in words], np.int64)
        made = self.net.embed[features].sum(axis=1) @ self.columns
        first = len(self.known)
        while first + len(words) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.empty_like(self.rows)])
        self.rows[first : first + len(words)] = made
        self.known.update(zip(words, range(first, first + len(words))))

    def logits(self, texts: list[str]) -> np.ndarray:
        split = [split_words(text) for text in texts]
        new = set()
        for words in split:
            new.update(words)
        new.difference_update(self.known)
        if len(self.known) + len(new) > self.most_words or self.chars > self.most_chars:
            self.known.clear()
            self.chars = 0
            new = {w for words in split for w in words}
        self.chars += sum(map(len, new))
        if new:
            self._learn(list(new))
        shape, out = self.net.shape, np.empty(len(texts))
        look = self.known.__getitem__
        for t, words in enumerate(split):
            best = np.zeros(shape.filters * len(shape.widths), np.float32)
            for first in range(0, max(1, len(words)), 4096):
                # Windows of a part reach into the next one.
                part = self.rows[np.fromiter(map(look, words[first : first + 4096 + max(shape.widths) - 1]), np.int64)]
                column = 0
                for c, width in enumerate(shape.widths):
                    n = len(part) - width + 1
                    if n > 0:
                        answer = part[:n, column : column + shape.filters]
                        for k in range(1, width):
                            at = column + k * shape.filters
                            answer = answer + part[k : k + n, at : at + shape.filters]
                        own = slice(c * shape.filters, (c + 1) * shape.filters)
                        best[own] = np.maximum(best[own], answer.max(axis=0) + self.net.conv_bias[c])
                    column += width * shape.filters
            out[t] = best @ self.net.out + self.net.bias
        return out


_SCORERS: dict[int, Scorer] = {}


def _scores(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model.id not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[model.id] = Scorer(model.value)
        scorer = _SCORERS[model.id]
        net = scorer.net
        for whole in batches:
            for batch in common.slices(whole, "text", 4 << 20):
                texts = [text or "" for text in batch.column("text").to_pylist()]
                score = net.probability(scorer.logits(texts))
                cut = np.array([net.thresholds.get(lang, 0.5) for lang in batch.column("lang").to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score), pa.array(score >= cut)], names=["doc_id", "score", "flagged"])

    return run


def score(documents: DataFrame, net: Network | None) -> DataFrame:
    """doc_id, score (probability of toxic) and flagged (score at or above the threshold
    calibrated for the row's language) of every document.  The network, whose size
    its shape fixes, is broadcast."""
    common.ship_package(documents.sparkSession)
    if net is None:
        return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(0.0).alias("score"), F.lit(False).alias("flagged"))
    model = documents.sparkSession.sparkContext.broadcast(net)
    slim = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    return slim.mapInArrow(_scores(_Handle(model)), "doc_id long, score double, flagged boolean")


class _Handle:
    """A broadcast network with an id by which workers remember its scorer."""

    def __init__(self, broadcast):
        self.broadcast, self.id = broadcast, xxhash.xxh64_intdigest(broadcast.value.embed.tobytes())

    @property
    def value(self) -> Network:
        return self.broadcast.value
