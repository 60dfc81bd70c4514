"""Phrase collocation mining: which words stand together more often than apart.

Texts are cut once.  A task encodes its texts in chunks of a few MB, by language: each word becomes its place in the chunk's
own list of words, each end of a piece -1.  The chunks' counts add up to those of all words; words that are frequent in their
language get a number, and each chunk gets the numbers of its own frequent words by a join, so no dictionary is broadcast
or held whole.  Rarer words break a piece like its end, since no frequent phrase holds one.

Two neighbouring numbers, of 32 bits each, are packed into one key of 8 bytes.  A chunk counts its keys, the keys are
range-partitioned and sorted (Spark sorts 8-byte keys by radix, and spills), and equal neighbours are
counted as runs.  Frequent word pairs are numbered in turn, and a phrase of three or four words whose pairs are all
frequent is again a key of two numbers: of its first and its last pair, with one bit for its length.

A key has one row for each chunk at most, so frequent keys are no hot ones; cuts and parts are joined by phrase, over frequent phrases
only.  The best of each language are taken in shares by hash first and then from the shares' best.

Defined results: a null text is empty; a null language is ``und``, as is that name itself; an empty table gives an
empty result.  Repeated rows count each.  Phrases never cross texts.  Ties of the score go by count, then by the phrase's bytes.
A very long text is a chunk of its own.  Other columns are ignored.  More than 2^32 - 2 frequent
words, or 2^31 - 2 frequent pairs, don't fit the keys and are an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftwork.llm import common

#: Where a text is cut into pieces.
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
UPPER, LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
#: A byte that UTF-8 has no use for stands for the end of a piece.
BREAK = b"\xff"
_TABLE = bytes.maketrans(PIECE_ENDS + UPPER, BREAK * len(PIECE_ENDS) + LOWER)

ENCODED = "chunk long, lang string, codes binary, words array<binary>, counts array<bigint>"
PAIRS = "chunk long, key long, n long"
KEYS = "key long, n long"
CHUNK_BYTES = 4 << 20
#: Shares of a language's phrases that are ranked apart first.
SHARES = 64
#: Marks keys of four words.
FOUR = np.uint64(1 << 63)
HALF = np.uint64(32)


def encoded(texts: list[bytes]) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(place in the list of words or -1 for the end of a piece, words, how often each occurs) of some texts."""
    data = b"\n".join(texts).translate(_TABLE).replace(BREAK, b" " + BREAK + b" ")
    found = pa.array(data.split(), pa.binary()).dictionary_encode()
    codes = found.indices.to_numpy(zero_copy_only=False).astype(np.int32)
    words = found.dictionary
    counts = np.bincount(codes, minlength=len(words))
    at = words.index(pa.scalar(BREAK, pa.binary())).as_py()
    if at >= 0:
        counts[at] = 0
        codes = np.where(codes == at, -1, codes).astype(np.int32)
    return codes, words, counts


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    chunk = TaskContext.get().partitionId() << 32
    for whole in batches:
        for batch in common.slices(whole, "text", CHUNK_BYTES):
            by_lang: dict[str, list[bytes]] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), common.utf8_column(batch.column("text"))):
                by_lang.setdefault(lang, []).append(text)
            for lang, texts in by_lang.items():
                codes, words, counts = encoded(texts)
                words = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words)
                counts = pa.ListArray.from_arrays(pa.array([0, len(counts)], pa.int32()), pa.array(counts.astype(np.int64)))
                columns = [pa.array([chunk], pa.int64()), pa.array([lang]), pa.array([codes.tobytes()], pa.binary()), words, counts]
                yield pa.RecordBatch.from_arrays(columns, names=["chunk", "lang", "codes", "words", "counts"])
                chunk += 1


def numbered(rows: DataFrame, label: str, most: int) -> DataFrame:
    """``rows``, written once, with ``id`` from 1 on without gaps; the driver sees a count for each partition."""
    stored = common.materialize(rows.withColumn("_at", F.monotonically_increasing_id()), label)
    counts = stored.groupBy(F.shiftright("_at", 33).alias("_part")).count().collect()
    offsets, at = [], 0
    for part, n in sorted((r["_part"], r["count"]) for r in counts):
        offsets.append((part, at))
        at += n
    if at > most:
        raise ValueError(f"{at} frequent entries don't fit keys of {most}")
    starts = F.broadcast(rows.sparkSession.createDataFrame(offsets, "_part long, _start long"))
    number = F.col("_start") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1
    return stored.withColumn("_part", F.shiftright("_at", 33)).join(starts, "_part").withColumn("id", number).drop("_part", "_at", "_start")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (key, n) to the sum of each run of equal keys; the last run waits for the next batch."""
    key = total = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, n = batch.column("key").to_numpy(), batch.column("n").to_numpy()
        if key is not None:
            keys, n = np.concatenate([[key], keys]), np.concatenate([[total], n])
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        sums = np.add.reduceat(n, starts)
        key, total = keys[starts[-1]], sums[-1]
        yield pa.RecordBatch.from_arrays([pa.array(keys[starts[:-1]]), pa.array(sums[:-1])], names=["key", "n"])
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([total], pa.int64())], names=["key", "n"])


def frequent_keys(rows: DataFrame, least: int) -> DataFrame:
    """key and its count ``a``, of the keys that occur ``least`` times or more."""
    ordered = rows.select("key", "n").repartitionByRange("key").sortWithinPartitions("key")
    return ordered.mapInArrow(_runs, KEYS).where(F.col("n") >= least).withColumnRenamed("n", "a")


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, n = np.unique(keys, return_counts=True)
    return found.astype(np.uint64).view(np.int64), n.astype(np.int64)


def _known(batch: pa.RecordBatch, i: int, kind) -> tuple[np.ndarray, np.ndarray]:
    """What a join collected for a chunk: (places or keys, their numbers)."""
    pairs = batch.column("known")[i].values
    return pairs.field(0).to_numpy(zero_copy_only=False).astype(kind), pairs.field(1).to_numpy(zero_copy_only=False).astype(np.uint32)


def _renumber(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Codes of a chunk to numbers of frequent words, 0 elsewhere."""
    for batch in batches:
        for i in range(batch.num_rows):
            codes = np.frombuffer(batch.column("codes")[i].as_buffer(), np.int32)
            places, ids = _known(batch, i, np.int64)
            # The last entry is that of code -1.
            to = np.zeros(max(int(codes.max(initial=-1)), int(places.max(initial=-1))) + 2, dtype=np.uint32)
            to[places] = ids
            yield pa.RecordBatch.from_arrays([batch.column("chunk").slice(i, 1), pa.array([to[codes].tobytes()], pa.binary())], names=["chunk", "ids"])


def pair_keys(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key of the words at i and i + 1, whether both are frequent) for each i."""
    wide = ids.astype(np.uint64)
    return (wide[:-1] << HALF) | wide[1:], (ids[:-1] > 0) & (ids[1:] > 0)


def longer_keys(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of three and of four words, from the number of the frequent pair that starts at each word, or 0."""
    wide, there = pairs.astype(np.uint64), pairs > 0
    three = there[:-1] & there[1:]
    four = three[:-1] & there[2:]
    return ((wide[:-1] << HALF) | wide[1:])[three], ((wide[:-2] << HALF) | wide[2:] | FOUR)[four]


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            keys, both = pair_keys(np.frombuffer(batch.column("ids")[i].as_buffer(), np.uint32))
            found, n = _counted(keys[both])
            chunk = np.full(len(found), batch.column("chunk")[i].as_py(), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(chunk), pa.array(found), pa.array(n)], names=["chunk", "key", "n"])


def _longer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            keys, both = pair_keys(np.frombuffer(batch.column("ids")[i].as_buffer(), np.uint32))
            known, ids = _known(batch, i, np.int64)
            known = known.view(np.uint64)
            order = np.argsort(known)
            known, ids = known[order], ids[order]
            at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
            pairs = np.where(both & (known[at] == keys), ids[at], np.uint32(0))
            for some in longer_keys(pairs):
                found, n = _counted(some)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n)], names=["key", "n"])


def _per_chunk(rows: DataFrame, key: str) -> DataFrame:
    """A chunk's own entries, which its size bounds, in one row."""
    return rows.groupBy("chunk").agg(F.collect_list(F.struct(key, "id")).alias("known"))


def _word(ids: Column, at: int) -> Column:
    return F.shiftrightunsigned(ids, 32) if at == 0 else ids.bitwiseAND(0xFFFFFFFF)


def frequent_phrases(documents: DataFrame, least: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(words: lang, word, f, id; phrases of one to four words: ids, a; words in all by language: lang, n)."""
    common.ship_package(documents.sparkSession)
    slim = documents.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    chunks = common.materialize(slim.mapInArrow(_encode, ENCODED), "chunks")
    sizes = chunks.select("lang", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("lang").agg(F.sum("n").alias("n"))

    each = chunks.select("chunk", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("place", "e")).where("e.counts > 0")
    each = each.select("chunk", "lang", "place", F.col("e.words").alias("word"), F.col("e.counts").alias("n"))
    words = numbered(each.groupBy("lang", "word").agg(F.sum("n").alias("f")).where(F.col("f") >= least), "words", (1 << 32) - 2)
    own = _per_chunk(each.drop("n").join(words, ["lang", "word"]), "place")
    runs = common.materialize(chunks.select("chunk", "codes").join(own.hint("shuffle_hash"), "chunk").mapInArrow(_renumber, "chunk long, ids binary"), "runs")

    pairs = common.materialize(runs.mapInArrow(_pairs, PAIRS), "pairs")
    twos = numbered(frequent_keys(pairs, least), "twos", (1 << 31) - 2)
    own = _per_chunk(pairs.select("chunk", "key").join(twos, "key"), "key")
    longer = common.materialize(runs.join(own.hint("shuffle_hash"), "chunk").mapInArrow(_longer, KEYS), "longer")
    more = common.materialize(frequent_keys(longer, least), "more")

    two = twos.select("id", F.array(_word(F.col("key"), 0), _word(F.col("key"), 1)).alias("ids"), "a")
    first = two.select(F.col("id").alias("first"), F.col("ids").alias("first_ids"))
    last = two.select(F.col("id").alias("last"), F.col("ids").alias("last_ids"))
    halves = more.select((F.col("key") < 0).alias("four"), _word(F.col("key"), 0).bitwiseAND(0x7FFFFFFF).alias("first"), _word(F.col("key"), 1).alias("last"), "a")
    spelt = halves.join(first, "first").join(last, "last")
    many = spelt.select(F.concat("first_ids", F.when(F.col("four"), F.col("last_ids")).otherwise(F.slice("last_ids", 2, 1))).alias("ids"), "a")
    phrases = words.select(F.array("id").alias("ids"), F.col("f").alias("a")).union(two.select("ids", "a")).union(many)
    return words, common.materialize(phrases, "phrases"), sizes


def scored(phrases: DataFrame) -> DataFrame:
    """ids, a, and of the cut with the lowest score l, r and score, for phrases of two words or more."""
    exact = lambda c: F.col(c).cast("decimal(20,0)")
    cuts = phrases.where(F.size("ids") > 1).withColumn("k", F.explode(F.sequence(F.lit(1), F.size("ids") - 1)))
    cuts = cuts.withColumn("left", F.expr("slice(ids, 1, k)")).withColumn("right", F.expr("slice(ids, k + 1, size(ids) - k)"))
    of = lambda part, count: phrases.select(F.col("ids").alias(part), F.col("a").alias(count))
    cuts = cuts.join(of("left", "l"), "left").join(of("right", "r"), "right").withColumn("below", exact("l") + exact("r"))
    cuts = cuts.withColumn("score", F.expr("(cast(2000000 as decimal(8,0)) * cast(a as decimal(20,0))) div below"))
    return cuts.groupBy("ids", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("ids", "a", "cut.l", "cut.r", "cut.score")


def contained(phrases: DataFrame) -> DataFrame:
    """ids of each phrase within a longer one, and the largest count of a longer one."""
    part = "transform(sequence(2, size(ids) - 1), m -> transform(sequence(1, size(ids) - m + 1), s -> slice(ids, s, m)))"
    return phrases.where(F.size("ids") > 2).select(F.explode(F.flatten(F.expr(part))).alias("ids"), "a").groupBy("ids").agg(F.max("a").alias("longer"))


def mine(documents: DataFrame, least: int = 30, percent: int = 80) -> DataFrame:
    """All phrases of two to four words that occur ``least`` times or more and aren't mostly part of a longer one:
    lang, phrase, a, l, r, n, score."""
    words, phrases, sizes = frequent_phrases(documents, least)
    exact = lambda c: F.col(c).cast("decimal(20,0)")
    own = scored(phrases).join(contained(phrases), "ids", "left").where(F.col("longer").isNull() | (exact("longer") * 100 < exact("a") * percent)).drop("longer")
    named = own.select("*", F.posexplode("ids").alias("at", "id")).join(words.select("id", "lang", "word"), "id")
    named = named.groupBy("ids", "a", "l", "r", "score", "lang").agg(F.sort_array(F.collect_list(F.struct("at", "word"))).alias("spelt"))
    phrase = F.concat_ws(" ", F.transform("spelt", lambda s: s["word"].cast("string")))
    return named.select("lang", phrase.alias("phrase"), "a", "l", "r", "score").join(sizes, "lang").select("lang", "phrase", "a", "l", "r", "n", "score")


def best(mined: DataFrame, most: int = 2000) -> DataFrame:
    """The first ``most`` of each language by score, count and phrase, with their rank."""
    order = [F.desc("score"), F.desc("a"), "phrase"]
    share = F.pmod(F.xxhash64("phrase"), F.lit(SHARES))
    few = mined.withColumn("_share", share).withColumn("_at", F.row_number().over(Window.partitionBy("lang", "_share").orderBy(*order))).where(F.col("_at") <= most)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= most)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def best_sql(least: int = 30, percent: int = 80, most: int = 2000) -> str:
    """DuckDB SQL for the same rows."""
    return rf"""
        WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER.decode()}', '{LOWER.decode()}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
        w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
        g AS (SELECT lang, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM w, (VALUES (1), (2), (3), (4)) t(m)),
        f AS MATERIALIZED (SELECT lang, ws[i:i + m - 1] AS ph, count(*) AS f FROM g GROUP BY ALL),
        n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE len(ph) = 1 GROUP BY lang),
        c AS MATERIALIZED (SELECT lang, ph, f AS a FROM f WHERE len(ph) > 1 AND f >= {least}),
        k AS (SELECT lang, ph, a, unnest(range(1, len(ph))) AS k FROM c),
        cut AS (SELECT lang, ph, a, k, ph[1:k] AS left_ph, ph[k + 1:] AS right_ph FROM k),
        s AS (SELECT cut.*, l.f AS l, r.f AS r, (2000000::HUGEINT * a) // (l.f + r.f) AS score
              FROM cut JOIN f l ON l.lang = cut.lang AND l.ph = left_ph JOIN f r ON r.lang = cut.lang AND r.ph = right_ph),
        b AS (SELECT *, row_number() OVER (PARTITION BY lang, ph ORDER BY score, k) AS nth FROM s),
        u AS (SELECT lang, a, ph, m, unnest(range(1, len(ph) - m + 2)) AS i FROM c, (VALUES (2), (3)) t(m) WHERE m < len(ph)),
        longer AS (SELECT lang, ph[i:i + m - 1] AS ph, max(a) AS top FROM u GROUP BY ALL),
        kept AS (SELECT b.lang, array_to_string(b.ph, ' ') AS phrase, a, l, r, score FROM b LEFT JOIN longer USING (lang, ph)
                 WHERE nth = 1 AND (top IS NULL OR 100 * top < {percent} * a)),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
        SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN n USING (lang) WHERE rank <= {most}"""
