"""Mixing sources to target weights by hash-threshold histograms.

A source's documents are ordered by a hash of their identity, without being sorted:
words are summed by (source, hash bucket), and the running sums name the bucket in
which the source's budget is reached.  Only the documents of that boundary bucket are
looked at again, in finer buckets, until the boundary is as fine as asked.  The
result is one hash threshold for each source; taking documents is then a filter.
Thresholds are nested: a larger budget takes all that a smaller one takes.

Budgets above a source's words take every document once for each whole multiple
and those under the threshold once more.

Rows that repeat an id and a text share their hash.  Where such rows fill a boundary
bucket, they are told apart by a hash of their row number, in the same way, so that
as many of them are taken as the budget asks for.

Defined results: a null text has 0 words; a null source is a source of its own, last
in order; a null doc_id hashes like a value; of repeated rows as many are taken as fit, whichever
they are; sources without words get the target 0; an empty table gives an empty
result; a very long text counts like another, and comes as near the target as its size lets it; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftwork.llm import common

#: Bits of the hash that a level of the histogram tells apart, and the levels.
LEVEL_BITS = 12
LEVELS = 3
HASH_BITS = LEVEL_BITS * LEVELS


def identity_hash(doc_id: Column, text: Column) -> Column:
    """A hash of ``HASH_BITS`` bits of a document's identity: the first hex digits of
    the MD5 of "doc_id:text"."""
    identity = F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(identity), 1, HASH_BITS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """One row for each source: source, source_size, target.

    Sources in code-point order, null last, get the weights in turn.  Together they
    share ``share`` times all words; a target above ``most`` times its source's words is cut
    to that, and the excess goes to the others by weight, until none is above.  The rounds
    end when no further source is cut.

    Cutting the source with the smallest limit per weight first gives the same end
    without rounds: with the sources in that order, the first k are cut, and the rest share
    what is left by weight; k is the smallest for which none of the rest is above.
    """
    n = len(weights)
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source"))) - 1
    weigh = per_source.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(place, F.lit(n)) + 1).cast("int")).cast("double"))
    limit = F.col("source_size") * F.lit(float(most))
    by_fill = Window.orderBy((limit / F.col("weight")), F.col("source").isNull(), F.col("source"))
    everything = Window.partitionBy()
    ranked = (
        weigh.withColumn("limit", limit)
        .withColumn("cut_before", F.coalesce(F.sum("limit").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("weight_from", F.sum("weight").over(by_fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("rate", (F.col("budget") - F.col("cut_before")) / F.col("weight_from"))
        .withColumn("kept_whole", F.col("rate") * F.col("weight") <= F.col("limit"))
        .withColumn("final_rate", F.min(F.when(F.col("kept_whole"), F.struct(F.col("limit") / F.col("weight"), F.col("rate").alias("rate")))).over(everything)["rate"])
    )
    target = F.when(F.col("final_rate").isNull(), F.col("limit")).otherwise(F.least(F.col("limit"), F.col("final_rate") * F.col("weight")))
    return ranked.select("source", "source_size", target.alias("target"))


def _refined(rows: DataFrame, state: DataFrame, key: str, low: str, level: int, within: Column | None = None) -> DataFrame:
    """The state with the threshold ``low`` on the hash ``key`` told apart by ``LEVEL_BITS`` more bits.

    The boundary bucket is the first whose running sum exceeds the need.  At the finest level it is taken
    too if that comes closer to the target; but a bucket of several rows is left to the next hash, if there is one.
    """
    shift = HASH_BITS - LEVEL_BITS * (level + 1)
    finest, more_hashes = level == LEVELS - 1, key == "h"
    same_source = F.col("source").eqNullSafe(F.col("t_source"))
    inside = rows.join(state, same_source).where((F.col(key) >= F.col(low)) & (F.col(key) < F.col(low) + (1 << (shift + LEVEL_BITS))) & (F.col("t_need") > 0))
    if within is not None:
        inside = inside.where(within)
    hist = inside.groupBy("source", F.shiftright(key, shift).alias("bucket")).agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("rows"))
    running = hist.withColumn("upto", F.sum("words").over(Window.partitionBy("source").orderBy("bucket")))
    fits = F.col("upto") <= F.col("t_need")
    if finest:
        closer = F.col("upto") - F.col("words") / 2 <= F.col("t_need")
        fits = fits | (closer & (F.col("rows") == 1)) if more_hashes else closer
    passed = (
        running.join(state, same_source)
        .groupBy("source")
        .agg(F.max(F.when(fits, F.col("upto"))).alias("got"), F.max(F.when(fits, F.col("bucket"))).alias("last_in"), F.min(F.when(~fits, F.struct("bucket", "rows"))).alias("out"))
        .withColumnRenamed("source", "g_source")
    )
    step = state.join(passed, F.col("t_source").eqNullSafe(F.col("g_source")), "left")
    new_low = F.coalesce(F.shiftleft(F.col("out.bucket"), shift), F.shiftleft(F.col("last_in") + 1, shift), F.col(low)).cast("long")
    changed = {low: new_low, "t_need": F.col("t_need") - F.coalesce(F.col("got"), F.lit(0))}
    if finest and more_hashes:
        changed["t_rows"] = F.when(F.col("out.rows") > 1, F.col("out.rows")).otherwise(0)
    return common.materialize(step.select(*[changed.get(c, F.col(c)).alias(c) for c in state.columns]), "mixing-level")


def take(documents: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken, for every document, and ``keep``.

    Documents are read once, into a slim table; histograms have a row for each
    source and bucket and are summed on the map side, so a source with a third of
    all rows is as cheap as the others.
    """
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    slim = common.materialize(
        documents.select(doc_id.alias("doc_id"), F.col("source").cast("string").alias("source"), common.word_count(text).alias("size"), identity_hash(doc_id, text).alias("h"), *keep)
        .withColumn("h2", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << HASH_BITS))),
        "mixing",
    )
    targets = common.materialize(source_targets(slim, weights, share, most), "mixing-targets")
    # Copies that every document gets, and the words still to be found by threshold.
    # Rows below (t_low, t_low2) in the order of (h, h2) are taken once more.
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    # ``need``: words left above the threshold; ``rows``: rows that share the boundary hash, where that is to be split.
    state = targets.withColumn("copies", whole).withColumn("need", F.col("target") - F.col("copies") * F.col("source_size"))
    state = state.withColumns({c: F.lit(0).cast("long") for c in ("low", "low2", "rows")}).select(*[F.col(c).alias(f"t_{c}") for c in ("source", "source_size", "target", "copies", "need", "low", "low2", "rows")])
    counted = slim.where("size > 0")
    for level in range(LEVELS):
        state = _refined(counted, state, "h", "t_low", level)
    if not state.where("t_rows > 1").isEmpty():
        for level in range(LEVELS):
            state = _refined(counted, state, "h2", "t_low2", level, within=(F.col("h") == F.col("t_low")) & (F.col("t_rows") > 1))
    below = (F.col("h") < F.col("t_low")) | ((F.col("h") == F.col("t_low")) & (F.col("h2") < F.col("t_low2")))
    taken = F.col("t_copies") + F.when(below, 1).otherwise(0)
    return slim.join(state, F.col("source").eqNullSafe(F.col("t_source"))).select(
        "doc_id",
        "source",
        "size",
        F.col("t_source_size").alias("source_size"),
        F.col("t_target").alias("target"),
        taken.cast("long").alias("copies"),
        (taken * F.col("size")).cast("long").alias("taken"),
        *keep,
    )


def take_sql(weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> str:
    """DuckDB SQL for doc_id, size, source_size, target and taken over ``documents``: the same
    targets, and the thresholds by sorting each source by hash, which ``take`` avoids."""
    cases = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(weights))
    return f"""
        WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{common.WORD_PATTERN}'))::BIGINT AS size,
                   ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':' || coalesce(text, '')), 1, {HASH_BITS // 4}))::BIGINT AS h FROM documents),
        s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
        w AS (SELECT *, source_size * {most}::DOUBLE AS lim, (CASE (row_number() OVER (ORDER BY source IS NULL, source COLLATE "C") - 1) % {len(weights)} {cases} END)::DOUBLE AS weight FROM s),
        r AS (SELECT *, lim / weight AS fill, coalesce(sum(lim) OVER (ORDER BY lim / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cut,
              sum(weight) OVER (ORDER BY lim / weight, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_from,
              sum(source_size) OVER () * {share}::DOUBLE AS budget FROM w),
        f AS (SELECT *, (budget - cut) / weight_from AS rate FROM r),
        e AS (SELECT arg_min(rate, fill) AS final_rate FROM f WHERE rate * weight <= lim),
        t AS (SELECT source, source_size, CASE WHEN final_rate IS NULL THEN lim ELSE least(lim, final_rate * weight) END AS target FROM f LEFT JOIN e ON true),
        n AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS copies FROM t),
        u AS (SELECT rid, sum(size) OVER (PARTITION BY source ORDER BY h, rid) - size / 2 AS middle FROM d WHERE size > 0)
        SELECT doc_id, size, n.source_size, n.target, ((copies + CASE WHEN u.middle <= n.target - copies * n.source_size AND n.target > copies * n.source_size THEN 1 ELSE 0 END) * size)::BIGINT AS taken
        FROM d JOIN n ON d.source IS NOT DISTINCT FROM n.source LEFT JOIN u ON d.rid = u.rid"""
