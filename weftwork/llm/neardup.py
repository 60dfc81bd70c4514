"""Near-duplicate groups by chosen-path set similarity join over minwise tokens.

A document is its set of distinct word shingles.  One pass over the texts gives each
set's size, a signature (equal for equal sets) and a sketch of minwise tokens.

1. Equal sets form classes; one row stands for each class from here on.
2. Trees: in tree k, a class's root node is its k-th minwise token.  A node of at
   most ``node_limit`` classes is compared exhaustively, by sketch.  A larger node is split by
   further minwise tokens that the path selects; each is followed by every member, one or
   two a level, so that a pair at the threshold is expected to stay together in at
   least one child.  Nodes that a fixed depth hasn't made small are compared in blocks, so that
   no case is dropped.  Independent trees bring the recall to its target.
3. Members whose sketches agree form clusters inside a node, dealt into parts of bounded size; the whole
   texts of a part come together and are linked by exact Jaccard similarity on full shingle sets, best sketches first.
   A pair is skipped only when its two sides are already connected by confirmed links.
4. Components of the confirmed links, by alternating large-star and small-star steps.

A first pass over a few trees only contracts: large nodes are dealt into blocks that share
pivots, in linear work, and the links found there join most of any large group.  The pass over
all trees then loses nothing: it drops nodes whose members are connected already, compares only
unlike labels, and where almost all of a large node is one group, it compares the others with
all of it in blocks, without splitting.  Nodes that have the same members in several trees are
compared once.

All steps are joins and aggregations keyed by node or class; nothing is gathered on the driver.
Joins that carry sketches or texts are merge joins at every size; those of small link tables are left to Spark, which
broadcasts a side only where its size is below the session's threshold; where one side is a small part of
the other, a bitmap of fixed size filters the large side first, so that texts are shuffled only
for candidates.

Defined results: texts with fewer words than a shingle are one shingle, the whole
sequence; null, empty and blank texts have no shingle and are linked with nothing.  A null
doc_id comes after all others when a group's smallest is chosen.  Repeated rows are in
one class.  A very long text is sketched whole; where it is compared, its part holds few others.  An empty table gives an empty result.  Other columns are ignored unless kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftwork.llm import common

TOKENS = 128
TREES = 12
FIRST_TREES = 3
PIVOTS = 4
#: Shingles, and in the contracting pass also rows, whose texts meet in one part of a cluster.
PART_SHINGLES, PART_ROWS = 2_000_000, 256
_SEEDS = np.random.default_rng(20240917).integers(1, 1 << 63, (2, TOKENS), dtype=np.uint64)
_FACTOR, _SHIFT = _SEEDS[0] * np.uint64(2) + np.uint64(1), _SEEDS[1]
_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xBF58476D1CE4E5B9)


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """The distinct shingles of a UTF-8 text as sorted 64-bit hashes.

    bytes.lower and bytes.split know ASCII alone: A-Z, and space, tab, LF, VT, FF, CR.
    """
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(hashes) - width + 1)
    out = np.full(n, min(width, len(hashes)), np.uint64)
    for i in range(min(width, len(hashes))):
        out = (out ^ (out >> np.uint64(29))) * _MIX2 + hashes[i : i + n]
    out = (out ^ (out >> np.uint64(31))) * _MIX
    return np.unique(out ^ (out >> np.uint64(30)))


def minwise(shingles: np.ndarray) -> np.ndarray:
    """The smallest value of each of the hash functions over a set that isn't empty."""
    best = np.full(TOKENS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 2048):
        part = shingles[at : at + 2048]
        np.minimum(best, (_FACTOR[:, None] * part[None, :] + _SHIFT[:, None]).min(axis=1), out=best)
    return best


def jaccard_at_least(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, for sorted distinct arrays."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


SKETCH = "n_shingles long, signature binary, roots array<long>, sketch binary"


def _sketches(width: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in common.slices(whole, "text"):
                sizes, signatures, roots, sketches = [], [], [], []
                for text in common.utf8_column(batch.column("text")):
                    shingles = shingle_set(text, width)
                    sizes.append(len(shingles))
                    if not len(shingles):
                        signatures.append(None)
                        roots.append(None)
                        sketches.append(None)
                        continue
                    least = minwise(shingles)
                    signatures.append(xxhash.xxh3_128_digest(shingles.tobytes()))
                    roots.append(least[:TREES].view(np.int64))
                    sketches.append(((least * _MIX) >> np.uint64(48)).astype("<u2").tobytes())
                made = [pa.array(sizes, pa.int64()), pa.array(signatures, pa.binary()), pa.array(roots, pa.list_(pa.int64())), pa.array(sketches, pa.binary())]
                yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*names, "n_shingles", "signature", "roots", "sketch"])

    return run


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches sorted by their first column, as one table for each of its values."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0).to_numpy()
        edges = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        if held and held[-1].column(0)[0].as_py() != keys[0]:
            yield pa.Table.from_batches(held)
            held = []
        for start, end in zip(edges, edges[1:]):
            part = batch.slice(start, end - start)
            if end < len(keys):
                yield pa.Table.from_batches([*held, part])
                held = []
            else:
                held.append(part)
    if held:
        yield pa.Table.from_batches(held)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, TOKENS)


def _agreement(rows: np.ndarray, others: np.ndarray) -> np.ndarray:
    """In how many tokens each of the rows agrees with each of the others."""
    if len(rows) * len(others) <= 1024:
        return (rows[:, None, :] == others[None, :, :]).sum(axis=2)
    out = np.zeros((len(rows), len(others)), np.uint8)
    for own, their in zip(np.ascontiguousarray(rows.T), np.ascontiguousarray(others.T)):
        out += own[:, None] == their[None, :]
    return out


def _alike(sketches: np.ndarray, sizes: np.ndarray, labels: np.ndarray, least: int, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (i < j) of rows of unlike labels that agree in ``least`` tokens or more, and in how many.

    Rows of the most frequent label are compared with the others only, in blocks.
    """
    kinds, counts = np.unique(labels, return_counts=True)
    common_label = kinds[counts.argmax()]
    rest = np.flatnonzero(labels != common_label) if counts.max() > 1 else np.arange(len(labels))
    every = np.arange(len(labels))
    # A pair of two rest rows is met once, by its earlier row.
    rank = np.full(len(labels), -1)
    rank[rest] = np.arange(len(rest))
    left, right, agree = [], [], []
    for at in range(0, len(rest), 64):
        block = rest[at : at + 64]
        others = every[(rank < 0) | (rank >= at)]
        same = _agreement(sketches[block], sketches[others])
        big, small = np.maximum(sizes[block][:, None], sizes[others][None, :]), np.minimum(sizes[block][:, None], sizes[others][None, :])
        near = (same >= least) & (100 * small >= percent * big) & (labels[block][:, None] != labels[others][None, :])
        near &= (rank[others][None, :] < 0) | (rank[others][None, :] > rank[block][:, None])
        i, j = np.nonzero(near)
        left.append(np.minimum(block[i], others[j]))
        right.append(np.maximum(block[i], others[j]))
        agree.append(same[i, j].astype(np.int64))
    if not left:
        none = np.empty(0, np.int64)
        return none, none, none
    return np.concatenate(left), np.concatenate(right), np.concatenate(agree)


class _Forest:
    """Union-find over the members of one node."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        a, b = self.root(i), self.root(j)
        self.up[max(a, b)] = min(a, b)
        return a != b


def parts_of(sizes: np.ndarray, contract: bool, most: int = PART_SHINGLES, most_rows: int = PART_ROWS) -> list[list[int]]:
    """Deal the members of a cluster, given their numbers of shingles, into parts to be compared.

    To contract, parts share the first member as pivot, which is linear.  Else members are dealt into
    halves of parts, and each half meets each other one, so that all pairs meet.
    """
    if sizes.sum() <= most and not (contract and len(sizes) > most_rows):
        return [list(range(len(sizes)))]
    room, rows = (most - int(sizes[0]), most_rows - 1) if contract else (most // 2, len(sizes))
    dealt: list[list[int]] = [[]]
    held = 0
    for i in range(1 if contract else 0, len(sizes)):
        if dealt[-1] and (held + sizes[i] > room or len(dealt[-1]) >= rows):
            dealt.append([])
            held = 0
        dealt[-1].append(i)
        held += int(sizes[i])
    if contract:
        return [[0, *part] for part in dealt]
    if len(dealt) == 1:
        return dealt
    return [dealt[a] + dealt[b] for a in range(len(dealt)) for b in range(a + 1, len(dealt))]


def _clusters(least: int, percent: int, contract: bool):
    """Node members to (part of a cluster, member): what agrees by sketch, transitively."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clusters, members, marks = [], [], []

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (clusters, members, marks)], names=["cluster", "row_id", "label"])
            for x in (clusters, members, marks):
                x.clear()
            return batch

        for group in _groups(batches):
            if group.num_rows < 2:
                continue
            ids, labels = group.column("row_id").to_numpy(), group.column("label").to_numpy()
            sizes = group.column("n_shingles").to_numpy()
            left, right, _ = _alike(_matrix(group.column("sketch")), sizes, labels, least, percent)
            if not len(left):
                continue
            forest = _Forest(len(ids))
            for i, j in zip(left.tolist(), right.tolist()):
                forest.join(i, j)
            node = group.column(0)[0].as_py()
            own: dict[int, list[int]] = {}
            for i in sorted({*left.tolist(), *right.tolist()}):
                own.setdefault(forest.root(i), []).append(i)
            for root, group_members in own.items():
                of = np.array(group_members)
                for k, part in enumerate(parts_of(sizes[of], contract)):
                    clusters += [xxhash.xxh3_64_intdigest(f"{node} {ids[root]} {k}") - (1 << 63)] * len(part)
                    members += ids[of[part]].tolist()
                    marks += labels[of[part]].tolist()
                    if len(members) > 50_000:
                        yield out()
        yield out()

    return run


def _links(width: int, least: int, percent: int):
    """Cluster members with texts to confirmed links (a, b), enough to connect them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left_ids, right_ids = [], []
        for group in _groups(batches):
            if group.num_rows < 2:
                continue
            ids, labels = group.column("row_id").to_numpy(), group.column("label").to_numpy()
            sets = [shingle_set(text, width) for text in common.utf8_column(group.column("text"))]
            left, right, agree = _alike(_matrix(group.column("sketch")), np.array([*map(len, sets)]), labels, least, percent)
            order = np.argsort(-agree, kind="stable")
            forest = _Forest(len(ids))
            seen: dict[int, int] = {}
            for i, label in enumerate(labels.tolist()):
                forest.join(i, seen.setdefault(label, i))
            for i, j in zip(left[order].tolist(), right[order].tolist()):
                if forest.root(i) != forest.root(j) and jaccard_at_least(sets[i], sets[j], percent):
                    forest.join(i, j)
                    left_ids.append(int(ids[i]))
                    right_ids.append(int(ids[j]))
        yield pa.RecordBatch.from_arrays([pa.array(left_ids, pa.int64()), pa.array(right_ids, pa.int64())], names=["a", "b"])

    return run


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b): the smallest node it reaches.

    Large-star and small-star steps in turn, until a round changes nothing.  Each round
    is written to the shared folder, so the plan stays short and lost executors cost
    one round.
    """
    edges = common.materialize(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    mark = lambda df: df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
    seen = mark(edges)
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = common.materialize(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = common.materialize(small.where("u <> v").union(least.select("u", F.col("m").alias("v"))).distinct(), "small-star")
        now = mark(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())


def _member_mark() -> Column:
    return F.bit_xor(F.xxhash64("row_id", F.lit("member")))


def _unlike(nodes: DataFrame) -> DataFrame:
    """One node of those that have the same members."""
    return nodes.groupBy("n", "mark").agg(F.min("node").alias("node")).select("node", "n")


def _dealt(rows: DataFrame, node_limit: int) -> DataFrame:
    """Add ``blocks``, how many blocks of half the limit a node of ``n`` rows makes, and ``own``."""
    blocks = F.ceil(F.col("n") / F.lit(max(1, node_limit // 2))).cast("long")
    return rows.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("row_id"), F.col("blocks")))


def _in_every_block(rows: DataFrame) -> DataFrame:
    spread = rows.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return spread.select(F.xxhash64("node", "block").alias("node"), "row_id", "label")


def _contracting(inside: DataFrame, node_limit: int) -> DataFrame:
    """Blocks of large nodes that link what is alike, in linear work: every block also holds a
    few rows of the node, its pivots, which tie the blocks together."""
    dealt = _dealt(inside, node_limit)
    picks = [F.min(F.struct(F.xxhash64("row_id", F.lit(k)).alias("h"), "row_id", "label", "blocks")) for k in range(PIVOTS)]
    pivots = dealt.groupBy("node").agg(F.array_distinct(F.array(*picks)).alias("p")).select("node", F.explode("p").alias("p")).select("node", "p.row_id", "p.label", "p.blocks")
    return dealt.select(F.xxhash64("node", "own").alias("node"), "row_id", "label").union(_in_every_block(pivots)).distinct()


def _leaves(labelled: DataFrame, reps: DataFrame, trees: range, node_limit: int, second_branch: int, depth: int, contract: bool) -> DataFrame:
    """(node, row_id, label) of all nodes to be compared, over the given trees.

    Nodes whose members all have one label are finished; of nodes with the same members one is kept.
    Large nodes are dealt into blocks, if the aim is to contract.  Else one in which almost all
    members have one label compares the others with all, in blocks; the rest is split by tokens.
    """
    level = labelled.select("row_id", "label", F.explode(F.slice("roots", trees.start + 1, len(trees))).alias("node"))
    leaves: list[DataFrame] = []
    for at in range(depth + 1):
        sums = [F.count(F.lit(1)).alias("n"), _member_mark().alias("mark"), F.min("label").alias("low"), F.max("label").alias("high")]
        nodes = common.materialize(_unlike(level.groupBy("node").agg(*sums).where("low < high")), "nodes")
        leaves.append(common.materialize(level.join(nodes.where(F.col("n") <= node_limit).hint("merge"), "node").select("node", "row_id", "label"), "leaves"))
        big = nodes.where(F.col("n") > node_limit)
        if big.isEmpty():
            break
        inside = common.materialize(level.join(big.hint("merge"), "node").select("node", "row_id", "label", "n"), "inside")
        if contract:
            leaves.append(_contracting(inside, node_limit))
            break
        tops = inside.groupBy("node", "label").agg(F.count(F.lit(1)).alias("c")).groupBy("node").agg(F.max(F.struct("c", "label")).alias("top"))
        inside = _dealt(inside, node_limit).join(tops.hint("merge"), "node").withColumn("few", F.col("n") - F.col("top.c") <= F.lit(max(1, node_limit // 4)))
        inside = common.materialize(inside.withColumn("major", F.col("label") == F.col("top.label")).drop("top"), "sorted-out")
        few = inside.where("few")
        leaves.append(few.where("major").select(F.xxhash64("node", "own").alias("node"), "row_id", "label").union(_in_every_block(few.where("NOT major"))))
        inside = inside.where("NOT few")
        if at == depth:
            # Each block with each: every pair of the node meets once or more.
            paired = inside.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
            leaves.append(paired.select(F.xxhash64("node", F.least("own", "other"), F.greatest("own", "other")).alias("node"), "row_id", "label"))
            break
        known = common.likely_in(reps.select("row_id", "sketch"), inside, "row_id")
        branches = F.when(F.pmod(F.xxhash64("node", F.lit("branches")), F.lit(100)) < second_branch, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
        coordinate = F.pmod(F.xxhash64("node", "branch"), F.lit(TOKENS)).cast("int")
        token = F.substring(F.col("sketch"), coordinate * 2 + 1, F.lit(2))
        level = inside.join(known.hint("merge"), "row_id").select("row_id", "label", "sketch", "node", F.explode(branches).alias("branch"))
        level = common.materialize(level.select("row_id", "label", F.xxhash64("node", "branch", coordinate, token).alias("node")), "level")
    members = leaves[0]
    for more in leaves[1:]:
        members = members.union(more)
    return members


def group(
    documents: DataFrame,
    percent: int = 80,
    width: int = 5,
    keep: tuple[str, ...] = (),
    node_limit: int = 2048,
    second_branch: int = 60,
    depth: int = 8,
) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id of the group), kept_row, and ``keep``.

    ``kept_row`` is true for exactly one row of each group.  ``second_branch`` is the percentage
    of large nodes that are followed into two children a level.
    """
    spark = documents.sparkSession
    common.ship_package(spark)
    names = ["doc_id", "text", *[c for c in keep if c not in ("doc_id", "text")]]
    slim = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *names[2:])
    schema = T.StructType([*slim.schema.fields, *T.StructType.fromDDL(SKETCH).fields])
    sketched = common.materialize(slim.mapInArrow(_sketches(width, names), schema).withColumn("row_id", F.monotonically_increasing_id()), "sketches")
    with common.tracking() as paths:
        company = common.materialize(_company(sketched, percent, width, node_limit, second_branch, depth), "company").withColumnRenamed("signature", "s")
    common.delete(spark, paths[:-1])
    # Rows that surely have no company bypass the join, with their texts.
    shown = [c for c in names if c != "text" or "text" in keep]
    marked = common.with_likely(sketched.select(*shown, "n_shingles", "row_id", "signature"), company.withColumnRenamed("s", "signature"), "signature")
    likely, alone = marked.where("_likely").drop("_likely"), marked.where("NOT _likely")
    joined = likely.join(company.hint("merge"), F.col("signature") == F.col("s"), "left")
    grouped = joined.select(
        *shown,
        "n_shingles",
        F.when(F.col("head").isNull(), F.col("doc_id")).otherwise(F.col("head.doc_id")).alias("component_id"),
        F.coalesce(F.col("head.row_id") == F.col("row_id"), F.lit(True)).alias("kept_row"),
    )
    return grouped.union(alone.select(*shown, "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept_row")))


def _company(sketched: DataFrame, percent: int, width: int, node_limit: int, second_branch: int, depth: int) -> DataFrame:
    """(signature, head) of the classes that have several rows or links: the first row of the group."""
    # Four standard deviations of the estimate below the threshold.
    share = percent / 100
    least = int(TOKENS * (share - 4 * (share * (1 - share) / TOKENS) ** 0.5))
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_id")
    classes = common.materialize(
        sketched.where("n_shingles > 0").groupBy("signature").agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("rows")).withColumn("class_row", F.col("first.row_id")), "classes"
    )
    reps = sketched.select("row_id", "n_shingles", "roots", "sketch").join(classes.select(F.col("class_row").alias("row_id")).hint("merge"), "row_id")
    reps = common.materialize(reps, "representatives")

    links, rooted = None, None
    for trees in (range(FIRST_TREES), range(TREES)):
        labelled = reps.select("row_id", "roots", F.col("row_id").alias("label"))
        if rooted is not None:
            roots = reps.select("row_id", "roots").join(rooted.withColumnRenamed("node", "row_id").hint("merge"), "row_id", "left")
            labelled = common.materialize(roots.select("row_id", "roots", F.coalesce("root", "row_id").alias("label")), "labelled")
        members = common.materialize(_leaves(labelled, reps, trees, node_limit, second_branch, depth, rooted is None), "members")
        known = common.likely_in(reps.select("row_id", "n_shingles", "sketch"), members, "row_id")
        sketches = members.join(known.hint("merge"), "row_id").select("node", "row_id", "label", "n_shingles", "sketch")
        ready = sketches.repartition("node").sortWithinPartitions("node")
        clusters = common.materialize(ready.mapInArrow(_clusters(least, percent, rooted is None), "cluster long, row_id long, label long").distinct(), "clusters")
        marks = clusters.groupBy(F.col("cluster").alias("node")).agg(F.count(F.lit(1)).alias("n"), _member_mark().alias("mark"))
        wanted = common.materialize(clusters.join(_unlike(marks).select(F.col("node").alias("cluster")), "cluster"), "wanted")
        whole = common.likely_in(sketched.select("row_id", "sketch", "text"), wanted, "row_id")
        texts = wanted.join(whole.hint("merge"), "row_id").select("cluster", "row_id", "label", "sketch", "text")
        found = texts.repartition("cluster").sortWithinPartitions("cluster").mapInArrow(_links(width, least, percent), "a long, b long")
        found = common.materialize(found, "confirmed")
        links = found if links is None else links.union(found)
        rooted = components(links)

    # The first row of each component, for the classes that have company.
    linked = classes.join(rooted.hint("merge"), classes["class_row"] == rooted["node"])
    heads = linked.groupBy("root").agg(F.min("first").alias("head"))
    of_class = linked.select("signature", "root").join(heads, "root").select("signature", "head")
    copies = classes.where("rows > 1").join(of_class.select("signature"), "signature", "left_anti").select("signature", F.col("first").alias("head"))
    return of_class.union(copies)


def group_sql(percent: int, width: int = 5) -> str:
    """DuckDB SQL for doc_id, n_shingles, component_id and kept over ``documents``, by counting
    the shingles that any two documents share; for small tables."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '{common.WORD_PATTERN}') AS ws FROM documents),
        g AS (SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + {width - 1}), ' ') AS gram FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - {width - 2}, 2))) AS i FROM w WHERE len(ws) > 0)),
        s AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
        x AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common_n FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY ALL),
        e AS (SELECT a, b FROM x JOIN s p ON p.doc_id = a JOIN s q ON q.doc_id = b WHERE 100 * common_n >= {percent} * (p.n + q.n - common_n)),
        y AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
        c AS (SELECT doc_id AS a, doc_id AS root FROM documents UNION SELECT y.b, c.root FROM c JOIN y ON y.a = c.a),
        m AS (SELECT a, min(root) AS root FROM c GROUP BY a)
        SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, m.root AS component_id, d.doc_id IS NOT DISTINCT FROM m.root AS kept
        FROM documents d LEFT JOIN s ON s.doc_id = d.doc_id LEFT JOIN m ON m.a = d.doc_id"""
