"""Incremental merge: staging, update gate, key policies, versions, run log, streams."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Collection, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException, ParseException, PySparkException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftwork.functions.text import fold_column
from weftwork.operators import joins
from weftwork.plans import paging
from weftwork.plans.schema import NATIVE_DDL, NATIVE_FOLDED, NATIVE_KEYS, OPTIONAL_KEYS, Entity
from weftwork.sources.envelope import ARRIVAL

ZERO_TIME = "1900-01-01 00:00:00"
#: The column that a table's folders are dealt by: a hash of the key.
BUCKET = "store_bucket"


# Staging.


def last_wins(arrivals: DataFrame, key: str, order: Sequence[str | Column]) -> DataFrame:
    """Of the rows of a key, the one that arrived last."""
    by = [F.col(c).desc() if isinstance(c, str) else c for c in order]
    return arrivals.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*by))).where("_n = 1").drop("_n")


def newest_arrivals(rows: DataFrame, key: str = "id", updated: str = "updated") -> DataFrame:
    """One row of a key: the last arrival, or where arrivals aren't numbered, the newest update.

    Ties go by a hash of the whole row, so reruns agree.  Tasks reduce their own arrivals before rows are
    shuffled, so a key that arrives often is no hot one.
    """
    plain = [c for c in rows.columns if c != ARRIVAL]
    first = F.col(ARRIVAL) if ARRIVAL in rows.columns else F.col(updated)
    order = F.struct(first.alias("first"), F.xxhash64(*plain).alias("tie"))
    return rows.groupBy(F.col(key).alias("_key")).agg(F.max_by(F.struct(*plain), order).alias("_row")).select("_row.*")


def overlay(snapshot: DataFrame, window: DataFrame, key: str) -> DataFrame:
    """A full snapshot with a window of later changes, tombstones included, laid over it."""
    both = snapshot.withColumn(ARRIVAL, F.lit(0)).unionByName(window.withColumn(ARRIVAL, F.lit(1)))
    return last_wins(both, key, [ARRIVAL]).drop(ARRIVAL)


def drain(staged: DataFrame, after: int, n: int, key: str = "id") -> DataFrame:
    """A keyset chunk of staged rows."""
    return staged.where(F.col(key) > after).orderBy(key).limit(n)


def with_folds(df: DataFrame, entity: Entity) -> DataFrame:
    """Add the folded copies that searches compare with."""
    return df.withColumns({f"{c}_fold": fold_column(F.col(c)) for c in sorted(entity.folded)}) if entity.folded else df


def fold_names(name: str) -> list[str]:
    """The columns of a type that are stored with a folded copy."""
    return sorted(NATIVE_FOLDED.get(name, "").split())


# The merge.


def merge(target: DataFrame, source: DataFrame, key: str = "id", updated: str = "updated", full: bool = False) -> DataFrame:
    """The target after an upsert of the source.

    A row replaces the stored one only if its update is newer, or the stored one has no real update;
    a full merge replaces always.  So late rows are dropped, and a newer live row undoes a tombstone.
    One full outer join on the key; both sides are shuffled once.
    """
    old = target.select(F.col(key).alias("_old_key"), F.struct(*target.columns).alias("_old"))
    new = source.select(*target.columns).select(F.col(key).alias("_new_key"), F.struct(*target.columns).alias("_new"))
    joined = old.join(new, F.col("_old_key") == F.col("_new_key"), "full_outer")
    zero = F.lit(ZERO_TIME).cast(target.schema[updated].dataType)
    newer = F.col(f"_new.{updated}") > F.col(f"_old.{updated}")
    unset = F.col(f"_old.{updated}").isNull() | (F.col(f"_old.{updated}") <= zero)
    take = F.col("_old_key").isNull() | (F.col("_new_key").isNotNull() & (F.lit(full) | F.coalesce(newer, F.lit(False)) | unset))
    return joined.select(F.when(take, F.col("_new")).otherwise(F.col("_old")).alias("_row")).select("_row.*")


def changed_counts(target: DataFrame, source: DataFrame, key: str = "id", updated: str = "updated") -> DataFrame:
    """How many source rows are new, replace a stored one, or are skipped."""
    old = target.select(F.col(key).alias("_k"), F.col(updated).alias("_u"))
    zero = F.lit(ZERO_TIME).cast(target.schema[updated].dataType)
    kind = F.when(F.col("_k").isNull(), "new").when((F.col(updated) > F.col("_u")) | F.col("_u").isNull() | (F.col("_u") <= zero), "replaced").otherwise("skipped")
    return source.join(old, F.col(key) == F.col("_k"), "left").groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def required_keys(name: str) -> list[tuple[str, str]]:
    """(key, parent) of the keys without which a row is dropped."""
    return [(fk, parent) for child, fk, parent in NATIVE_KEYS if child == name and (child, fk) not in OPTIONAL_KEYS]


def optional_keys(name: str) -> list[tuple[str, str]]:
    """(key, parent) of the keys that become null where the parent is missing."""
    return [(fk, parent) for (child, fk), parent in OPTIONAL_KEYS.items() if child == name]


def marked_keys(name: str, source: DataFrame, parents: Mapping[str, DataFrame]) -> tuple[DataFrame, dict[tuple[str, str, str, str], Column]]:
    """The source with a mark ``_no_<key>`` for each key whose parent is missing, and what each kind of orphan is.

    The parents are best ``joins.bounded``, so that the driver holds no large ones.
    Key 0 and null are none: a null required key is stored as 0.  A row counts with its first missing required key
    only, and its optional keys count if the row stays.
    """
    kinds: dict[tuple[str, str, str, str], Column] = {}
    stays = F.lit(True)
    for action, keys in (("drop", required_keys(name)), ("null", optional_keys(name))):
        for fk, parent in keys:
            if action == "drop":
                source = source.withColumn(fk, F.coalesce(fk, F.lit(0)))
            ids = parents[parent].select(F.col("id").alias("_p"))
            source = source.join(ids, F.col(fk) == F.col("_p"), "left").withColumn(f"_no_{fk}", F.col("_p").isNull() & (F.coalesce(fk, F.lit(0)) != 0)).drop("_p")
            kinds[name, parent, fk, action] = stays & F.col(f"_no_{fk}")
            stays = stays & ~F.col(f"_no_{fk}") if action == "drop" else stays
    return source, kinds


def without_orphans(name: str, marked: DataFrame) -> DataFrame:
    """What stays of marked rows: those with all required parents, missing optional ones set to null."""
    for fk, _ in required_keys(name):
        marked = marked.where(~F.col(f"_no_{fk}"))
    for fk, _ in optional_keys(name):
        marked = marked.withColumn(fk, F.when(~F.col(f"_no_{fk}"), F.col(fk)))
    return marked.drop(*[f"_no_{fk}" for fk, _ in (*required_keys(name), *optional_keys(name))])


def check_keys(name: str, source: DataFrame, parents: Mapping[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(rows to merge, orphans): a required key without parent drops the row, an optional one
    becomes null.  Key 0 and null pass."""
    marked, kinds = marked_keys(name, source, {p: joins.bounded(parents[p].select("id")) for _, p in (*required_keys(name), *optional_keys(name))})
    described = [F.when(is_one, F.struct(*[F.lit(v).alias(k) for k, v in zip(("child", "parent", "field", "action"), kind)])) for kind, is_one in kinds.items()]
    if not described:
        return source, source.sparkSession.createDataFrame([], "child string, parent string, field string, action string")
    orphans = marked.select(F.explode(F.array_compact(F.array(*described))).alias("o")).select("o.*")
    return without_orphans(name, marked), orphans


def orphan_summary(orphans: DataFrame) -> DataFrame:
    return orphans.groupBy("child", "parent", "field", "action").agg(F.count(F.lit(1)).alias("n")).orderBy("child", "parent", "field", "action")


# A table dealt by key hash: a merge reads and rewrites the folders that its rows fall into.


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def read_keyed(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A table dealt by key hash; without rows where none was written."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], T.StructType([*schema.fields, T.StructField(BUCKET, T.IntegerType())]))
    return spark.read.schema(T.StructType([*schema.fields, T.StructField(BUCKET, T.IntegerType())])).parquet(path)


def merge_keyed(path: str, source: DataFrame, key: str, updated: str, buckets: int = 64, full: bool = False) -> list[int]:
    """Merge one row a key into the table at ``path`` and return the buckets that were rewritten.

    The scan is pruned to the touched folders, and dynamic partition overwrite replaces those alone, so what is read and
    written follows the increment.  A repeated merge writes the same rows again.  The number of buckets is
    fixed with the first merge.
    """
    spark, schema = source.sparkSession, source.schema
    source = source.withColumn(BUCKET, bucket_of(key, buckets)).persist()
    try:
        touched = sorted(r[BUCKET] for r in source.select(BUCKET).distinct().collect())
        if touched:
            old = read_keyed(spark, path, schema).where(F.col(BUCKET).isin(touched))
            merged = merge(old.drop(BUCKET), source.drop(BUCKET), key, updated, full).withColumn(BUCKET, bucket_of(key, buckets))
            merged.hint("rebalance", BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)
    finally:
        source.unpersist()
    return touched


# Versions: a cycle writes what it changes to a new folder; a pointer names the version in force.


@dataclass
class Store:
    """Versioned tables under a root; readers see a whole cycle or none of it.

    Tables are dealt by key hash.  A version's manifest names the folder of each type's buckets, so what a cycle
    leaves alone stays where it is.
    """

    spark: SparkSession
    root: str
    schemas: dict[str, T.StructType] = field(default_factory=dict)
    buckets: int = 16

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))

    def _names(self, folder: str) -> list[str]:
        fs, at = self._fs(), self._path(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []

    def current(self) -> str | None:
        """The version in force: the newest pointer file."""
        names = self._names("pointers")
        return names[-1].split(".", 1)[1] if names else None

    def places(self, version: str | None) -> dict[str, dict[str, str]]:
        """Type to its buckets' folders and the versions that wrote them; one small file."""
        if version is None:
            return {}
        return json.loads(self.spark.read.text(f"{self.root}/manifests/{version}", wholetext=True).first()["value"])

    def schema(self, name: str) -> T.StructType:
        """A type's columns and the folded copies that are stored with them."""
        plain = self.schemas.get(name) or T.StructType.fromDDL(NATIVE_DDL[name])
        return T.StructType([*plain.fields, *[T.StructField(f"{c}_fold", T.StringType()) for c in fold_names(name) if c in plain.names]])

    def rows(self, name: str, places: Mapping[str, str]) -> DataFrame:
        """The rows of some buckets of a type, by bucket and version."""
        if not places:
            return self.spark.createDataFrame([], self.schema(name))
        return self.spark.read.schema(self.schema(name)).parquet(*[f"{self.root}/versions/{v}/{name}/{b}" for b, v in sorted(places.items())])

    def read(self, name: str, version: str | None = None, folds: bool = False) -> DataFrame:
        """A type's rows in a version, the one in force if none is named; with their folded copies if asked."""
        rows = self.rows(name, self.places(version or self.current()).get(name, {}))
        return rows if folds else rows.drop(*[f"{c}_fold" for c in fold_names(name)])

    def begin(self) -> str:
        return f"{datetime.now(timezone.utc):%Y%m%dT%H%M%S%f}-{uuid.uuid4().hex[:8]}"

    def _dealt(self, df: DataFrame, path: str) -> list[str]:
        """Write rows by bucket and name the folders made; another try overwrites the first."""
        df.withColumn(BUCKET, bucket_of("id", self.buckets)).write.mode("overwrite").partitionBy(BUCKET).parquet(f"{self.root}/{path}")
        return [n for n in self._names(path) if n.startswith(BUCKET)]

    def write(self, version: str, name: str, df: DataFrame) -> dict[str, str]:
        """Write some buckets of a type for a version; their places."""
        return dict.fromkeys(self._dealt(df.select(*self.schema(name).names).withColumn(BUCKET, bucket_of("id", self.buckets)).hint("rebalance", BUCKET), f"versions/{version}/{name}"), version)

    def stage(self, version: str, name: str, df: DataFrame) -> DataFrame:
        """Write arrivals beside the versions, by bucket, and read them back, which cuts the lineage.

        They live for a cycle, so they aren't shuffled again for fewer files.
        """
        self._dealt(df, f"staging/{version}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/staging/{version}/{name}").select(*df.columns)

    def touched(self, version: str, *names: str) -> set[str]:
        """The buckets that staged rows fall into."""
        return {n for name in names for n in self._names(f"staging/{version}/{name}") if n.startswith(BUCKET)}

    def unstage(self, version: str) -> None:
        self._fs().delete(self._path("staging", version), True)

    def commit(self, version: str, written: Mapping[str, Mapping[str, str]]) -> str:
        """Write the manifest, then the pointer; a failure before the pointer changes nothing."""
        before = self.places(self.current())
        places = before | {name: before.get(name, {}) | dict(own) for name, own in written.items()}
        self.spark.createDataFrame([(json.dumps(places),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.root}/manifests/{version}")
        pointers = self._names("pointers")
        number = int(pointers[-1].split(".")[0]) + 1 if pointers else 0
        self._fs().create(self._path("pointers", f"{number:012d}.{version}"), False).close()
        return version

    def vacuum(self, keep: int = 2) -> None:
        """Delete tables that none of the last versions reads, and what failed cycles left."""
        fs, pointers = self._fs(), self._names("pointers")
        kept = [p.split(".", 1)[1] for p in pointers[-keep:]]
        used = {(place, name, bucket) for v in kept for name, places in self.places(v).items() for bucket, place in places.items()}
        for version in self._names("versions"):
            for name in self._names(f"versions/{version}"):
                buckets = [b for b in self._names(f"versions/{version}/{name}") if b.startswith(BUCKET)]
                unused = [b for b in buckets if (version, name, b) not in used]
                for bucket in unused:
                    fs.delete(self._path("versions", version, name, bucket), True)
                if len(unused) == len(buckets):
                    fs.delete(self._path("versions", version, name), True)
        for version in self._names("staging"):
            self.unstage(version)
        for pointer in pointers[:-keep]:
            fs.delete(self._path("pointers", pointer), False)
            fs.delete(self._path("manifests", pointer.split(".", 1)[1]), True)


@dataclass
class CycleResult:
    """What a cycle did.  Counts are taken as rows pass, so a task that ran twice after a loss may count twice; tables are exact."""

    version: str
    counts: dict[str, int]
    orphans: dict[tuple[str, str, str, str], int]
    backfilled: dict[str, int] = field(default_factory=dict)
    #: Types whose increment failed, and why.
    fallbacks: dict[str, str] = field(default_factory=dict)


Read = Callable[[datetime | None], DataFrame]
#: Types that are staged or merged at a time.
AT_ONCE = 6


def reading_failed(error: Exception) -> bool:
    """Whether an error is a source's: its files or service. Faults of a query are this library's, and no reason to read in full."""
    if isinstance(error, AnalysisException):
        return error.getCondition() == "PATH_NOT_FOUND"
    return isinstance(error, (PySparkException, Py4JJavaError, OSError)) and not isinstance(error, ParseException)


def stage_type(store: Store, version: str, name: str, read: Read, cursor: datetime | None, mode: str = "incremental", fallbacks: dict[str, str] | None = None) -> tuple[DataFrame, bool]:
    """(staged rows, whether they are an increment); ``read`` gives rows since a moment, or all live ones.

    An increment that can't be read falls back to a full read, which ``fallbacks`` records.  Rows since the cursor, tombstones
    among them, are laid over a full snapshot, as the next cursor lies after them; where they can't be read a full cycle fails, and a
    fallback goes without.
    """
    fell_back = False
    if mode == "incremental" and cursor is not None:
        try:
            return store.stage(version, name, newest_arrivals(read(cursor))), True
        except Exception as error:
            if not reading_failed(error):
                raise
            fell_back = True
            if fallbacks is not None:
                fallbacks[name] = f"{type(error).__name__}: {str(error).splitlines()[0] if str(error) else ''}"
    if cursor is not None:
        try:
            return store.stage(version, name, overlay(newest_arrivals(read(None)), newest_arrivals(read(cursor)), "id")), False
        except Exception as error:
            if not (fell_back and reading_failed(error)):
                raise
    return store.stage(version, name, newest_arrivals(read(None))), False


def backfill(
    store: Store, version: str, staged: Mapping[str, DataFrame], lookup: Callable[[str, DataFrame], DataFrame], most: int, until: datetime | None = None
) -> tuple[dict[str, DataFrame], dict[str, int]]:
    """Staged rows with the missing parents that a lookup finds, and how many each type got.

    Children come before parents here, so rows found for one type ask for their own parents in turn and each type
    is looked up once.  At most ``most`` keys are asked for in a cycle, smallest first, and none after ``until``.
    """
    out, found, left = dict(staged), {}, most
    for parent in reversed(list(NATIVE_DDL)):
        asked = [out[child].select(F.col(fk).alias("id")) for child, fk, p in NATIVE_KEYS if p == parent and child in out and (child, fk) not in OPTIONAL_KEYS]
        if not asked or left <= 0 or (until is not None and datetime.now(timezone.utc) >= until):
            continue
        wanted = asked[0]
        for more in asked[1:]:
            wanted = wanted.union(more)
        here = store.read(parent).select("id")
        if parent in staged:
            here = here.union(staged[parent].select("id"))
        keys = store.stage(version, f"{parent}.asked", joins.orphans(wanted.where("id > 0").distinct(), "id", joins.bounded(here)))
        n = keys.count()
        if n == 0:
            continue
        if n > left:
            # Numbered by ranges: a list of the first ``left`` keys need not fit in a task.
            keys = paging.numbered(keys, ["id"], "_at").where(F.col("_at") < left).drop("_at")
        n = min(n, left)
        left -= n
        rows = store.stage(version, f"{parent}.found", newest_arrivals(lookup(parent, keys).join(joins.bounded(keys, n), "id", "left_semi")))
        found[parent] = rows.count()
        out[parent] = out[parent].unionByName(rows) if parent in out else rows
    return out, found


def run_cycle(
    store: Store, staged: Mapping[str, DataFrame], full: bool = False, lookup: Callable[[str, DataFrame], DataFrame] | None = None, most: int = 10_000, until: datetime | None = None
) -> CycleResult:
    """Merge arrivals of all types, parents before children, and commit them as one version.

    Each merged table is written before its children look for their parents in it, and buckets without
    arrivals stay where they are.  ``lookup`` fetches missing parents by type and ids.
    """
    version = store.begin()
    rows = at_once(store.spark, list(staged), lambda name: store.stage(version, name, newest_arrivals(staged[name])))
    return _merge_staged(store, version, rows, {name: full for name in rows}, lookup, most, until)


def sync(
    store: Store, sources: Mapping[str, Read], mode: str = "incremental", lookup: Callable[[str, DataFrame], DataFrame] | None = None, most: int = 10_000, until: datetime | None = None
) -> CycleResult:
    """A whole cycle: read each type since its cursor, or in full, then merge and commit."""
    version, fallbacks = store.begin(), {}
    names = [n for n in NATIVE_DDL if n in sources]
    since = cursors({name: store.read(name) for name in names})
    staged = at_once(store.spark, names, lambda name: stage_type(store, version, name, sources[name], since[name], mode, fallbacks)[0])
    result = _merge_staged(store, version, staged, {name: mode == "full" for name in names}, lookup, most, until)
    result.fallbacks.update(fallbacks)
    return result


def at_once(spark: SparkSession, names: Sequence[str], do: Callable[[str], Any]) -> dict[str, Any]:
    """Run independent Spark jobs side by side; the first error is raised when all have ended."""
    with ThreadPoolExecutor(AT_ONCE) as pool:
        running = {name: pool.submit(inheritable_thread_target(spark)(do), name) for name in names}
    return {name: job.result() for name, job in running.items()}


def levels(names: Collection[str]) -> list[list[str]]:
    """Types in groups, each after the groups of all its parents."""
    depth: dict[str, int] = {}
    for name in NATIVE_DDL:
        parents = [p for _, p in (*required_keys(name), *optional_keys(name))]
        depth[name] = 1 + max((depth[p] for p in parents), default=-1)
    return [group for d in sorted(set(depth.values())) if (group := [n for n in NATIVE_DDL if depth[n] == d and n in names])]


def _merge_staged(store: Store, version: str, staged: Mapping[str, DataFrame], full: Mapping[str, bool], lookup, most: int, until: datetime | None) -> CycleResult:
    """One job a type: keys are checked, orphans counted and touched buckets merged as the rows pass once."""
    found: dict[str, int] = {}
    if lookup is not None:
        staged, found = backfill(store, version, staged, lookup, most, until)
    places = {name: dict(own) for name, own in store.places(store.current()).items()}
    written: dict[str, dict[str, str]] = {}
    ids: dict[str, DataFrame] = {}

    def merge_type(name: str) -> tuple[int, dict[tuple[str, str, str, str], int]]:
        touched, own = store.touched(version, name, f"{name}.found"), places.get(name, {})
        marked, kinds = marked_keys(name, staged[name], ids)
        if not touched:
            written[name] = {}
            return 0, {}
        stays = F.lit(True)
        for fk, _ in required_keys(name):
            stays = stays & ~F.col(f"_no_{fk}")
        counted = [F.count_if(stays).alias("rows"), *[F.count_if(is_one).alias(f"kind_{k}") for k, is_one in enumerate(kinds.values())]]
        seen = Observation()
        source = without_orphans(name, marked.observe(seen, *counted)).withColumns({f"{c}_fold": fold_column(F.col(c)) for c in fold_names(name)})
        written[name] = store.write(version, name, merge(store.rows(name, {b: v for b, v in own.items() if b in touched}), source, full=full.get(name, False)))
        try:
            n = seen.get
        except Py4JJavaError:
            # Where no row stays, Spark drops that part of the plan with what it observed.
            n = marked.agg(*counted).first().asDict()
        return n["rows"], {kind: n[f"kind_{k}"] for k, kind in enumerate(kinds) if n[f"kind_{k}"]}

    counts: dict[str, int] = {}
    lost: dict[tuple[str, str, str, str], int] = {}
    for group in levels(staged):
        parents = {p for name in group for _, p in (*required_keys(name), *optional_keys(name))} - set(ids)
        ids |= at_once(store.spark, sorted(parents), lambda p: joins.bounded(store.rows(p, places.get(p, {})).select("id")))
        for name, (rows, orphans) in at_once(store.spark, group, merge_type).items():
            counts[name] = rows
            lost |= orphans
            places[name] = places.get(name, {}) | written[name]
    store.commit(version, written)
    store.unstage(version)
    return CycleResult(version, counts, lost, found)


def cursors(tables: Mapping[str, DataFrame]) -> dict[str, datetime | None]:
    """The newest update of each type, in one job: where the next incremental read starts."""
    from weftwork.operators.aggregates import newest

    newest_of = [newest(df, "updated").select(F.lit(name).alias("name"), "newest") for name, df in tables.items()]
    if not newest_of:
        return {}
    every = newest_of[0]
    for more in newest_of[1:]:
        every = every.unionByName(more)
    return dict.fromkeys(tables) | {r["name"]: r["newest"] for r in every.collect()}


def effective_mode(asked: str, last_full: datetime | None, now: datetime, interval: timedelta) -> str:
    """Incremental runs become full ones when the last full one is too long ago."""
    if asked == "incremental" and (last_full is None or now - last_full >= interval):
        return "full"
    return asked


def retry_delays(attempts: int = 3, first: float = 30.0, factor: float = 4.0) -> list[float]:
    return [first * factor**n for n in range(attempts)]


# The run log.

RUNS = "id string, started timestamp, completed timestamp, status string, object_counts map<string,bigint>, error string"


def run_started(spark: SparkSession, path: str, now: datetime) -> str:
    run = uuid.uuid4().hex
    spark.createDataFrame([(run, now, None, "running", None, None)], RUNS).write.mode("append").parquet(path)
    return run


def run_completed(spark: SparkSession, path: str, run: str, started: datetime, now: datetime, status: str, counts: Mapping[str, int] | None = None, error: str | None = None) -> None:
    spark.createDataFrame([(run, started, now, status, dict(counts or {}), error)], RUNS).write.mode("append").parquet(path)


def run_states(spark: SparkSession, path: str, stale_before: datetime | None = None) -> DataFrame:
    """The last state of each run; running ones that began too long ago count as failed."""
    rows = spark.read.schema(T.StructType.fromDDL(RUNS)).parquet(path)
    last = last_wins(rows, "id", [F.col("completed").desc_nulls_last()])
    if stale_before is None:
        return last
    stale = (F.col("status") == "running") & (F.col("started") < F.lit(stale_before))
    return last.withColumn("status", F.when(stale, "failed").otherwise(F.col("status")))


def last_run(states: DataFrame, status: str | None = None) -> DataFrame:
    found = states if status is None else states.where(F.col("status") == status)
    return found.orderBy(F.col("started").desc()).limit(1)


# Streams.


def merge_stream(stream: DataFrame, path: str, checkpoint: str, key: str, updated: str, buckets: int = 64):
    """Merge a stream into a table dealt by key hash with ``foreachBatch``, and stop when it is drained.

    A batch rewrites the buckets of its keys; a replayed batch writes the same rows again.
    """

    def batch(df: DataFrame, number: int) -> None:
        merge_keyed(path, newest_arrivals(df, key, updated), key, updated, buckets)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newest_version(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table as the last batch left it."""
    return read_keyed(spark, path, schema).drop(BUCKET)


def scheduled(query: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, every: str):
    return query.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()

