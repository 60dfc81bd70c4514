"""Queries over sources, streams and structures, with DuckDB SQL for the same rows."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftwork.functions import proto
from weftwork.operators import aggregates, compare, lookup, structure, textindex
from weftwork.plans.schema import driver_catalogue
from weftwork.plans.selection import Selection, select
from weftwork.queries import _table, register
from weftwork.session import shared_folder
from weftwork.sources import pages
from weftwork.streaming import merge, parents


def _mounted(path: str) -> str:
    """The path as Python opens it."""
    return path.removeprefix("file://").removeprefix("file:")


@register("SELECT event_id, ts, user_id, event_type, value, props FROM events WHERE ts >= TIMESTAMP '2024-01-20 12:00:00'")
def read_pages_since(spark: SparkSession, d: str) -> DataFrame:
    """Events captured as pages in two fetches, then those since a cursor."""
    path = shared_folder(spark, "pages")
    events = _table(spark, d, "events")
    for number in (0, 1):
        pages.write_fetch(events.where(F.col("event_id") % 2 == number), path, number, "ts")
    return pages.read_since(spark, _mounted(path), events.schema, datetime(2024, 1, 20, 12), "ts")


_VERSIONS = "CASE WHEN o_orderkey % 8 = 0 THEN o_orderdate + INTERVAL 1 DAY ELSE o_orderdate - INTERVAL 1 DAY END"


@register(
    f"""
    WITH v AS (SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate FROM orders
               UNION ALL SELECT o_orderkey, o_custkey, o_totalprice * 2, {_VERSIONS} FROM orders WHERE o_orderkey % 4 = 0)
    SELECT * FROM v WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 3) QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY o_orderdate DESC) = 1
    """
)
def stream_waits_for_parents(spark: SparkSession, d: str) -> DataFrame:
    """Orders and customers arrive in shuffled order; orders wait for their customers, and the newest version stays."""
    root = shared_folder(spark, "waiting")
    orders = _table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    again = orders.where("o_orderkey % 4 = 0").withColumns({"o_totalprice": F.col("o_totalprice") * 2, "o_orderdate": F.expr(_VERSIONS).cast(orders.schema["o_orderdate"].dataType)})
    orders.unionByName(again).repartition(4, F.xxhash64("o_orderkey", "o_orderdate")).write.parquet(f"{root}/orders")
    customers = _table(spark, d, "customer").where("c_custkey % 10 <> 3").select("c_custkey")
    customers.repartition(3, F.xxhash64("c_custkey")).write.parquet(f"{root}/customers")
    stream = lambda name, df: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(f"{root}/{name}")
    passed = parents.waiting_children(stream("orders", orders), stream("customers", customers), "o_custkey", "o_orderkey", "c_custkey", "o_orderdate", shares=2)
    parents.merge_waiting(passed, f"{root}/table", f"{root}/orphans", f"{root}/checkpoint", "o_orderkey", "o_orderdate", buckets=16).awaitTermination()
    return merge.newest_version(spark, f"{root}/table", orders.schema)


#: Nested texts around the events' own JSON, in SQL that Spark and DuckDB read alike.
_NESTED = """concat('{"user":{"id":', user_id, ',"props":', props, '},"tags":["', event_type, '",', event_id % 3, ',null],"flag":', CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'null' END,
    CASE WHEN event_id % 5 = 0 THEN ',"extra":{"deep":[[1,2.5],{"x":{}}]}' ELSE '' END, '}')"""
_CHANGED = """concat('{"user":{"id":"', user_id, '","props":', props, ',"more":{"a":1}},"tags":[],"flag":false}')"""
_TREE = """SELECT {by}regexp_replace(fullkey, '\\[[0-9]+\\]', '[]', 'g') AS path,
    CASE type WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'bool' WHEN 'NULL' THEN 'null' ELSE 'number' END AS kind, count(*) AS n
    FROM (SELECT event_type, {json} AS j FROM events), json_tree(j) GROUP BY ALL"""


@register(_TREE.format(by="event_type, ", json=_NESTED))
def json_paths(spark: SparkSession, d: str) -> DataFrame:
    events = _table(spark, d, "events").select("event_type", F.expr(_NESTED).alias("j"))
    return structure.paths(events, "j", ("event_type",))


@register(
    f"""
    WITH a AS (SELECT path, list(kind) FILTER (kind <> 'null') AS kinds FROM ({_TREE.format(by="", json=_NESTED)}) GROUP BY path),
    b AS (SELECT path, list(kind) FILTER (kind <> 'null') AS kinds FROM ({_TREE.format(by="", json=_CHANGED)}) GROUP BY path),
    j AS (SELECT path, a.path IS NOT NULL AS in_a, b.path IS NOT NULL AS in_b, a.kinds AS ka, b.kinds AS kb FROM (SELECT path FROM a UNION SELECT path FROM b) LEFT JOIN a USING (path) LEFT JOIN b USING (path)),
    m AS (SELECT path, regexp_replace(path, '(\\[\\]|\\.[^.\\[\\]]*)$', '') AS above, CASE WHEN NOT in_b THEN 'missing_field' WHEN NOT in_a THEN 'extra_field'
          WHEN len(ka) > 0 AND len(kb) > 0 AND NOT list_has_any(ka, kb) THEN 'type_mismatch' END AS kind FROM j)
    SELECT path, kind FROM m WHERE kind IS NOT NULL AND above IN (SELECT path FROM j WHERE list_has_any(ka, kb)) AND (kind = 'type_mismatch' OR path NOT LIKE '%[]')
    """
)
def json_compare(spark: SparkSession, d: str) -> DataFrame:
    events = _table(spark, d, "events")
    sides = [structure.paths(events.select(F.expr(text).alias("j")), "j") for text in (_NESTED, _CHANGED)]
    return structure.compare_paths(*sides)


# Addresses, footers and comparisons.


@register(
    """
    SELECT event_id, n_nationkey, 4 AS family FROM events JOIN nation ON event_id % 2 = 0 AND event_id % 25 = n_nationkey AND event_id % 7 = n_nationkey % 7
    UNION ALL SELECT event_id, n_nationkey, 6 FROM events JOIN nation ON event_id % 2 = 1 AND event_id % 25 = n_nationkey AND event_id % 3 = 0
    UNION ALL SELECT event_id, n_nationkey, 0 FROM events JOIN nation ON event_id % 2 = 1 AND event_id % 25 = n_nationkey
    """
)
def ip_both_families(spark: SparkSession, d: str) -> DataFrame:
    """IPv4 and IPv6 addresses, in several spellings, against prefixes of several lengths."""
    e, n = F.col("event_id"), F.col("n_nationkey")
    text = lambda *parts: F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])
    digits = lambda c: F.lower(F.hex(c))
    four = text("10.", e % 25, ".", e % 7, ".", e % 251)
    long = text("2001:DB8:", digits(e % 25), ":", digits(e % 3), ":0:0:0:", digits(e % 251))
    short = text("2001:db8:", digits(e % 25), ":", digits(e % 3), "::", e % 251, ".0.0.1")
    addresses = _table(spark, d, "events").select("event_id", F.when(e % 2 == 0, four).when(e % 4 == 1, long).otherwise(short).alias("address"))
    prefixes = [(4, text("10.", n, ".", n % 7, ".0/24")), (6, text("2001:db8:", digits(n), "::/64")), (0, text("2001:db8:", digits(n), ":ffff::/48")), (9, text("10.", n, ".0.0/33"))]
    nations = _table(spark, d, "nation")
    listed = nations.select("n_nationkey", F.explode(F.array(*[F.struct(F.lit(k).alias("family"), p.alias("prefix")) for k, p in prefixes])).alias("p")).select("n_nationkey", "p.*")
    return lookup.addresses_in_prefixes(addresses, listed).select("event_id", "n_nationkey", "family")


@register("SELECT count(*) AS n, min(o_orderkey) AS min_o_orderkey, max(o_orderkey) AS max_o_orderkey, min(o_custkey) AS min_o_custkey, max(o_custkey) AS max_o_custkey FROM orders")
def agg_from_footers(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.from_footers(spark, f"{d}/orders.parquet", ["o_orderkey", "o_custkey"])


@register(
    """
    WITH a AS (SELECT l_partkey, l_quantity, l_extendedprice FROM lineitem WHERE l_suppkey % 3 = 0 QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey * 10 + l_linenumber DESC) = 1),
    b AS (SELECT l_partkey, l_quantity, l_extendedprice FROM lineitem WHERE l_suppkey % 2 = 0 QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey * 10 + l_linenumber) = 1)
    SELECT coalesce(a.l_partkey, b.l_partkey) AS l_partkey, a.l_quantity AS l_quantity_a, a.l_extendedprice AS l_extendedprice_a, b.l_quantity AS l_quantity_b, b.l_extendedprice AS l_extendedprice_b,
           a.l_partkey IS NOT NULL AND b.l_partkey IS NOT NULL AS shared
    FROM a FULL JOIN b ON a.l_partkey = b.l_partkey
    """
)
def compare_sides(spark: SparkSession, d: str) -> DataFrame:
    """Parts that two groups of suppliers have shipped, each with the last shipment of one and the first of the other."""
    lines = _table(spark, d, "lineitem").withColumn("at", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return compare.sides(lines, F.col("l_suppkey") % 3 == 0, F.col("l_suppkey") % 2 == 0, "l_partkey", "at", ["l_quantity", "l_extendedprice"], b_last=False)


# Nested selections.


@register(
    """
    WITH c AS (SELECT c_custkey, c_name, c_nationkey FROM customer WHERE c_acctbal >= 1000 ORDER BY c_acctbal DESC, c_custkey LIMIT 500),
    o AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS pos FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')),
    l AS (SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_orderkey) AS pos FROM lineitem WHERE l_quantity > 10),
    ls AS (SELECT l_orderkey, string_agg(l_linenumber || ':' || p_brand, ' ' ORDER BY pos) AS lns FROM l JOIN part ON l_partkey = p_partkey WHERE pos <= 2 GROUP BY 1),
    os AS (SELECT o_custkey, string_agg(o_orderkey || '(' || coalesce(lns, '') || ')', ', ' ORDER BY pos) AS listed FROM o LEFT JOIN ls ON l_orderkey = o_orderkey WHERE pos <= 3 GROUP BY 1)
    SELECT c_name, n_name || '/' || r_name AS place, coalesce(listed, '') AS listed
    FROM c LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey LEFT JOIN os ON o_custkey = c_custkey
    """
)
def nested_selection(spark: SparkSession, d: str) -> DataFrame:
    """Customers with their nation and its region, three orders each, of each two lines with their part."""
    lines = Selection(["l_linenumber"], {"l_quantity__gt": "10"}, ["-l_extendedprice", "l_linenumber"], 2, {"part": Selection(["p_brand"])})
    orders = Selection(["o_orderkey"], {"o_orderpriority__in": "1-URGENT,2-HIGH"}, ["-o_totalprice"], 3, {"lineitem": lines})
    nation = Selection(["n_name"], edges={"region": Selection(["r_name"])})
    asked = Selection(["c_name"], {"c_acctbal__gte": "1000"}, ["-c_acctbal"], 500, {"nation": nation, "orders": orders})
    rows = select(driver_catalogue(spark, d), "customer", asked)
    line = lambda x: F.concat(x["l_linenumber"].cast("string"), F.lit(":"), x["part"]["p_brand"])
    order = lambda o: F.concat(o["o_orderkey"].cast("string"), F.lit("("), F.array_join(F.transform(o["lineitem"], line), " "), F.lit(")"))
    place = F.concat(F.col("nation.n_name"), F.lit("/"), F.col("nation.region.r_name"))
    return rows.select("c_name", place.alias("place"), F.array_join(F.transform("orders", order), ", ").alias("listed"))


# Indexed search and wire rows.


@register("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), '77') OR contains(lower(p_type), '77') UNION ALL SELECT p_partkey, p_type FROM part WHERE contains(lower(p_name), 't#1') OR contains(lower(p_type), 't#1')")
def search_indexed(spark: SparkSession, d: str) -> DataFrame:
    """One text with trigrams, which reads the folders that may hold it, and one too short for any."""
    path = shared_folder(spark, "index")
    textindex.build(_table(spark, d, "part").select("p_partkey", "p_name", "p_type"), path, ["p_name", "p_type"], folders=32)
    short, long = (textindex.search(spark, path, ["p_name", "p_type"], text) for text in ("77", "T#1"))
    return short.select("p_partkey", "p_name").union(long.select("p_partkey", F.col("p_type").alias("p_name")))


def _varint_sql(x: str) -> str:
    n = f"CASE WHEN {x} < 128 THEN 1 WHEN {x} < 16384 THEN 2 WHEN {x} < 2097152 THEN 3 WHEN {x} < 268435456 THEN 4 ELSE 5 END"
    return f"array_to_string(list_transform(range(0, {n}), lambda i: printf('%02X', (({x} >> (7 * i)::BIGINT) & 127) + CASE WHEN i < {n} - 1 THEN 128 ELSE 0 END)), '')"


def _text_sql(tag: str, text: str) -> str:
    return f"CASE WHEN strlen({text}) > 0 THEN '{tag}' || {_varint_sql(f'strlen({text})')} || hex(encode({text})) ELSE '' END"


@register(
    f"""
    WITH c AS (SELECT *, c_nationkey::BIGINT AS nk, (c_custkey % 3)::BIGINT AS flag, CASE WHEN c_custkey % 4 = 0 THEN NULL WHEN c_custkey % 4 = 1 THEN '' ELSE c_mktsegment END AS seg FROM customer),
    m AS (SELECT c_custkey, CASE WHEN c_custkey <> 0 THEN '08' || {_varint_sql("c_custkey::BIGINT")} ELSE '' END || {_text_sql("12", "c_name")} || CASE WHEN flag <> 0 THEN '18' || {_varint_sql("flag")} ELSE '' END
        || {_text_sql("8201", "seg")} || '8A01' || {_varint_sql("(strlen(c_name) + 1 + strlen('é') + 3)::BIGINT")} || '0A' || {_varint_sql("strlen(c_name)")} || hex(encode(c_name)) || '0A' || '02' || hex(encode('é'))
        || '9001' || {_varint_sql("nk")} AS wire FROM c)
    SELECT c_custkey, wire FROM m
    """
)
def wire_rows(spark: SparkSession, d: str) -> DataFrame:
    """Customers as protobuf messages: numbers, texts, absent fields, a nested message of repeated texts, and one number whose 0 is kept."""
    key = F.col("c_custkey")
    segment = F.when(key % 4 == 0, F.lit(None)).when(key % 4 == 1, "").otherwise(F.col("c_mktsegment"))
    names = proto.message([proto.repeated_field(1, F.array(F.col("c_name"), F.lit("é")))])
    fields = [proto.number_field(1, key), proto.bytes_field(2, F.col("c_name")), proto.number_field(3, key % 3), proto.bytes_field(16, segment), proto.bytes_field(17, names), proto.number_field(18, F.col("c_nationkey"), keep_default=True)]
    return _table(spark, d, "customer").select("c_custkey", F.hex(proto.message(fields)).alias("wire"))
