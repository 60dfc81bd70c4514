"""The operators over the driver's tables, each with DuckDB SQL for the same rows."""

from __future__ import annotations

import inspect
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftwork.functions import format as fmt
from weftwork.functions import net, text
from weftwork.operators import aggregates, compare, diff, joins, lookup, search
from weftwork.plans import cost, paging, query, typed
from weftwork.plans.filters import compile_filters, hop
from weftwork.plans.schema import Catalogue, driver_catalogue
from weftwork.session import shared_folder, ship_package
from weftwork.streaming import merge

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def register(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = inspect.cleandoc(sql)
        return f

    return add


def _filtered(spark: SparkSession, d: str, name: str, params: dict[str, str], *more: str) -> DataFrame:
    catalogue = driver_catalogue(spark, d, name, *more)
    return compile_filters(catalogue, name, params).apply(catalogue.tables[name])


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{d}/{name}.parquet")


# Filters.


@register("SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE lower(c_mktsegment) = 'building'")
def filter_exact_fold(spark: SparkSession, d: str) -> DataFrame:
    return _filtered(spark, d, "customer", {"c_mktsegment": "bUILDing"}).select("c_custkey", "c_name", "c_mktsegment")


@register("SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey = 7")
def filter_exact_int(spark: SparkSession, d: str) -> DataFrame:
    return _filtered(spark, d, "customer", {"c_nationkey": "7"}).select("c_custkey", "c_nationkey")


@register("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'widget')")
def filter_contains(spark: SparkSession, d: str) -> DataFrame:
    return _filtered(spark, d, "part", {"p_name__contains": "WIDGET"}).select("p_partkey", "p_name")


@register("SELECT p_partkey, p_type FROM part WHERE starts_with(lower(p_type), 'eco')")
def filter_startswith(spark: SparkSession, d: str) -> DataFrame:
    return _filtered(spark, d, "part", {"p_type__istartswith": "Eco"}).select("p_partkey", "p_type")


@register("SELECT n_nationkey, n_name FROM nation WHERE lower(n_name) IN ('nation_1', 'nation_3', 'nation_20')")
def filter_in_str(spark: SparkSession, d: str) -> DataFrame:
    return _filtered(spark, d, "nation", {"n_name__in": "NATION_1, nation_3,Nation_20"}).select("n_nationkey", "n_name")


@register("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (1, 5, 77, 4000, 999999999)")
def filter_in_int(spark: SparkSession, d: str) -> DataFrame:
    return _filtered(spark, d, "orders", {"o_orderkey__in": "1,5, 77,4000,999999999"}).select("o_orderkey", "o_totalprice")


@register("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey < 60000")
def filter_in_long_list(spark: SparkSession, d: str) -> DataFrame:
    values = ",".join(str(n) for n in range(0, 60000, 3))
    return _filtered(spark, d, "orders", {"o_orderkey__in": values}).select("o_orderkey", "o_custkey")


@register("SELECT o_orderkey FROM orders WHERE false")
def filter_in_empty(spark: SparkSession, d: str) -> DataFrame:
    return _filtered(spark, d, "orders", {"o_orderkey__in": ""}).select("o_orderkey")


@register("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal >= 5000 AND c_acctbal < 7500.5")
def filter_cmp_num(spark: SparkSession, d: str) -> DataFrame:
    return _filtered(spark, d, "customer", {"c_acctbal__gte": "5000", "c_acctbal__lt": "7500.5"}).select("c_custkey", "c_acctbal")


@register("SELECT s_suppkey, s_name FROM supplier WHERE s_name > 'Supplier#000000050'")
def filter_cmp_str(spark: SparkSession, d: str) -> DataFrame:
    return _filtered(spark, d, "supplier", {"s_name__gt": "Supplier#000000050"}).select("s_suppkey", "s_name")


@register("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1997-05-28' AND o_orderdate < TIMESTAMP '1997-05-29'")
def filter_date_day_window(spark: SparkSession, d: str) -> DataFrame:
    return _filtered(spark, d, "orders", {"o_orderdate": "1997-05-28"}).select("o_orderkey", "o_orderdate")


@register("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate > TIMESTAMP '2001-06-30 23:59:59.999'")
def filter_date_gt_endofday(spark: SparkSession, d: str) -> DataFrame:
    return _filtered(spark, d, "orders", {"o_orderdate__gt": "2001-06-30"}).select("o_orderkey", "o_orderdate")


@register("SELECT event_id, ts FROM events WHERE ts <= TIMESTAMP '2024-01-02 23:59:59.999' AND ts >= TIMESTAMP '2024-01-02'")
def filter_date_lte_endofday(spark: SparkSession, d: str) -> DataFrame:
    return _filtered(spark, d, "events", {"ts__lte": "2024-01-02", "ts__gte": "2024-01-02"}).select("event_id", "ts")


@register("SELECT p_partkey, p_size FROM part WHERE p_size = 11")
def filter_unknown_ignored(spark: SparkSession, d: str) -> DataFrame:
    return _filtered(spark, d, "part", {"p_size": "11", "p_nothing": "x", "a__b__c__d": "1"}).select("p_partkey", "p_size")


@register(
    """
    SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'F'
    ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50
    """
)
def filter_status_list(spark: SparkSession, d: str) -> DataFrame:
    return query.list_rows(driver_catalogue(spark, d, "orders"), "orders", {"limit": "50"}).select("o_orderkey", "o_orderdate")


@register(
    """
    SELECT o_orderkey, o_orderdate, CASE o_orderstatus WHEN 'F' THEN 'ok' ELSE 'deleted' END AS status
    FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_orderdate > TIMESTAMP '2001-01-01'
    ORDER BY o_orderdate, o_orderkey LIMIT 40 OFFSET 10
    """
)
def filter_status_since(spark: SparkSession, d: str) -> DataFrame:
    # 978307200 is 2001-01-01 in epoch seconds.
    return query.list_rows(driver_catalogue(spark, d, "orders"), "orders", {"since": "978307200", "limit": "40", "skip": "10"}).select("o_orderkey", "o_orderdate", "status")


@register("SELECT p_partkey, p_brand, p_size FROM part WHERE (p_size > 40 OR p_brand = 'Brand#2') AND NOT (p_type = 'ECONOMY') AND (p_name LIKE '%ring' OR p_retailprice < 950)")
def filter_or_tree(spark: SparkSession, d: str) -> DataFrame:
    catalogue = driver_catalogue(spark, d, "part")
    tree = {"or": [{"p_sizeGT": 40}, {"p_brand": "Brand#2"}], "not": {"p_type": "ECONOMY"}, "and": [{"or": [{"p_nameHasSuffix": "ring"}, {"p_retailpriceLT": 950.0}]}]}
    return catalogue.tables["part"].where(typed.condition(catalogue.entities["part"], tree)).select("p_partkey", "p_brand", "p_size")


@register("SELECT p_partkey, p_brand FROM part WHERE p_brand NOT IN ('Brand#1', 'Brand#2', 'Brand#3')")
def filter_not_in(spark: SparkSession, d: str) -> DataFrame:
    catalogue = driver_catalogue(spark, d, "part")
    return catalogue.tables["part"].where(typed.condition(catalogue.entities["part"], {"p_brandNotIn": ["Brand#1", "Brand#2", "Brand#3"]})).select("p_partkey", "p_brand")


@register("SELECT p_partkey, p_type, p_size FROM part WHERE contains(lower(p_type), 'econ') AND p_size = 7")
def filter_typed(spark: SparkSession, d: str) -> DataFrame:
    return typed.typed_list(_table(spark, d, "part"), "p_partkey+ p_type~ p_brand p_size", {"p_type": "ECON", "p_size": 7}).select("p_partkey", "p_type", "p_size")


@register("SELECT c_custkey, c_mktsegment, c_acctbal FROM customer WHERE c_mktsegment = 'FURNITURE' OR c_acctbal <= 0 OR starts_with(c_name, 'Customer#00000001')")
def filter_rest_or(spark: SparkSession, d: str) -> DataFrame:
    catalogue = driver_catalogue(spark, d, "customer")
    made = typed.rest_predicate(catalogue.entities["customer"], {"c_mktsegment.eq": "FURNITURE", "c_acctbal.lte": 0.0, "c_name.prefix": "Customer#00000001"}, "or")
    return catalogue.tables["customer"].where(made).select("c_custkey", "c_mktsegment", "c_acctbal")


@register("SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name), 'mach') OR contains(lower(c_mktsegment), 'mach')")
def search_or(spark: SparkSession, d: str) -> DataFrame:
    return query.matching(driver_catalogue(spark, d, "customer"), "customer", {"q": " Mach "})[0].select("c_custkey", "c_name")


@register("SELECT s_suppkey, s_name FROM supplier WHERE contains(lower(s_name), 'as42') OR s_suppkey = 42")
def search_numeric_or(spark: SparkSession, d: str) -> DataFrame:
    return query.matching(driver_catalogue(spark, d, "supplier"), "supplier", {"q": "AS42"})[0].select("s_suppkey", "s_name")


_FOLD_SQL = "text"
for _a, _b in text.LIGATURES.items():
    _FOLD_SQL = f"replace({_FOLD_SQL}, '{_a}', '{_b}')"


@register(f"SELECT doc_id, lower(strip_accents({_FOLD_SQL})) AS folded FROM documents")
def fold_text(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "documents").select("doc_id", text.fold_column("text").alias("folded"))


@register(f"SELECT doc_id, lang FROM documents WHERE contains(lower(strip_accents({_FOLD_SQL})), 'cion')")
def fold_contains(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "documents").where(F.contains(text.fold_latin(F.col("text")), F.lit(text.fold("CIÓN")))).select("doc_id", "lang")


# Traversal.


@register("SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE lower(n_name) = 'nation_4')")
def trav_1hop_m2o(spark: SparkSession, d: str) -> DataFrame:
    return _filtered(spark, d, "customer", {"nation__n_name": "nation_4"}, "nation").select("c_custkey", "c_nationkey")


@register("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9900)")
def trav_1hop_o2m(spark: SparkSession, d: str) -> DataFrame:
    return _filtered(spark, d, "nation", {"customer__c_acctbal__gt": "9900"}, "customer").select("n_nationkey", "n_name")


@register("SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE contains(lower(r_name), 'asia')))")
def trav_2hop_m2o_m2o(spark: SparkSession, d: str) -> DataFrame:
    return _filtered(spark, d, "customer", {"nation__region__r_name__contains": "ASIA"}, "nation", "region").select("c_custkey")


@register("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 50))")
def trav_2hop_o2m_o2m(spark: SparkSession, d: str) -> DataFrame:
    return _filtered(spark, d, "customer", {"orders__lineitem__l_quantity__gte": "50"}, "orders", "lineitem").select("c_custkey")


@register("SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9950))")
def trav_2hop_m2o_o2m(spark: SparkSession, d: str) -> DataFrame:
    return _filtered(spark, d, "supplier", {"nation__customer__c_acctbal__gt": "9950"}, "nation", "customer").select("s_suppkey")


@register("SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 500))")
def trav_2hop_o2m_m2o(spark: SparkSession, d: str) -> DataFrame:
    return _filtered(spark, d, "part", {"lineitem__supplier__s_acctbal__lt": "500"}, "lineitem", "supplier").select("p_partkey")


@register("SELECT n_nationkey FROM nation")
def trav_unknown_ignored(spark: SparkSession, d: str) -> DataFrame:
    return _filtered(spark, d, "nation", {"part__p_name": "x", "customer__nothing": "1"}, "customer").select("n_nationkey")


@register(
    """
    SELECT n_nationkey, CASE WHEN n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 9000) THEN 1 ELSE 0 END AS shown
    FROM nation
    """
)
def visibility_gate_semi(spark: SparkSession, d: str) -> DataFrame:
    catalogue = driver_catalogue(spark, d, "nation", "customer")
    gated = catalogue.tables["customer"].where((F.col("c_mktsegment") == "BUILDING") & (F.col("c_acctbal") > 9000))
    seen = hop(catalogue.tables["nation"], catalogue.entities["nation"], "customer", catalogue.entities["customer"], gated).select(F.col("n_nationkey").alias("k"))
    return catalogue.tables["nation"].join(seen, F.col("n_nationkey") == F.col("k"), "left").select("n_nationkey", F.when(F.col("k").isNotNull(), 1).otherwise(0).alias("shown"))


@register("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 480000)")
def related_exists(spark: SparkSession, d: str) -> DataFrame:
    return typed.related(driver_catalogue(spark, d, "customer", "orders"), "customer", "orders", {"o_totalpriceGT": 480000.0}).select("c_custkey")


# Joins.


@register("SELECT o_orderkey, c_name, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0")
def join_parent_left(spark: SparkSession, d: str) -> DataFrame:
    parents = _table(spark, d, "customer").where("c_acctbal > 0")
    df = joins.with_parent(_table(spark, d, "orders"), "o_custkey", parents, "c_custkey", "customer", ["c_name", "c_mktsegment"])
    return df.select("o_orderkey", "customer.c_name", "customer.c_mktsegment")


@register("SELECT l_suppkey, p_partkey, p_name FROM lineitem JOIN part ON l_partkey = p_partkey")
def join_through(spark: SparkSession, d: str) -> DataFrame:
    reached = joins.through(_table(spark, d, "lineitem"), "l_suppkey", "l_partkey", "l_orderkey", _table(spark, d, "part"), "p_partkey")
    return reached.select(F.col("_fk").alias("l_suppkey"), "p_partkey", "p_name")


@register("SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment <> 'FURNITURE')")
def join_anti_orphans(spark: SparkSession, d: str) -> DataFrame:
    return joins.orphans(_table(spark, d, "orders"), "o_custkey", _table(spark, d, "customer").where("c_mktsegment <> 'FURNITURE'"), "c_custkey").select("o_orderkey", "o_custkey")


@register("SELECT o_orderkey, CASE WHEN EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 0) THEN o_custkey END AS o_custkey FROM orders")
def fk_null_on_miss(spark: SparkSession, d: str) -> DataFrame:
    return joins.null_on_miss(_table(spark, d, "orders"), "o_custkey", _table(spark, d, "customer").where("c_acctbal > 0"), "c_custkey").select("o_orderkey", "o_custkey")


@register("SELECT DISTINCT o_custkey AS c_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def missing_parents(spark: SparkSession, d: str) -> DataFrame:
    return joins.missing_parents(_table(spark, d, "orders"), "o_custkey", _table(spark, d, "customer").where("c_acctbal > 0"), "c_custkey")


@register("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)")
def fetch_by_ids(spark: SparkSession, d: str) -> DataFrame:
    ids = _table(spark, d, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("o_custkey"))
    return joins.fetch_by_ids(_table(spark, d, "orders"), ids, "o_custkey").select("o_orderkey", "o_custkey")


# Nested results, flattened to compare.


def _listed(column: str) -> Column:
    return F.array_join(F.transform(column, lambda x: x.cast("string")), ",")


@register("SELECT n_nationkey, coalesce((SELECT string_agg(c_custkey::VARCHAR, ',' ORDER BY c_custkey) FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > 9000), '') AS ids FROM nation")
def set_ids_sorted(spark: SparkSession, d: str) -> DataFrame:
    sets = joins.child_ids(_table(spark, d, "customer").where("c_acctbal > 9000"), "c_nationkey", "c_custkey")
    return joins.with_set(_table(spark, d, "nation"), "n_nationkey", sets, "ids").select("n_nationkey", _listed("ids").alias("ids"))


@register(
    """
    SELECT r_regionkey, r_name, count(n_nationkey) AS n, coalesce(string_agg(n_nationkey::VARCHAR || ':' || n_name, ';' ORDER BY n_nationkey), '') AS nations
    FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY ALL
    """
)
def nest_depth2(spark: SparkSession, d: str) -> DataFrame:
    sets = joins.child_objects(_table(spark, d, "nation"), "n_regionkey", "n_nationkey", ("n_regionkey",))
    nested = joins.with_set(_table(spark, d, "region"), "r_regionkey", sets, "nation_set")
    shown = F.transform("nation_set", lambda x: F.concat_ws(":", x["n_nationkey"], x["n_name"]))
    return nested.select("r_regionkey", "r_name", F.size("nation_set").cast("bigint").alias("n"), F.array_join(shown, ";").alias("nations"))


@register("SELECT l_suppkey, string_agg(l_partkey::VARCHAR, ',' ORDER BY l_orderkey, l_partkey) AS parts FROM lineitem GROUP BY 1")
def nest_through_ids(spark: SparkSession, d: str) -> DataFrame:
    found = joins.through_ids(_table(spark, d, "lineitem"), "l_suppkey", "l_partkey", "l_orderkey")
    return found.select(F.col("_fk").alias("l_suppkey"), _listed("items").alias("parts"))


# Aggregations.


@register("SELECT l_suppkey, round(sum(l_quantity), 2) AS total FROM lineitem GROUP BY 1")
def agg_sum_bandwidth(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.sum_by(_table(spark, d, "lineitem"), "l_suppkey", "l_quantity", "total").withColumn("total", F.round("total", 2))


@register(
    """
    SELECT n_nationkey, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS customers, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS suppliers
    FROM nation
    """
)
def agg_child_counts(spark: SparkSession, d: str) -> DataFrame:
    children = {"customers": (_table(spark, d, "customer"), "c_nationkey"), "suppliers": (_table(spark, d, "supplier"), "s_nationkey")}
    return aggregates.child_counts(_table(spark, d, "nation"), "n_nationkey", children).select("n_nationkey", "customers", "suppliers")


_COUNTED = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


@register(" UNION ALL ".join(f"SELECT '{t}' AS type, count(*) AS n FROM {t}" for t in _COUNTED))
def agg_union_counts(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.table_counts({t: _table(spark, d, t) for t in _COUNTED})


@register("SELECT event_type, max(ts) AS newest FROM events GROUP BY 1")
def agg_max_cursor(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.newest(_table(spark, d, "events"), "ts", ["event_type"])


@register("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) GROUP BY 1, 2")
def agg_orphan_groups(spark: SparkSession, d: str) -> DataFrame:
    lost = joins.orphans(_table(spark, d, "lineitem"), "l_suppkey", _table(spark, d, "supplier").where("s_acctbal > 0"), "s_suppkey")
    return aggregates.orphan_groups(lost, ["l_returnflag", "l_linestatus"])


@register("SELECT string_agg(DISTINCT o_orderpriority, '|' ORDER BY o_orderpriority) AS value_list FROM orders")
def agg_distinct_set(spark: SparkSession, d: str) -> DataFrame:
    return diff.value_set(_table(spark, d, "orders"), "o_orderpriority").select(F.array_join("values", "|").alias("value_list"))


@register("SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 FROM events GROUP BY 1")
def agg_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.percentiles(_table(spark, d, "events"), "value", ["event_type"])


@register(
    """
    SELECT CASE WHEN grouping(event_type) = 1 THEN 'TOTAL' ELSE event_type END AS event_type, count(*) AS n,
           sum(CASE WHEN value > 100 THEN 1 ELSE 0 END)::BIGINT AS errors, round(avg(value), 4) AS mean
    FROM events GROUP BY ROLLUP (event_type)
    """
)
def agg_rollup_surface(spark: SparkSession, d: str) -> DataFrame:
    measures = [F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("value") > 100, 1).otherwise(0)).alias("errors"), F.round(F.avg("value"), 4).alias("mean")]
    return aggregates.rollup(_table(spark, d, "events"), "event_type", measures)


@register("SELECT count(*) FILTER (value > 100) * 1.0::DOUBLE / count(*) AS error_rate, round(count(*) / (date_diff('microsecond', min(ts), max(ts)) / 1e6), 9) AS per_second FROM events")
def agg_step_summary(spark: SparkSession, d: str) -> DataFrame:
    seconds = F.timestamp_diff("MICROSECOND", F.min("ts"), F.max("ts")) / F.lit(1e6)
    return _table(spark, d, "events").agg((F.count_if(F.col("value") > 100) * F.lit(1.0) / F.count(F.lit(1))).alias("error_rate"), F.round(F.count(F.lit(1)) / seconds, 9).alias("per_second"))


@register("SELECT greatest(count(*) - 20, 0)::BIGINT AS served FROM orders WHERE o_totalprice > 499000")
def agg_served_count(spark: SparkSession, d: str) -> DataFrame:
    catalogue = driver_catalogue(spark, d, "orders")
    rows, options, _ = query.matching(catalogue, "orders", {"o_totalprice__gt": "499000", "skip": "20"}, with_status=False)
    return rows.agg(F.greatest(F.count(F.lit(1)) - options.skip, F.lit(0)).cast("bigint").alias("served"))


# Pages and order.


@register("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50")
def page_offset(spark: SparkSession, d: str) -> DataFrame:
    return query.paged(_table(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey"), 25, 50).select("o_orderkey", "o_totalprice")


@register("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 101 OFFSET 100")
def page_n_plus_one(spark: SparkSession, d: str) -> DataFrame:
    token = paging.encode_token(100)
    ordered = _table(spark, d, "orders").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    return paging.offset_page(ordered, paging.page_size(0), paging.decode_token(token)).select("o_orderkey", "o_orderdate")


@register(
    """
    SELECT event_id, ts FROM events
    WHERE ts < TIMESTAMP '2024-01-20 12:00:00' OR (ts = TIMESTAMP '2024-01-20 12:00:00' AND event_id < 5000)
    ORDER BY ts DESC, event_id DESC LIMIT 500
    """
)
def page_keyset(spark: SparkSession, d: str) -> DataFrame:
    keys = [("ts", True), ("event_id", True)]
    after = paging.keyset_after(keys, [F.lit("2024-01-20 12:00:00").cast("timestamp_ntz"), 5000])
    return _table(spark, d, "events").where(after).orderBy(*paging.keyset_order(keys)).limit(500).select("event_id", "ts")


@register("SELECT n_nationkey, n_name FROM nation ORDER BY n_name DESC, n_nationkey DESC LIMIT 6")
def page_relay_last(spark: SparkSession, d: str) -> DataFrame:
    return paging.relay_page(_table(spark, d, "nation"), [("n_name", False), ("n_nationkey", False)], last=5).select("n_nationkey", "n_name")


@register("SELECT n_nationkey, n_name FROM nation WHERE n_name > 'NATION_15' OR (n_name = 'NATION_15' AND n_nationkey > 15) ORDER BY n_name, n_nationkey LIMIT 5")
def page_relay_after(spark: SparkSession, d: str) -> DataFrame:
    return paging.relay_page(_table(spark, d, "nation"), [("n_name", False), ("n_nationkey", False)], first=4, after=["NATION_15", 15]).select("n_nationkey", "n_name")


@register("SELECT count(*) AS total, ceil(count(*) / 100.0)::BIGINT AS last_page FROM orders")
def page_rest_meta(spark: SparkSession, d: str) -> DataFrame:
    n = F.count(F.lit(1))
    return _table(spark, d, "orders").agg(n.alias("total"), F.greatest(F.lit(1), F.ceil(n / 100)).cast("bigint").alias("last_page"))


@register("SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey ORDER BY n_name, c_custkey LIMIT 30")
def sort_parent_field(spark: SparkSession, d: str) -> DataFrame:
    df = joins.with_parent(_table(spark, d, "customer"), "c_nationkey", _table(spark, d, "nation"), "n_nationkey", "nation")
    return df.orderBy("nation.n_name", "c_custkey").limit(30).select("c_custkey", "nation.n_name")


@register("SELECT n_nationkey, count(c_custkey) AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1 ORDER BY n DESC, n_nationkey LIMIT 10")
def sort_edge_count(spark: SparkSession, d: str) -> DataFrame:
    counted = aggregates.child_counts(_table(spark, d, "nation"), "n_nationkey", {"n": (_table(spark, d, "customer"), "c_nationkey")})
    return counted.orderBy(F.desc("n"), "n_nationkey").limit(10).select("n_nationkey", "n")


@register()
def sort_random(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "nation").orderBy(F.rand()).limit(10).select("n_nationkey")


@register("SELECT o_custkey, o_orderkey, n FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n <= 3")
def top_per_parent(spark: SparkSession, d: str) -> DataFrame:
    top = joins.top_per_group(_table(spark, d, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], 3, "n")
    return top.select("o_custkey", "o_orderkey", F.col("n").cast("bigint").alias("n"))


@register("SELECT event_id, ((row_number() OVER (ORDER BY ts, event_id)) - 1) // 500 AS batch FROM events")
def page_stream_batches(spark: SparkSession, d: str) -> DataFrame:
    return paging.batches(_table(spark, d, "events"), ["ts", "event_id"], 500).select("event_id", "batch")


# Search and comparison.

_SEARCHED = {"customer": ("c_custkey", "c_name", "c_mktsegment"), "supplier": ("s_suppkey", "s_name"), "part": ("p_partkey", "p_name", "p_brand", "p_type"), "nation": ("n_nationkey", "n_name")}


def _search_sql(q: str) -> str:
    parts = []
    for t, (key, *cols) in _SEARCHED.items():
        cond = " OR ".join([*(f"contains(lower({c}), '{q}')" for c in cols), f"{key} = {int(q)}"])
        parts.append(
            f"SELECT '{t}' AS type, {key}::BIGINT AS id, {cols[0]} AS name, count(*) OVER () AS total, row_number() OVER (ORDER BY {cols[0]}, {key}) AS rank FROM {t} WHERE {cond} QUALIFY rank <= 10"
        )
    return " UNION ALL ".join(parts)


@register(_search_sql("01"))
def search_grouped_top10(spark: SparkSession, d: str) -> DataFrame:
    found = search.grouped(driver_catalogue(spark, d, *_SEARCHED), list(_SEARCHED), "01")
    return found.select("type", "id", "name", "total", F.col("rank").cast("bigint").alias("rank"))


@register("SELECT p_partkey AS id, p_name AS name FROM part WHERE contains(lower(p_name), 'ring') OR contains(lower(p_brand), 'ring') OR contains(lower(p_type), 'ring') ORDER BY 2, 1 LIMIT 50 OFFSET 50")
def search_page(spark: SparkSession, d: str) -> DataFrame:
    return search.page(driver_catalogue(spark, d, "part"), "part", "ring", offset=50)[0].select("id", "name")


def _parts_of(spark: SparkSession, d: str, supplier: int) -> DataFrame:
    rows = _table(spark, d, "lineitem").where(F.col("l_suppkey") == supplier)
    return rows.withColumn("seq", F.col("l_orderkey") * 10 + F.col("l_linenumber"))


_SIDES = """
    WITH r AS (SELECT *, l_orderkey * 10 + l_linenumber AS seq FROM lineitem),
    a AS (SELECT l_partkey, seq, l_quantity FROM r WHERE l_suppkey = 3 QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY seq DESC) = 1),
    b AS (SELECT l_partkey, seq, l_quantity FROM r WHERE l_suppkey = 4 QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY seq {order}) = 1)
"""


@register(_SIDES.format(order="ASC") + "SELECT a.l_partkey, a.seq AS seq_a, b.seq AS seq_b FROM a JOIN b ON a.l_partkey = b.l_partkey")
def compare_shared(spark: SparkSession, d: str) -> DataFrame:
    return compare.shared(_parts_of(spark, d, 3), _parts_of(spark, d, 4), "l_partkey", "seq", ["seq"]).select("l_partkey", "seq_a", "seq_b")


@register(
    _SIDES.format(order="DESC")
    + "SELECT coalesce(a.l_partkey, b.l_partkey) AS l_partkey, a.seq AS seq_a, b.seq AS seq_b, a.l_partkey IS NOT NULL AND b.l_partkey IS NOT NULL AS shared FROM a FULL JOIN b ON a.l_partkey = b.l_partkey"
)
def compare_full(spark: SparkSession, d: str) -> DataFrame:
    return compare.everything(_parts_of(spark, d, 3), _parts_of(spark, d, 4), "l_partkey", "seq", ["seq"]).select("l_partkey", "seq_a", "seq_b", "shared")


@register(
    """
    WITH r AS (SELECT DISTINCT l_suppkey, p_brand, p_partkey FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_suppkey IN (3, 4))
    SELECT p_brand, coalesce(string_agg(p_partkey::VARCHAR, ',' ORDER BY p_partkey) FILTER (n = 2), '') AS members
    FROM (SELECT p_brand, p_partkey, count(*) AS n FROM r GROUP BY 1, 2)
    WHERE p_brand IN (SELECT p_brand FROM r WHERE l_suppkey = 3) AND p_brand IN (SELECT p_brand FROM r WHERE l_suppkey = 4) GROUP BY 1
    """
)
def compare_group_intersect(spark: SparkSession, d: str) -> DataFrame:
    parts = _table(spark, d, "part")
    side = lambda s: _parts_of(spark, d, s).join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return compare.shared_groups(side(3), side(4), "p_brand", "p_partkey").select("p_brand", _listed("members").alias("members"))


@register("SELECT event_id FROM events WHERE event_id % 2 = 0 AND event_id NOT IN (SELECT event_id FROM events WHERE event_id % 4 = 0)")
def diff_auth_only(spark: SparkSession, d: str) -> DataFrame:
    events = _table(spark, d, "events")
    return diff.only_in(events.where("event_id % 2 = 0"), events.where("event_id % 4 = 0"), "event_id").select("event_id")


@register("SELECT k AS field, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS k FROM events WHERE event_id % 3 <> 0) GROUP BY 1")
def diff_field_presence(spark: SparkSession, d: str) -> DataFrame:
    events = _table(spark, d, "events").select("event_id", "props")
    return diff.field_presence(events.where("event_id % 3 = 0"), events, "event_id", "props")


# Projection and functions.


@register("SELECT c_custkey, c_name, c_mktsegment FROM customer")
def project_fields(spark: SparkSession, d: str) -> DataFrame:
    return query.list_rows(driver_catalogue(spark, d, "customer"), "customer", {"fields": "c_name, c_mktsegment,nothing"})


@register("SELECT o_orderkey, coalesce(c_custkey, 0) AS c_custkey FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 5000) ON o_custkey = c_custkey")
def null_to_default(spark: SparkSession, d: str) -> DataFrame:
    rich = _table(spark, d, "customer").where("c_acctbal > 5000")
    joined = _table(spark, d, "orders").join(rich, F.col("o_custkey") == F.col("c_custkey"), "left")
    return joined.select("o_orderkey", F.coalesce("c_custkey", F.lit(0)).alias("c_custkey"))


@register(
    """
    SELECT c_custkey AS id, CASE WHEN c_mktsegment = 'BUILDING' THEN c_nationkey::VARCHAR ELSE '<auth-only:number>' END AS nation, '<auth-only:string>' AS name,
           '<auth-only:string>' AS segment
    FROM customer
    """
)
def redact_pii(spark: SparkSession, d: str) -> DataFrame:
    rows = _table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    public = rows.where("segment = 'BUILDING'").select("id", "nation", "name")
    return diff.redact(rows, public)


@register("SELECT c_custkey, CASE WHEN c_mktsegment IN ('BUILDING') THEN c_acctbal END AS c_acctbal FROM customer")
def redact_field(spark: SparkSession, d: str) -> DataFrame:
    from weftwork.operators.nested import redact

    gated = _table(spark, d, "customer").withColumn("visible", F.when(F.col("c_mktsegment") == "BUILDING", "Public").otherwise("Users"))
    return redact(gated, "c_acctbal", "visible", "public").select("c_custkey", "c_acctbal")



def _mbps(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "orders").withColumn("mbps", F.round("o_totalprice").cast("bigint") * (1 + F.col("o_orderkey") % 7))


_ROUNDED = "(round(o_totalprice)::BIGINT * (1 + o_orderkey % 7))"


@register(
    f"""
    SELECT o_orderkey, CASE WHEN {_ROUNDED} >= 1000000 THEN ({_ROUNDED} // 1000000)::VARCHAR || 'T' WHEN {_ROUNDED} >= 1000 THEN ({_ROUNDED} // 1000)::VARCHAR || 'G'
    ELSE {_ROUNDED}::VARCHAR || 'M' END AS speed FROM orders
    """
)
def fmt_speed(spark: SparkSession, d: str) -> DataFrame:
    return _mbps(spark, d).select("o_orderkey", fmt.format_speed(F.col("mbps")).alias("speed"))


@register(
    f"""
    SELECT o_orderkey, CASE WHEN {_ROUNDED} >= 1000000 THEN printf('%.1f Tbps', {_ROUNDED}::DOUBLE / 1000000::DOUBLE)
    WHEN {_ROUNDED} >= 1000 THEN ({_ROUNDED} // 1000)::VARCHAR || ' Gbps' ELSE {_ROUNDED}::VARCHAR || ' Mbps' END AS bandwidth FROM orders
    """
)
def fmt_bandwidth(spark: SparkSession, d: str) -> DataFrame:
    return _mbps(spark, d).select("o_orderkey", fmt.format_bandwidth(F.col("mbps")).alias("bandwidth"))


@register(
    f"""
    SELECT tier, count(*) AS n FROM (SELECT CASE WHEN {_ROUNDED} >= 400000 THEN '400G' WHEN {_ROUNDED} >= 100000 THEN '100G' WHEN {_ROUNDED} > 1000 THEN '10G'
    WHEN {_ROUNDED} = 1000 THEN '1G' ELSE 'sub-1G' END AS tier FROM orders) GROUP BY 1
    """
)
def speed_tier(spark: SparkSession, d: str) -> DataFrame:
    return _mbps(spark, d).groupBy(fmt.speed_tier(F.col("mbps")).alias("tier")).agg(F.count(F.lit(1)).alias("n"))


@register("SELECT n_nationkey, n_name || CASE WHEN r_regionkey < 3 THEN ', ' || r_name ELSE '' END AS place FROM nation JOIN region ON n_regionkey = r_regionkey")
def fmt_location(spark: SparkSession, d: str) -> DataFrame:
    df = _table(spark, d, "nation").join(_table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return df.select("n_nationkey", fmt.format_location(F.col("n_name"), F.when(F.col("r_regionkey") < 3, F.col("r_name")).otherwise("")).alias("place"))


@register(r"SELECT doc_id, length(regexp_replace(text, '[\x00-\x1f\x7f-\x9f]', '', 'g')) AS n FROM documents")
def strip_control(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "documents").select("doc_id", F.length(text.strip_control(F.col("text"))).cast("bigint").alias("n"))


@register(
    """
    SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 OR o_orderkey = 0 THEN NULL ELSE o_orderkey END AS asn FROM orders
    """
)
def parse_asn(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("o_orderkey").cast("string")
    kind = F.col("o_orderkey") % 4
    literal = F.when(kind == 0, F.concat(F.lit("AS"), key)).when(kind == 1, F.concat(F.lit(" as"), key)).when(kind == 2, key).otherwise(F.concat(F.lit("ASN"), key))
    return _table(spark, d, "orders").select("o_orderkey", text.parse_asn_column(literal).alias("asn"))


@register("SELECT event_type, substr(sha256(event_type), 1, 32) AS tag FROM (SELECT DISTINCT event_type FROM events)")
def entity_tag(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "events").select("event_type").distinct().select("event_type", fmt.entity_tag(F.col("event_type")).alias("tag"))



@register(
    """
    SELECT event_id, n_nationkey FROM events JOIN nation ON event_id % 25 = n_nationkey AND event_id % 7 = n_nationkey % 7
    """
)
def ip_in_prefix(spark: SparkSession, d: str) -> DataFrame:
    e, n = F.col("event_id"), F.col("n_nationkey")
    addresses = _table(spark, d, "events").select("event_id", F.concat(F.lit("10."), (e % 25).cast("string"), F.lit("."), (e % 7).cast("string"), F.lit("."), (e % 251).cast("string")).alias("address"))
    prefixes = _table(spark, d, "nation").select("n_nationkey", F.concat(F.lit("10."), n.cast("string"), F.lit("."), (n % 7).cast("string"), F.lit(".0/24")).alias("prefix"))
    return lookup.addresses_in_prefixes(addresses, prefixes).select("event_id", "n_nationkey")


@register(
    """
    SELECT event_id, n_nationkey FROM events JOIN nation ON event_id % 25 = n_nationkey AND event_id % 7 = n_nationkey % 7
    """
)
def ip_in_range(spark: SparkSession, d: str) -> DataFrame:
    e, n = F.col("event_id"), F.col("n_nationkey")
    address = F.concat(F.lit("10."), (e % 25).cast("string"), F.lit("."), (e % 7).cast("string"), F.lit("."), (e % 251).cast("string"))
    prefix = F.concat(F.lit("10."), n.cast("string"), F.lit("."), (n % 7).cast("string"), F.lit(".0/24"))
    points = _table(spark, d, "events").select("event_id", net.ipv4_number(address).alias("number"))
    ranges = _table(spark, d, "nation").select("n_nationkey", net.ipv4_range(prefix).alias("r")).select("n_nationkey", "r.low", "r.high")
    return lookup.numbers_in_ranges(points, ranges, "number", "low", "high").select("event_id", "n_nationkey")


# Merges and streams.


def _halves(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    events = _table(spark, d, "events").select("user_id", "event_id", "ts", "value")
    half = F.lit("2024-01-15").cast("timestamp_ntz")
    order = [F.desc("ts"), F.desc("event_id")]
    return merge.last_wins(events.where(F.col("ts") < half), "user_id", order), merge.last_wins(events.where((F.col("ts") >= half) | (F.col("event_id") % 5 == 0)), "user_id", order)


@register(
    """
    WITH o AS (SELECT user_id, event_id, ts, value FROM events WHERE ts < TIMESTAMP '2024-01-15' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1),
    n AS (SELECT user_id, event_id, ts, value FROM events WHERE ts >= TIMESTAMP '2024-01-15' OR event_id % 5 = 0 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
    SELECT coalesce(o.user_id, n.user_id) AS user_id,
           CASE WHEN o.user_id IS NULL OR n.ts > o.ts THEN n.event_id ELSE o.event_id END AS event_id,
           CASE WHEN o.user_id IS NULL OR n.ts > o.ts THEN n.ts ELSE o.ts END AS ts,
           CASE WHEN o.user_id IS NULL OR n.ts > o.ts THEN n.value ELSE o.value END AS value
    FROM o FULL JOIN n ON o.user_id = n.user_id
    """
)
def merge_upsert_gate(spark: SparkSession, d: str) -> DataFrame:
    old, new = _halves(spark, d)
    return merge.merge(old, new, "user_id", "ts")


@register(
    """
    WITH s AS (SELECT o_orderkey, o_orderstatus, 0 AS a FROM orders WHERE o_orderkey % 3 <> 1
               UNION ALL SELECT o_orderkey, 'X', 1 FROM orders WHERE o_orderkey % 10 = 0)
    SELECT o_orderkey, o_orderstatus FROM s QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY a DESC) = 1
    """
)
def merge_tombstone_overlay(spark: SparkSession, d: str) -> DataFrame:
    orders = _table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    snapshot, window = orders.where("o_orderkey % 3 <> 1"), orders.where("o_orderkey % 10 = 0").withColumn("o_orderstatus", F.lit("X"))
    return merge.overlay(snapshot, window, "o_orderkey")


@register("SELECT user_id, max(ts) AS ts FROM events GROUP BY 1")
def stream_available_now(spark: SparkSession, d: str) -> DataFrame:
    root = shared_folder(spark, "stream")
    schema = _table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(_stream_dir(spark, d, root))
    running = merge.merge_stream(stream.select("user_id", "ts"), f"{root}/table", f"{root}/checkpoint", "user_id", "ts")
    running.awaitTermination()
    return merge.newest_version(spark, f"{root}/table", stream.select("user_id", "ts").schema)


def _stream_dir(spark: SparkSession, d: str, root: str) -> str:
    """A folder of event files for the stream to find: the table in a few files."""
    _table(spark, d, "events").repartition(3, "event_type").write.parquet(f"{root}/in")
    return f"{root}/in"


@register("SELECT c_custkey, 704 + 1664 * (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS bytes FROM customer")
def budget_estimate(spark: SparkSession, d: str) -> DataFrame:
    children = {"orders": (_table(spark, d, "orders"), "o_custkey", cost.row_bytes("net"))}
    return cost.fan_out_bytes(_table(spark, d, "customer"), "c_custkey", cost.row_bytes("org"), children)


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """A list query over two relations, by key and value filters, newest and richest rows first."""
    catalogue: Catalogue = driver_catalogue(spark, d, "customer", "nation", "region")
    found, _, _ = query.matching(catalogue, "customer", {"nation__region__r_name__in": "asia,europe", "c_acctbal__gte": "0"})
    return found.orderBy(F.desc("c_acctbal"), "c_custkey").limit(100)


@register(
    """
    SELECT * FROM customer WHERE c_acctbal >= 0 AND c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE lower(r_name) IN ('asia', 'europe')))
    ORDER BY c_acctbal DESC, c_custkey LIMIT 100
    """
)
def flagship_list(spark: SparkSession, d: str) -> DataFrame:
    return flagship(spark, d)


# The queries over the native catalogue register themselves.
from weftwork import flow_queries, native_queries  # noqa: E402, F401
