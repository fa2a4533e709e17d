"""The relational constructs of an object mapper, as DataFrame plans on the star schema."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Plan = Callable[[SparkSession, str], DataFrame]


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def filter_exact(s, d):
    return _t(s, d, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey", "c_name")


def filter_chained(s, d):
    return _t(s, d, "orders").where("o_orderstatus = 'F'").where(F.col("o_totalprice") > 200000).select("o_orderkey", "o_totalprice")


def exclude(s, d):
    return _t(s, d, "orders").where(~(F.col("o_orderstatus") == "F")).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


def lookups(s, d):
    part = _t(s, d, "part")
    return part.where((F.col("p_size") > 10) & F.col("p_size").between(5, 30) & F.col("p_name").contains("a") & F.col("p_size").isin(11, 12, 13, 20) & F.col("p_brand").isNotNull()).select("p_partkey", "p_size")


def empty_in(s, d):
    return _t(s, d, "part").where(F.lit(False)).select("p_partkey")


def q_nested(s, d):
    c = _t(s, d, "customer")
    return c.where(((F.col("c_acctbal") > 5000) | (F.col("c_mktsegment") == "MACHINERY")) & ~((F.col("c_nationkey") == 3) & (F.col("c_acctbal") < 0))).select("c_custkey")


def f_expression(s, d):
    return _t(s, d, "lineitem").where(F.col("l_tax") > F.col("l_discount")).groupBy("l_returnflag").agg(F.count("*").alias("n"))


def case_when(s, d):
    size = F.when(F.col("p_size") < 10, "small").when(F.col("p_size") < 30, "medium").otherwise("large")
    return _t(s, d, "part").groupBy(size.alias("size"), F.coalesce("p_brand", F.lit("none")).alias("brand")).agg(F.count("*").alias("n"))


def order_limit_offset(s, d):
    return _t(s, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(10).limit(20).select("o_orderkey", "o_totalprice")


def distinct_values(s, d):
    return _t(s, d, "orders").select("o_orderstatus", "o_orderpriority").distinct()


def values_list(s, d):
    return _t(s, d, "nation").select("n_name", "n_regionkey")


def select_related(s, d):
    orders, customer, nation = (_t(s, d, x) for x in ("orders", "customer", "nation"))
    joined = orders.join(customer, orders.o_custkey == customer.c_custkey).join(nation, F.col("c_nationkey") == nation.n_nationkey)
    return joined.where("o_totalprice > 300000").select("o_orderkey", "c_name", "n_name")


def select_related_deep(s, d):
    region = _t(s, d, "region")
    customer, nation = _t(s, d, "customer"), _t(s, d, "nation")
    lines = _t(s, d, "lineitem").join(_t(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    joined = lines.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy("r_name").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("price"))


def prefetch_related(s, d):
    rich = _t(s, d, "customer").where("c_acctbal > 9000").select("c_custkey")
    return _t(s, d, "orders").join(rich, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey", "o_custkey")


def annotate_count(s, d):
    customer, orders = _t(s, d, "customer"), _t(s, d, "orders")
    counted = customer.join(orders, customer.c_custkey == orders.o_custkey, "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("orders"))
    return counted.where("orders > 15")


def annotate_avg(s, d):
    orders, customer = _t(s, d, "orders"), _t(s, d, "customer")
    return customer.join(orders, customer.c_custkey == orders.o_custkey, "left").groupBy("c_mktsegment").agg(F.round(F.avg("o_totalprice"), 4).alias("mean_price"))


def aggregate_sum(s, d):
    return _t(s, d, "lineitem").agg(F.round(F.sum("l_quantity"), 2).alias("quantity"), F.count("*").alias("n"))


def related_filter(s, d):
    nation, customer = _t(s, d, "nation").where("n_name like 'A%' or n_regionkey = 1"), _t(s, d, "customer")
    return customer.join(nation, customer.c_nationkey == nation.n_nationkey).select("c_custkey", "n_name")


def exists_and_first(s, d):
    orders = _t(s, d, "orders").where("o_totalprice > 100000")
    return orders.agg((F.count("*") > 0).alias("any"), F.count("*").alias("n"), F.min("o_orderkey").alias("first_key"))


def bulk_create(s, d):
    """Rows made in one statement, beside those that are there; ids that exist already are not made again."""
    nation = _t(s, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    made = _t(s, d, "region").select((F.col("r_regionkey") + 23).cast("int").alias("n_nationkey"), F.concat(F.lit("NEW "), "r_name").alias("n_name"), F.col("r_regionkey").alias("n_regionkey"))
    return nation.unionByName(made.join(nation, "n_nationkey", "left_anti").select(nation.columns))


def bulk_update(s, d):
    """All rows of the table after one UPDATE with a condition."""
    customer = _t(s, d, "customer")
    raised = F.when(F.col("c_mktsegment") == "BUILDING", F.round(F.col("c_acctbal") * 2, 2)).otherwise(F.col("c_acctbal"))
    return customer.select("c_custkey", raised.alias("c_acctbal"))


def bulk_delete(s, d):
    """What one DELETE by a condition on another table leaves."""
    gone = _t(s, d, "customer").where("c_acctbal < 0").select("c_custkey")
    return _t(s, d, "orders").join(gone, F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("o_orderkey")


PLANS: dict[str, Plan] = {f"orm_{f.__name__}": f for f in (
    filter_exact, filter_chained, exclude, lookups, empty_in, q_nested, f_expression, case_when, order_limit_offset, distinct_values, values_list, select_related, select_related_deep,
    prefetch_related, annotate_count, annotate_avg, aggregate_sum, related_filter, exists_and_first, bulk_create, bulk_update, bulk_delete,
)}
SQL: dict[str, str] = {
    "orm_filter_exact": "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING'",
    "orm_filter_chained": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 200000",
    "orm_exclude": "SELECT o_orderstatus, count(*) AS n FROM orders WHERE NOT (o_orderstatus = 'F') GROUP BY o_orderstatus",
    "orm_lookups": "SELECT p_partkey, p_size FROM part WHERE p_size > 10 AND p_size BETWEEN 5 AND 30 AND contains(p_name, 'a') AND p_size IN (11, 12, 13, 20) AND p_brand IS NOT NULL",
    "orm_empty_in": "SELECT p_partkey FROM part WHERE false",
    "orm_q_nested": "SELECT c_custkey FROM customer WHERE (c_acctbal > 5000 OR c_mktsegment = 'MACHINERY') AND NOT (c_nationkey = 3 AND c_acctbal < 0)",
    "orm_f_expression": "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_tax > l_discount GROUP BY l_returnflag",
    "orm_case_when": "SELECT CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS size, coalesce(p_brand, 'none') AS brand, count(*) AS n FROM part GROUP BY 1, 2",
    "orm_order_limit_offset": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 10",
    "orm_distinct_values": "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders",
    "orm_values_list": "SELECT n_name, n_regionkey FROM nation",
    "orm_select_related": "SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_totalprice > 300000",
    "orm_select_related_deep": "SELECT r_name, count(*) AS n, round(sum(l_extendedprice), 2) AS price FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
    "orm_prefetch_related": "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 9000)",
    "orm_annotate_count": "SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey HAVING count(o_orderkey) > 15",
    "orm_annotate_avg": "SELECT c_mktsegment, round(avg(o_totalprice), 4) AS mean_price FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_mktsegment",
    "orm_aggregate_sum": "SELECT round(sum(l_quantity), 2) AS quantity, count(*) AS n FROM lineitem",
    "orm_related_filter": "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name LIKE 'A%' OR n_regionkey = 1",
    "orm_bulk_create": "SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT (r_regionkey + 23)::INTEGER, 'NEW ' || r_name, r_regionkey FROM region WHERE r_regionkey + 23 NOT IN (SELECT n_nationkey FROM nation)",
    "orm_bulk_update": "SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN round(c_acctbal * 2, 2) ELSE c_acctbal END AS c_acctbal FROM customer",
    "orm_bulk_delete": "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)",
    "orm_exists_and_first": "SELECT count(*) > 0 AS \"any\", count(*) AS n, min(o_orderkey) AS first_key FROM orders WHERE o_totalprice > 100000",
}
