"""Joins, aggregates, windows, set operations and top-k over the star schema."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .registry import query

REVENUE = "l_extendedprice * (1 - l_discount)"


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL", digits=None)
def pricing_summary(t):
    rows = t("lineitem").where("l_shipdate <= timestamp_ntz'1998-09-02'")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.expr(REVENUE)), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


@query("SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY n_name", digits=None)
def revenue_by_nation(t):
    rows = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).where("r_name = 'ASIA'")
    return rows.groupBy("n_name").agg(F.round(F.sum(F.expr(REVENUE)), 2).alias("revenue"))


@query("SELECT o_orderkey, o_totalprice, o_custkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def top_orders(t):
    return t("orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20).select("o_orderkey", "o_totalprice", "o_custkey")


@query("SELECT l_suppkey, l_orderkey, l_linenumber, rank FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber)::BIGINT AS rank FROM lineitem) WHERE rank <= 3")
def top_items_by_supplier(t):
    w = Window.partitionBy("l_suppkey").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber")
    return t("lineitem").withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 3").select("l_suppkey", "l_orderkey", "l_linenumber", "rank")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def customers_without_orders(t):
    return t("customer").join(t("orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query("SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') GROUP BY c_mktsegment")
def segments_with_orders(t):
    done = t("orders").where("o_orderstatus = 'F'")
    return t("customer").join(done, F.col("c_custkey") == F.col("o_custkey"), "left_semi").groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)", digits=None)
def order_rollup(t):
    return t("orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def item_cube(t):
    return t("lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("SELECT s_nationkey AS nationkey FROM supplier INTERSECT SELECT c_nationkey FROM customer WHERE c_acctbal > 9000")
def nations_intersect(t):
    return t("supplier").select(F.col("s_nationkey").alias("nationkey")).intersect(t("customer").where("c_acctbal > 9000").select("c_nationkey"))


@query("SELECT n_nationkey AS nationkey FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal < 0")
def nations_except(t):
    return t("nation").select(F.col("n_nationkey").alias("nationkey")).exceptAll(t("supplier").where("s_acctbal < 0").select("s_nationkey").distinct())


@query("SELECT user_id, event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 6) AS running FROM events")
def running_value(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return t("events").select("user_id", "event_id", F.sum("value").over(w).alias("running"))


@query("SELECT p_brand, count(DISTINCT l_suppkey) AS suppliers, round(max(p_retailprice), 2) AS top_price FROM part JOIN lineitem ON p_partkey = l_partkey WHERE p_size > 20 GROUP BY p_brand", digits=None)
def brand_suppliers(t):
    rows = t("part").where("p_size > 20").join(t("lineitem"), F.col("p_partkey") == F.col("l_partkey"))
    return rows.groupBy("p_brand").agg(F.countDistinct("l_suppkey").alias("suppliers"), F.round(F.max("p_retailprice"), 2).alias("top_price"))


@query("SELECT r_name, n_name, count(c_custkey) AS customers FROM region JOIN nation ON r_regionkey = n_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL")
def customers_by_nation(t):
    rows = t("region").join(t("nation"), F.col("r_regionkey") == F.col("n_regionkey")).join(t("customer"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return rows.groupBy("r_name", "n_name").agg(F.count("c_custkey").alias("customers"))
