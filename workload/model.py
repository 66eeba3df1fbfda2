"""Joins, join discovery and calendar."""

from __future__ import annotations

from pyspark.sql import functions as F

from planspark import (
    build_baseline, calendar_for, calendar_links, detect_relationships, join_dimension, profile_columns,
    relationship_coverage,
)
from planspark.functions import precise_sum
from .registry import SALES, cents, money, query, sales_model, table


@query("join_fact_dim", """
    SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, p_brand, p_size
    FROM lineitem LEFT JOIN part ON l_partkey = p_partkey""")
def join_fact_dim(spark, sf):
    fact = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return join_dimension(fact, table(spark, sf, "part").select("p_partkey", "p_brand", "p_size"), "l_partkey", "p_partkey")


@query("join_dedup_dim", f"""
    WITH first AS (
        SELECT * FROM (SELECT o_custkey, o_orderkey, o_orderstatus, o_orderpriority, o_totalprice,
               row_number() OVER (PARTITION BY o_custkey
                                  ORDER BY o_orderkey, o_orderstatus, o_orderpriority, o_totalprice) AS rn
               FROM orders) WHERE rn = 1)
    SELECT c_custkey, c_mktsegment, o_orderkey, o_orderstatus, o_orderpriority, o_totalprice
    FROM customer LEFT JOIN first ON c_custkey = o_custkey""")
def join_dedup_dim(spark, sf):
    customers = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
    return join_dimension(customers, orders, "c_custkey", "o_custkey")


@query("baseline_snowflake", f"""WITH {SALES}
    SELECT r_name, n_name, c_mktsegment, p_type, COUNT(*) AS n, COUNT(DISTINCT s_name) AS suppliers,
           {money('l_extendedprice')} AS revenue
    FROM sales GROUP BY 1, 2, 3, 4""")
def baseline_snowflake(spark, sf):
    wide = build_baseline(sales_model(spark, sf, unique=frozenset({("orders", "o_orderkey")})), "lineitem", columns=[
        "r_name", "n_name", "c_mktsegment", "p_type", "s_name", "l_extendedprice"])
    got = wide.groupBy("r_name", "n_name", "c_mktsegment", "p_type").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("s_name").alias("suppliers"),
        precise_sum(F.col("l_extendedprice")).alias("revenue"))
    return cents(got, "revenue")


@query("relationship_coverage", """
    WITH s AS (SELECT DISTINCT o_custkey AS v FROM orders WHERE o_custkey IS NOT NULL),
         t AS (SELECT DISTINCT c_custkey AS v FROM customer WHERE c_mktsegment <> 'BUILDING')
    SELECT CAST(floor(100.0 * COUNT(t.v) / COUNT(s.v)) AS BIGINT) AS coverage, COUNT(t.v) AS overlap
    FROM s LEFT JOIN t ON s.v = t.v""")
def relationship_coverage_(spark, sf):
    some = table(spark, sf, "customer").filter("c_mktsegment <> 'BUILDING'")
    return relationship_coverage(table(spark, sf, "orders"), "o_custkey", some, "c_custkey")


_KEYS = {
    "lineitem": ("l_orderkey", "l_partkey", "l_suppkey"), "orders": ("o_orderkey", "o_custkey"),
    "customer": ("c_custkey", "c_nationkey"), "nation": ("n_nationkey", "n_regionkey"), "region": ("r_regionkey",),
    "part": ("p_partkey",), "supplier": ("s_suppkey", "s_nationkey"),
}


def _pairs_sql():
    names, parts = list(_KEYS), []
    for i, a in enumerate(names):
        for b in names[i + 1:]:
            for ca in _KEYS[a]:
                for cb in _KEYS[b]:
                    if ca[2:] == cb[2:]:
                        parts.append(f"""
    SELECT '{a}' AS source, '{b}' AS target, '{ca[2:]}' AS column_name,
           CAST(floor(100.0 * COUNT(t.v) / COUNT(s.v)) AS BIGINT) AS coverage, COUNT(t.v) AS overlap
    FROM (SELECT DISTINCT {ca} AS v FROM {a}) s LEFT JOIN (SELECT DISTINCT {cb} AS v FROM {b}) t ON s.v = t.v""")
    return "SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE coverage >= 50"


@query("detect_relationships", _pairs_sql())
def detect_relationships_(spark, sf):
    keys = {n: table(spark, sf, n).select(*[F.col(c).alias(c[2:]) for c in cols]) for n, cols in _KEYS.items()}
    return detect_relationships(keys)


@query("calendar_link", """
    SELECT 'events' AS source, c AS source_column, '_calendar' AS target,
           CASE WHEN length(sample) = 10 THEN 'date' ELSE 'month_year' END AS target_column
    FROM (SELECT 'event_date' AS c, min(strftime(ts, '%Y-%m-%d')) AS sample FROM events
          UNION ALL SELECT 'event_month', min(strftime(ts, '%Y-%m')) FROM events)""")
def calendar_link(spark, sf):
    # a month later for some types, so that the month column has more than one value
    ts = F.col("ts")
    events = table(spark, sf, "events").select(
        F.date_format(ts, "yyyy-MM-dd").alias("event_date"),
        F.when(F.col("event_type") != "error", F.date_format(ts, "yyyy-MM"))
        .otherwise(F.date_format(F.add_months(ts, 1), "yyyy-MM")).alias("event_month"), "event_type", "value")
    profile, _ = profile_columns(events)
    links = calendar_links("events", profile)
    rows = [(r.source, r.source_column, r.target, r.target_column) for r in links]
    return spark.createDataFrame(rows, "source string, source_column string, target string, target_column string")


@query("calendar_dim", """
    WITH span AS (SELECT date_trunc('year', min(o_orderdate)) AS lo, make_timestamp(year(max(o_orderdate)), 12, 31, 0, 0, 0.0) AS hi
                  FROM orders),
         days AS (SELECT unnest(generate_series(lo::TIMESTAMP, hi, INTERVAL 1 DAY)) AS d FROM span)
    SELECT strftime(d, '%Y-%m-%d') AS date, strftime(d, '%Y-%m') AS month_year, strftime(d, '%Y') AS year,
           strftime(d, '%m') AS month, strftime(d, '%B') AS month_name,
           'Q' || quarter(d) || ' ' || strftime(d, '%Y') AS quarter
    FROM days""")
def calendar_dim_(spark, sf):
    return calendar_for(table(spark, sf, "orders"), "o_orderdate")


@query("calendar_join_day", """
    SELECT 'Q' || quarter(ts) || ' ' || strftime(ts, '%Y') AS quarter, strftime(ts, '%B') AS month_name, event_type,
           COUNT(*) AS n, ROUND(CAST(SUM(CAST(value AS DECIMAL(18,4))) AS DOUBLE), 2) AS value
    FROM events GROUP BY 1, 2, 3""")
def calendar_join_day(spark, sf):
    return _calendar_join(spark, sf, "yyyy-MM-dd", "date")


@query("calendar_join_month", """
    SELECT 'Q' || quarter(ts) || ' ' || strftime(ts, '%Y') AS quarter, strftime(ts, '%B') AS month_name, event_type,
           COUNT(*) AS n, ROUND(CAST(SUM(CAST(value AS DECIMAL(18,4))) AS DOUBLE), 2) AS value
    FROM events GROUP BY 1, 2, 3""")
def calendar_join_month(spark, sf):
    return _calendar_join(spark, sf, "yyyy-MM", "month_year")


def _calendar_join(spark, sf, grain, key):
    events = table(spark, sf, "events")
    dated = events.withColumn("on_date", F.date_format("ts", grain))
    joined = join_dimension(dated, calendar_for(events, "ts"), "on_date", key, {"quarter": "quarter", "month_name": "month_name"})
    got = joined.groupBy("quarter", "month_name", "event_type").agg(
        F.count(F.lit(1)).alias("n"), precise_sum(F.col("value")).alias("value"))
    return cents(got, "value")
