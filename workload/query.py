from __future__ import annotations

from pyspark.sql import functions as F

from planspark import (
    available_periods, calendar_for, derive_period, dimension_values, filter_period_range, filter_values, query_grouped,
    run_query, scan, screen_filter, value_counts, with_period,
)
from .registry import SALES, cents, money, query, sales, table


@query("scan_project_filter", """
    SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'""")
def scan_project_filter(spark, sf):
    return scan(table(spark, sf, "orders"), ["o_orderkey", "o_custkey", "o_totalprice"],
                {"o_orderstatus": "F", "o_orderpriority": "1-URGENT"})


@query("query_filter_eq", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_custkey = 7")
def query_filter_eq(spark, sf):
    got = run_query(table(spark, sf, "orders"), {"filters": {"o_custkey": 7}, "limit": 0})
    return got.select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("query_filter_in", """
    SELECT p_partkey, p_brand, p_size FROM part WHERE p_size IN (1, 5, 10) AND p_brand IN ('Brand#2', 'Brand#17')""")
def query_filter_in(spark, sf):
    spec = {"columns": ["p_partkey", "p_brand", "p_size"], "limit": 0,
            "filters": {"p_size": ["1", 5, "10", "many"], "p_brand": ["Brand#2", "Brand#17"]}}
    return run_query(table(spark, sf, "part"), spec)


@query("query_order_limit", """
    SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders
    ORDER BY o_orderpriority ASC, o_totalprice DESC, o_orderkey ASC LIMIT 1000""")
def query_order_limit(spark, sf):
    return run_query(table(spark, sf, "orders"), {
        "columns": ["o_orderkey", "o_orderpriority", "o_totalprice"],
        "order_by": [{"column": "o_orderpriority"}, {"column": "o_totalprice", "direction": "desc"},
                     {"column": "o_orderkey"}], "limit": 1000,
    })


@query("filter_period_range", f"""
    SELECT strftime(l_shipdate, '%Y-%m') AS period, COUNT(*) AS n, {money('l_extendedprice')} AS revenue
    FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-03-01' AND l_shipdate < TIMESTAMP '1997-07-01' GROUP BY 1""")
def filter_period_range_(spark, sf):
    kept = filter_period_range(table(spark, sf, "lineitem"), "1997-03", "1997-06", period="l_shipdate")
    got = run_query(with_period(kept, "l_shipdate").withColumn("n", F.lit(1)), {
        "group_by": ["period"], "aggregations": {"n": "sum", "l_extendedprice": "sum"}, "limit": 0})
    return cents(got.withColumnRenamed("l_extendedprice", "revenue"), "revenue")


@query("ui_filter", """
    SELECT c_custkey, c_mktsegment, c_nationkey FROM customer
    WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey IN (1, 2, 3)""")
def ui_filter(spark, sf):
    customers = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    return screen_filter(customers, {"c_mktsegment": ["BUILDING", "MACHINERY"], "c_nationkey": [1, 2, 3], "c_custkey": []})


@query("dimension_search", """
    SELECT DISTINCT p_name AS value FROM part WHERE lower(p_name) LIKE '%ring%' ORDER BY 1 LIMIT 100""")
def dimension_search(spark, sf):
    return dimension_values(table(spark, sf, "part"), "p_name", search="RING")


@query("derive_period", """
    SELECT strftime(ts, '%Y-%m') AS _period, event_type, COUNT(*) AS n FROM events GROUP BY 1, 2""")
def derive_period_(spark, sf):
    noted = table(spark, sf, "events").select("event_type", F.date_format("ts", "yyyy-MM-dd").alias("noted_on"))
    return derive_period(noted).groupBy("_period", "event_type").agg(F.count(F.lit(1)).alias("n"))


def _grouped(fn, out):
    def build(spark, sf):
        got = run_query(sales(spark, sf, "c_mktsegment", "o_orderpriority", "l_extendedprice"), {
            "group_by": ["c_mktsegment", "o_orderpriority"], "aggregations": {"l_extendedprice": fn}, "limit": 0})
        got = got.withColumnRenamed("l_extendedprice", out)
        return got if fn == "count" else got.withColumn(out, F.round(out, 6 if fn == "avg" else 4))
    return build


for _fn, _sql in {
    "sum": money("l_extendedprice", 4), "min": "MIN(l_extendedprice)", "max": "MAX(l_extendedprice)",
    "count": "COUNT(l_extendedprice)",
    "avg": "ROUND(CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,4))) AS DOUBLE) / COUNT(l_extendedprice), 6)",
}.items():
    query(f"query_group_{_fn}", f"""WITH {SALES}
    SELECT c_mktsegment, o_orderpriority, {_sql} AS {_fn}_price FROM sales GROUP BY 1, 2""")(_grouped(_fn, f"{_fn}_price"))


@query("query_top50", f"""WITH {SALES}
    SELECT p_brand, o_orderpriority, {money('l_extendedprice')} AS l_extendedprice FROM sales
    WHERE c_mktsegment IN ('BUILDING', 'AUTOMOBILE') GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 50""")
def query_top50(spark, sf):
    rows = sales(spark, sf, "p_brand", "o_orderpriority", "c_mktsegment", "l_extendedprice")
    got = query_grouped(rows, ["p_brand", "o_orderpriority"], "l_extendedprice",
                        filters={"c_mktsegment": ["BUILDING", "AUTOMOBILE"]})
    return cents(got, "l_extendedprice")


@query("query_total", f"SELECT {money('l_extendedprice')} AS l_extendedprice FROM lineitem WHERE l_returnflag IN ('R')")
def query_total(spark, sf):
    got = query_grouped(table(spark, sf, "lineitem"), [], "l_extendedprice", filters={"l_returnflag": ["R"]})
    return cents(got, "l_extendedprice")


@query("value_counts", """
    SELECT p_name AS value, COUNT(*) AS count FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 30""")
def value_counts_(spark, sf):
    return value_counts(table(spark, sf, "part"), "p_name")


@query("available_periods", """
    SELECT DISTINCT strftime(l_shipdate, '%Y-%m') AS period, strftime(l_shipdate, '%Y') AS year FROM lineitem""")
def available_periods_(spark, sf):
    return available_periods(with_period(table(spark, sf, "lineitem"), "l_shipdate"))


@query("filter_values_calendar", """
    WITH span AS (SELECT date_trunc('year', min(ts)) AS lo, year(max(ts)) AS hi FROM events)
    SELECT strftime(m, '%Y-%m') AS value
    FROM (SELECT unnest(generate_series(lo, make_timestamp(hi, 12, 1, 0, 0, 0.0), INTERVAL 1 MONTH)) AS m FROM span)
    UNION SELECT strftime(ts, '%Y-%m') FROM events""")
def filter_values_calendar(spark, sf):
    events = table(spark, sf, "events")
    return filter_values(with_period(events, "ts"), "period", calendar_for(events, "ts"))
