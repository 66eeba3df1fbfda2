from __future__ import annotations

from pyspark.sql import functions as F

from planspark import pivot_long, pivot_wide, sort_pivot
from .registry import SALES, cents, money, query, sales

_FLAGS = ["A", "N", "R"]


def _rows(spark, sf, *extra):
    return sales(spark, sf, "c_mktsegment", "l_returnflag", "l_extendedprice", *extra)


@query("pivot_long", f"""WITH {SALES}
    SELECT COALESCE(NULLIF(c_mktsegment, 'BUILDING'), '—') AS segment, o_orderpriority, l_returnflag,
           {money('l_extendedprice')} AS l_extendedprice
    FROM sales GROUP BY 1, 2, 3""")
def pivot_long_(spark, sf):
    rows = _rows(spark, sf, "o_orderpriority").withColumn("segment", F.nullif("c_mktsegment", F.lit("BUILDING")))
    return cents(pivot_long(rows, ["segment", "o_orderpriority"], "l_returnflag", "l_extendedprice"), "l_extendedprice")


_CELLS = ", ".join(
    f"ROUND(COALESCE(CAST(SUM(CASE WHEN l_returnflag = '{k}' THEN CAST(l_extendedprice AS DECIMAL(18,4)) END) AS DOUBLE), 0), 2) AS \"{k}\""
    for k in _FLAGS)


@query("pivot_wide", f"""WITH {SALES}
    SELECT c_mktsegment, {_CELLS}, {money('l_extendedprice')} AS _total FROM sales GROUP BY 1""")
def pivot_wide_(spark, sf):
    return cents(pivot_wide(_rows(spark, sf), ["c_mktsegment"], "l_returnflag", "l_extendedprice", values=_FLAGS), *_FLAGS, "_total")


@query("pivot_totals", f"""WITH {SALES}
    SELECT COALESCE(c_mktsegment, 'Total') AS c_mktsegment, {_CELLS}, {money('l_extendedprice')} AS _total
    FROM sales GROUP BY ROLLUP (c_mktsegment)""")
def pivot_totals(spark, sf):
    got = pivot_wide(_rows(spark, sf), ["c_mktsegment"], "l_returnflag", "l_extendedprice", totals=True)
    return cents(got, *_FLAGS, "_total")


@query("pivot_sorted", f"""WITH {SALES}, g AS (
    SELECT p_brand, o_orderpriority, {money('l_extendedprice')} AS l_extendedprice FROM sales GROUP BY 1, 2)
    SELECT *, row_number() OVER (ORDER BY l_extendedprice DESC, p_brand, o_orderpriority) AS pos FROM g""")
def pivot_sorted(spark, sf):
    rows = sales(spark, sf, "p_brand", "o_orderpriority", "l_extendedprice")
    long = cents(pivot_long(rows, ["p_brand", "o_orderpriority"], None, "l_extendedprice"), "l_extendedprice")
    got = sort_pivot(long, ["p_brand", "o_orderpriority"], "l_extendedprice")
    return got.withColumn("pos", F.col("pos").cast("bigint"))
