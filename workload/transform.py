from __future__ import annotations

from pyspark.sql import functions as F

from planspark import VersionedTable, apply_step, apply_steps, materialize_steps, preview_step, with_period
from planspark.functions import precise_sum
from planspark.sources.shared import new_path
from .registry import cents, money, query, table


def _part(spark, sf):
    return table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_size", "p_retailprice")


def _reclass(name, source, rules, case, default="Other"):
    @query(f"reclass_{name}", f"SELECT p_partkey, {source}, CASE {case} ELSE '{default}' END AS cls FROM part")
    def build(spark, sf):
        step = {"step_type": "reclassification", "source_column": source, "output_column": "cls", "rules": rules}
        return apply_step(_part(spark, sf), step).select("p_partkey", source, "cls")


def _rule(op, result, value=None, values=None):
    return {"condition": {"op": op, "value": value, "values": values}, "result": result}


_reclass("between", "p_size", [_rule("between", "teens", values=[10, 19]), {"default": "Z"}, _rule("between", "twenties", values=["20", "29"])],
         "WHEN CAST(p_size AS VARCHAR) BETWEEN '10' AND '19' THEN 'teens' WHEN CAST(p_size AS VARCHAR) BETWEEN '20' AND '29' THEN 'twenties'", "Z")
_reclass("in", "p_size", [_rule("in", "small", values=[1, 2, "3"]), _rule("in", "odd", values=["3", "5", "7"])],
         "WHEN p_size IN (1, 2, 3) THEN 'small' WHEN p_size IN (5, 7) THEN 'odd'")
_reclass("equals", "p_brand", [_rule("equals", "two", value="Brand#2"), _rule("like", "never", value="x"), {"default": None}],
         "WHEN p_brand = 'Brand#2' THEN 'two'")
_reclass("contains", "p_name", [_rule("contains", "rings", value="ring"), _rule("contains", "reds", value="red")],
         "WHEN contains(p_name, 'ring') THEN 'rings' WHEN contains(p_name, 'red') THEN 'reds'")
_reclass("starts_with", "p_brand", [_rule("starts_with", "tens", value="Brand#1"), _rule("starts_with", "rest", value="Brand")],
         "WHEN starts_with(p_brand, 'Brand#1') THEN 'tens' WHEN starts_with(p_brand, 'Brand') THEN 'rest'")
_reclass("not_equals", "p_brand", [_rule("not_equals", "others", value="Brand#2"), {"default": "two"}],
         "WHEN p_brand <> 'Brand#2' THEN 'others'", "two")


def _calc(name, expression, sql):
    @query(f"calc_{name}", f"SELECT l_orderkey, l_linenumber, l_partkey, {sql} AS result FROM lineitem")
    def build(spark, sf):
        step = {"step_type": "calculated_column", "output_column": "result", "expression": expression}
        got = apply_step(table(spark, sf, "lineitem"), step)
        return got.select("l_orderkey", "l_linenumber", "l_partkey", "result")


def _c(name):
    return {"column": name}


_calc("arithmetic",
      {"op": "multiply", "left": _c("l_extendedprice"),
       "right": {"op": "subtract", "left": {"literal": 1}, "right": _c("l_discount")}},
      "l_extendedprice * (1.0::DOUBLE - l_discount)")
_calc("divide_zero",
      {"op": "divide", "left": _c("l_extendedprice"), "right": _c("l_tax")},
      "CASE WHEN l_tax <> 0 THEN l_extendedprice / l_tax END")
_calc("unary",
      {"op": "round", "decimals": 1, "left": {"op": "abs", "left": {"op": "negate", "left": _c("l_extendedprice")}}},
      "round(abs(-l_extendedprice), 1)")


@query("calc_null_zero", """
    SELECT l_orderkey, l_linenumber, l_partkey, COALESCE(CASE WHEN l_tax > 0.04 THEN l_tax END, 0) + 1.0::DOUBLE AS result
    FROM lineitem""")
def calc_null_zero(spark, sf):
    some = table(spark, sf, "lineitem").withColumn("high_tax", F.when(F.col("l_tax") > 0.04, F.col("l_tax")))
    step = {"step_type": "calculated_column", "output_column": "result", "expression": {
        "op": "add", "left": _c("high_tax"), "right": {"literal": 1}, "null_handling": "zero"}}
    return apply_step(some, step).select("l_orderkey", "l_linenumber", "l_partkey", "result")


@query("concat_columns", """
    SELECT p_partkey, p_brand || ' / ' || COALESCE(CASE WHEN p_size > 10 THEN p_name END, '') || ' / ' || p_size AS title FROM part""")
def concat_columns(spark, sf):
    named = _part(spark, sf).withColumn("long_name", F.when(F.col("p_size") > 10, F.col("p_name")))
    step = {"step_type": "concat", "columns": ["p_brand", "long_name", "p_size"], "separator": " / ", "output_column": "title"}
    return apply_step(named, step).select("p_partkey", "title")


@query("rename_column", "SELECT p_partkey, p_brand AS brand, p_size FROM part")
def rename_column(spark, sf):
    got = apply_step(_part(spark, sf), {"step_type": "rename", "from_column": "p_brand", "to_column": "brand"})
    return got.select("p_partkey", "brand", "p_size")


_BANDS = {"step_type": "reclassification", "source_column": "p_brand", "output_column": "band", "output_type": "text",
          "rules": [_rule("starts_with", "tens", value="Brand#1"), {"default": "rest"}]}


@query("preview_transform", """
    SELECT CASE WHEN starts_with(p_brand, 'Brand#1') THEN 'tens' ELSE 'rest' END AS value, COUNT(*) AS count
    FROM (SELECT * FROM part ORDER BY p_partkey LIMIT 200) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 30""")
def preview_transform(spark, sf):
    return preview_step(_part(spark, sf), _BANDS, order_by=["p_partkey"]).new_column_stats["band"]


@query("apply_steps", """
    SELECT p_partkey, CASE WHEN starts_with(p_brand, 'Brand#1') THEN 'tens' ELSE 'rest' END AS band,
           CAST(CAST(p_retailprice * 1.19 AS DECIMAL(18,4)) AS DOUBLE) AS gross,
           (CASE WHEN starts_with(p_brand, 'Brand#1') THEN 'tens' ELSE 'rest' END) || '-' || p_size AS code
    FROM part""")
def apply_steps_(spark, sf):
    steps = [
        {"step_type": "concat", "columns": ["band", "p_size"], "separator": "-", "output_column": "code", "step_order": 3},
        {**_BANDS, "step_order": 1},
        {"step_type": "calculated_column", "output_column": "gross", "output_type": "numeric", "step_order": 2,
         "expression": {"op": "multiply", "left": _c("p_retailprice"), "right": {"literal": 1.19}}},
        {"step_type": "rename", "from_column": "band", "to_column": "gone", "step_order": 4, "status": "rejected"},
    ]
    got = apply_steps(_part(spark, sf), steps)
    return got.select("p_partkey", "band", F.col("gross").cast("double").alias("gross"), "code")


_FLAGS = {"step_type": "reclassification", "source_column": "l_returnflag", "output_column": "state", "output_type": "text", "step_order": 1,
          "rules": [_rule("equals", "back", value="R"), _rule("equals", "kept", value="A"), {"default": "open"}]}
_STEPS = [
    _FLAGS,
    {"step_type": "calculated_column", "output_column": "net", "output_type": "numeric", "step_order": 2,
     "expression": {"op": "multiply", "left": _c("l_extendedprice"), "right": {"op": "subtract", "left": {"literal": 1}, "right": _c("l_discount")}}},
    {"step_type": "rename", "from_column": "state", "to_column": "status", "step_order": 3},
]
_AGAIN = [{**_FLAGS, "output_column": "status", "rules": [_rule("equals", "back", value="R"), _rule("equals", "kept", value="A"), {"default": "due"}]}]


@query("materialize_steps", f"""
    WITH s AS (SELECT strftime(l_shipdate, '%Y-%m') AS period, CASE l_returnflag WHEN 'R' THEN 'back' WHEN 'A' THEN 'kept' ELSE 'due' END AS status,
                      CAST(l_extendedprice * (1.0::DOUBLE - l_discount) AS DECIMAL(18,4)) AS net FROM lineitem),
    t AS (SELECT COUNT(*) AS rows_touched, COUNT(*) FILTER (status = 'due') AS rows_moved,
                 COUNT(DISTINCT CASE WHEN status = 'due' THEN period END) AS partitions_written FROM s)
    SELECT period, status, COUNT(*) AS n, {money('net')} AS net, ANY_VALUE(rows_touched) AS rows_touched, ANY_VALUE(rows_moved) AS rows_moved,
           ANY_VALUE(partitions_written) AS partitions_written
    FROM s, t GROUP BY 1, 2""")
def materialize_steps_(spark, sf):
    lines = with_period(table(spark, sf, "lineitem"), "l_shipdate").select("l_orderkey", "l_linenumber", "l_returnflag", "l_extendedprice", "l_discount", "period")
    stored = VersionedTable.create(lines, new_path(spark, "versions"), "period")
    materialize_steps(stored, _STEPS)
    found = materialize_steps(stored, _AGAIN)
    sums = stored.read().groupBy("period", "status").agg(F.count(F.lit(1)).alias("n"), precise_sum(F.col("net").cast("double")).alias("net"))
    return cents(sums, "net").withColumns({
        "rows_touched": F.lit(found.rows).cast("long"), "rows_moved": F.lit(found.moved).cast("long"),
        "partitions_written": F.lit(len(found.partitions)).cast("long")})
