from __future__ import annotations

from pyspark.sql import functions as F

from planspark import Rule, apply_rules, preview_rules
from planspark.functions import precise_sum
from .registry import SALES, cents, exact, money, query, rounded, sales

V = "l_extendedprice"
YEAR_1997 = {"periodFrom": "1997-01", "periodTo": "1997-12"}
BUILDING = {"c_mktsegment": ["BUILDING"]}


def rows(spark, sf):
    return sales(spark, sf, "period", "c_mktsegment", "l_returnflag", V)


def by_period(df, keys=("period", "c_mktsegment")):
    got = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), precise_sum(F.col(V)).alias("value"))
    return cents(got, "value")


BASE = f"{SALES}, r0 AS (SELECT period, c_mktsegment, l_returnflag, {V} AS v FROM sales)"


def step(i, hit, kind, amount, screen=False, months=None):
    """CTEs ``m<i>`` (matches), ``s<i>`` (totals) and ``r<i>`` (new values) for one rule on top of ``r<i-1>``."""
    changed = {
        "scale": f"v * {amount}",
        "scale_equal": f"v + t * ({amount} - 1.0::DOUBLE) / n",
        "spread": f"v + CASE WHEN t = 0 THEN {amount} / n ELSE abs(v) / t * {amount} END",
        "equal": f"v + {amount} / {months or 'np'} / pn",
        "equal_flat": f"v + {amount} / n",
        "scale_equal_screen": f"v + t * ({amount} - 1.0::DOUBLE) / {months or 'np'} / pn",
    }[kind]
    if screen:
        changed = f"floor(({changed}) * 100 + 0.5) / 100"
    return f"""m{i} AS (SELECT *, ({hit}) AS hit FROM r{i - 1}),
    s{i} AS (SELECT CAST({exact('CASE WHEN hit THEN abs(v) END')} AS DOUBLE) AS t,
             CAST(COUNT(*) FILTER (hit) AS DOUBLE) AS n, CAST(COUNT(DISTINCT period) FILTER (hit) AS DOUBLE) AS np FROM m{i}),
    p{i} AS (SELECT period AS pp, CAST(COUNT(*) AS DOUBLE) AS pn FROM m{i} WHERE hit GROUP BY 1),
    r{i} AS (SELECT m{i}.* EXCLUDE (hit, v), CASE WHEN hit THEN {changed} ELSE v END AS v
             FROM m{i} CROSS JOIN s{i} LEFT JOIN p{i} ON period = pp)"""


def chain(*steps, base=BASE, keys="period, c_mktsegment"):
    return f"WITH {base}, {', '.join(steps)} SELECT {keys}, COUNT(*) AS n, {money('v')} AS value FROM r{len(steps)} GROUP BY ALL"


HIT = "c_mktsegment = 'BUILDING' AND period BETWEEN '1997-01' AND '1997-12'"


def _single(name, rule, sql, mode="server"):
    @query(name, sql)
    def build(spark, sf):
        return by_period(apply_rules(rows(spark, sf), [rule], V, mode=mode))


_single("rule_multiplier", {"type": "multiplier", "factor": 1.0375, "filters": BUILDING, **YEAR_1997},
        chain(step(1, HIT, "scale", "1.0375::DOUBLE")))
_single("rule_multiplier_equal", {"type": "multiplier", "factor": 1.05, "distribution": "equal", "filters": BUILDING, **YEAR_1997},
        chain(step(1, HIT, "scale_equal", "1.05::DOUBLE")))
_single("rule_offset", {"type": "offset", "offset": 100000, "filters": BUILDING, **YEAR_1997},
        chain(step(1, HIT, "spread", "100000.0::DOUBLE")))
_single("rule_offset_equal", {"type": "offset", "offset": 120000, "distribution": "equal", "filters": BUILDING, **YEAR_1997},
        chain(step(1, HIT, "equal", "120000.0::DOUBLE")))
_single("ui_rule_multiplier", {"type": "multiplier", "factor": 1.0375, "filters": {**BUILDING, "l_returnflag": []}, **YEAR_1997},
        chain(step(1, HIT, "scale", "1.0375::DOUBLE", screen=True)), "screen")
_single("ui_rule_multiplier_equal",
        {"type": "multiplier", "factor": 1.05, "distribution": "equal", "filters": BUILDING, "periodFrom": "2001-09", "periodTo": "2002-04"},
        chain(step(1, "c_mktsegment = 'BUILDING' AND period BETWEEN '2001-09' AND '2002-04'", "scale_equal_screen",
                   "1.05::DOUBLE", True, "8.0::DOUBLE")), "screen")
_single("ui_rule_offset_equal",
        {"type": "offset", "offset": 120000, "distribution": "equal", "filters": BUILDING, "periodFrom": "2001-09"},
        chain(step(1, "c_mktsegment = 'BUILDING' AND period >= '2001-09'", "equal", "120000.0::DOUBLE", True)), "screen")


@query("rule_offset_zero_base", chain(
    step(1, HIT, "spread", "50000.0::DOUBLE"),
    base=f"{SALES}, r0 AS (SELECT period, c_mktsegment, CASE WHEN c_mktsegment = 'BUILDING' THEN 0.0::DOUBLE ELSE {V} END AS v FROM sales)"))
def rule_offset_zero_base(spark, sf):
    zeroed = rows(spark, sf).withColumn(V, F.when(F.col("c_mktsegment") == "BUILDING", F.lit(0.0)).otherwise(F.col(V)))
    return by_period(apply_rules(zeroed, [{"type": "offset", "offset": 50000, "filters": BUILDING, **YEAR_1997}], V))


@query("rule_offset_equal_noperiod", chain(
    step(1, "c_mktsegment = 'BUILDING'", "equal_flat", "120000.0::DOUBLE"),
    base=f"{SALES}, r0 AS (SELECT period, c_mktsegment, l_returnflag, {V} AS v FROM sales)", keys="c_mktsegment, l_returnflag"))
def rule_offset_equal_noperiod(spark, sf):
    plain = rows(spark, sf).drop("period")
    rule = {"type": "offset", "offset": 120000, "distribution": "equal", "filters": BUILDING}
    return by_period(apply_rules(plain, [rule], V), ("c_mktsegment", "l_returnflag"))


CHAIN = [
    {"name": "price", "type": "multiplier", "factor": 1.05, "filters": BUILDING, **YEAR_1997},
    {"name": "campaign", "type": "offset", "offset": 1e6, "filters": {"c_mktsegment": ["AUTOMOBILE", "BUILDING"]}},
    {"name": "rent", "type": "offset", "offset": -500000, "distribution": "equal",
     "filters": {"c_mktsegment": ["MACHINERY"]}, "periodFrom": "1998-01", "periodTo": "1998-12"},
    {"name": "flat cut", "type": "multiplier", "factor": 0.9, "distribution": "equal",
     "filters": {"c_mktsegment": ["HOUSEHOLD", "BUILDING"]}, "periodFrom": "1997-06", "periodTo": "1998-06"},
    {"name": "claw back", "type": "offset", "offset": -250000, "filters": BUILDING},
    {"name": "ignored", "type": "other"},
]


@query("rules_chain", chain(
    step(1, HIT, "scale", "1.05::DOUBLE"),
    step(2, "c_mktsegment IN ('AUTOMOBILE', 'BUILDING')", "spread", "1000000.0::DOUBLE"),
    step(3, "c_mktsegment = 'MACHINERY' AND period BETWEEN '1998-01' AND '1998-12'", "equal", "(-500000.0::DOUBLE)"),
    step(4, "c_mktsegment IN ('HOUSEHOLD', 'BUILDING') AND period BETWEEN '1997-06' AND '1998-06'", "scale_equal", "0.9::DOUBLE"),
    step(5, "c_mktsegment = 'BUILDING'", "spread", "(-250000.0::DOUBLE)")))
def rules_chain(spark, sf):
    return by_period(apply_rules(rows(spark, sf), CHAIN, V))


MANY = [
    {"type": "offset", "offset": 1e6, "distribution": "equal", "filters": {"c_mktsegment": ["AUTOMOBILE", "BUILDING"]}},
    {"type": "multiplier", "factor": 1.1, "distribution": "equal", "filters": {"l_returnflag": ["R", "A"]}},
    {"type": "offset", "offset": -2e6, "filters": BUILDING, **YEAR_1997},
    {"type": "multiplier", "factor": 0.5, "filters": {"c_mktsegment": ["MACHINERY"]}},
    {"type": "offset", "offset": 3e5, "distribution": "equal", "filters": {"l_returnflag": ["N"]}, "periodFrom": "1996-03", "periodTo": "1998-02"},
    {"type": "offset", "offset": 7e5, "filters": {"c_mktsegment": ["MACHINERY", "BUILDING"]}},
    {"type": "multiplier", "factor": 1.02, "distribution": "equal", "filters": {"c_mktsegment": ["FURNITURE", "BUILDING"]}},
]


@query("rules_many_cells", chain(
    step(1, "c_mktsegment IN ('AUTOMOBILE', 'BUILDING')", "equal", "1000000.0::DOUBLE"),
    step(2, "l_returnflag IN ('R', 'A')", "scale_equal", "1.1::DOUBLE"),
    step(3, HIT, "spread", "(-2000000.0::DOUBLE)"),
    step(4, "c_mktsegment = 'MACHINERY'", "scale", "0.5::DOUBLE"),
    step(5, "l_returnflag = 'N' AND period BETWEEN '1996-03' AND '1998-02'", "equal", "300000.0::DOUBLE"),
    step(6, "c_mktsegment IN ('MACHINERY', 'BUILDING')", "spread", "700000.0::DOUBLE"),
    step(7, "c_mktsegment IN ('FURNITURE', 'BUILDING')", "scale_equal", "1.02::DOUBLE")))
def rules_many_cells(spark, sf):
    return by_period(apply_rules(rows(spark, sf), MANY, V, max_cells=10))


SCREEN = [
    {"type": "offset", "offset": 250000, "filters": BUILDING, **YEAR_1997},
    {"type": "multiplier", "factor": 1.03, "filters": {"l_returnflag": ["R"]}},
    {"type": "multiplier", "factor": 1.07, "distribution": "equal", "filters": {"c_mktsegment": ["BUILDING", "MACHINERY"]}, **YEAR_1997},
    {"type": "offset", "offset": -90000, "distribution": "equal", "filters": {"c_mktsegment": ["BUILDING"]}, "periodFrom": "1997-04"},
    {"type": "offset", "offset": 440000, "filters": {"l_returnflag": ["R", "N"]}},
    {"type": "multiplier", "factor": 0.97, "distribution": "equal"},
]


@query("ui_rules_chain", chain(
    step(1, HIT, "spread", "250000.0::DOUBLE", True),
    step(2, "l_returnflag = 'R'", "scale", "1.03::DOUBLE", True),
    step(3, "c_mktsegment IN ('BUILDING', 'MACHINERY') AND period BETWEEN '1997-01' AND '1997-12'", "scale_equal_screen", "1.07::DOUBLE", True, "12.0::DOUBLE"),
    step(4, "c_mktsegment = 'BUILDING' AND period >= '1997-04'", "equal", "(-90000.0::DOUBLE)", True),
    step(5, "l_returnflag IN ('R', 'N')", "spread", "440000.0::DOUBLE", True),
    step(6, "1 = 1", "scale_equal_screen", "0.97::DOUBLE", True)))
def ui_rules_chain(spark, sf):
    return by_period(apply_rules(rows(spark, sf), SCREEN, V, mode="screen"))


@query("rule_preview", f"""WITH {BASE}, t AS (
    SELECT COUNT(*) AS n, COUNT(*) FILTER (c_mktsegment = 'BUILDING') AS n1, COUNT(*) FILTER ({HIT}) AS n2,
           {exact("CASE WHEN c_mktsegment = 'BUILDING' THEN v END")} AS s1 FROM r0)
    SELECT 1 AS rule_no, 'up' AS name, 'multiplier' AS type, n1 AS affected_rows, n AS total_rows,
           {rounded('CAST(s1 AS DECIMAL(30,6)) * 0.05')} AS estimated_delta, NULL AS warning FROM t
    UNION ALL SELECT 2, 'year', 'offset', n2, n, 5000.0, NULL FROM t
    UNION ALL SELECT 3, 'none', 'multiplier', 0, n, 0.0, 'no rows matched' FROM t
    UNION ALL SELECT 4, 'all', 'offset', n, n, -10.0, 'no filter: rule applies to all rows' FROM t""")
def rule_preview(spark, sf):
    return preview_rules(rows(spark, sf), [
        Rule("up", factor=1.05, filters=BUILDING),
        {"name": "year", "type": "offset", "offset": 5000, "filters": BUILDING, **YEAR_1997},
        Rule("none", factor=1.1, filters={"c_mktsegment": ["NOWHERE"]}),
        Rule("all", type="offset", offset=-10.0),
    ], V)
