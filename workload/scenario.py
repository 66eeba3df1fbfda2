from __future__ import annotations

from pyspark.sql import functions as F

from planspark import (
    BaseConfig, comparison_base, compute_scenario, period_delta, project, project_future, project_seasonal,
    project_then_rules, scenario_periods, screen_base, screen_scenarios, select_base, variance_total,
)
from planspark.functions import precise_sum
from planspark.operators.projection import plan_seasonal
from .registry import SALES, cents, exact, money, query, rounded, sales
from .rules import BASE, BUILDING, V, by_period, rows, step


def dated(spark, sf):
    return sales(spark, sf, "period", "c_mktsegment", "l_returnflag", "l_shipdate", V)


IN_1997 = "WHERE period BETWEEN '1997-01' AND '1997-12'"
FUTURE = ("2002-01", "2002-02", "2002-03")
FUTURE_SQL = "(VALUES ('2002-01'), ('2002-02'), ('2002-03')) f(fp)"


@query("scenario_base_year", f"""WITH {SALES}
    SELECT period, c_mktsegment, COUNT(*) AS n, {money(V)} AS value FROM sales {IN_1997} GROUP BY 1, 2""")
def scenario_base_year(spark, sf):
    return by_period(select_base(dated(spark, sf), BaseConfig(base_year="1997", date_column="l_shipdate")))


@query("project_future", f"""WITH {BASE}, r1 AS (
    SELECT period, c_mktsegment, v, 'actual' AS source FROM r0 {IN_1997}
    UNION ALL SELECT fp, c_mktsegment, v, 'projected' FROM r0, {FUTURE_SQL} WHERE period = '1997-12')
    SELECT period, c_mktsegment, source, COUNT(*) AS n, {money('v')} AS value FROM r1 GROUP BY 1, 2, 3""")
def project_future_(spark, sf):
    base = select_base(dated(spark, sf), BaseConfig(base_year="1997", date_column="l_shipdate"))
    got = project_future(base, ["1997-12", *FUTURE]).withColumnRenamed("_data_source", "source")
    return by_period(got, ("period", "c_mktsegment", "source"))


GROWTH = {
    "id": "growth", "name": "Growth", "base_config": {"source": "actuals", "base_year": 1997, "date_column": "l_shipdate"},
    "rules": [
        {"name": "future", "type": "multiplier", "factor": 1.0625, "periodFrom": "2002-01", "periodTo": "2002-03"},
        {"name": "boost", "type": "offset", "offset": 90000, "filters": BUILDING, "periodFrom": "2002-02"},
    ],
}
CUT = {
    "id": "cut", "name": "Cut", "base_config": {"source": "scenario", "source_scenario_id": "growth"},
    "rules": [{"name": "cut", "type": "multiplier", "factor": 0.9375, "filters": {"c_mktsegment": ["MACHINERY"]}}],
}
GROWTH_SQL = f"""{BASE}, e0 AS (
    SELECT period, c_mktsegment, l_returnflag, v, v AS b, 'actual' AS source FROM r0 {IN_1997}
    UNION ALL SELECT fp, c_mktsegment, l_returnflag, v, v, 'projected' FROM r0, {FUTURE_SQL} WHERE period = '1997-12'),
    """ + step(1, "period BETWEEN '2002-01' AND '2002-03'", "scale", "1.0625::DOUBLE").replace("FROM r0)", "FROM e0)") + ", " + step(
    2, "c_mktsegment = 'BUILDING' AND period >= '2002-02'", "spread", "90000.0::DOUBLE")


@query("scenario_output", f"""WITH {GROWTH_SQL}
    SELECT period, c_mktsegment, source, COUNT(*) AS n, {money('v')} AS value, {money('b')} AS baseline
    FROM r2 GROUP BY 1, 2, 3""")
def scenario_output(spark, sf):
    got = compute_scenario(dated(spark, sf), GROWTH, value=V).groupBy("period", "c_mktsegment", F.col("_data_source").alias("source")).agg(
        F.count(F.lit(1)).alias("n"), precise_sum(F.col(V)).alias("value"), precise_sum(F.col(f"baseline_{V}")).alias("baseline"))
    return cents(got, "value", "baseline")


@query("scenario_chained", f"""WITH {GROWTH_SQL}, {step(3, "c_mktsegment = 'MACHINERY'", 'scale', '0.9375::DOUBLE')}
    SELECT period, c_mktsegment, COUNT(*) AS n, {money('v')} AS value FROM r3 GROUP BY 1, 2""")
def scenario_chained(spark, sf):
    return by_period(compute_scenario(dated(spark, sf), CUT, [GROWTH, CUT], V))


@query("scenario_periods", f"""WITH {GROWTH_SQL}
    SELECT source AS data_source, period, COUNT(*) AS rows FROM r2 GROUP BY 1, 2""")
def scenario_periods_(spark, sf):
    return scenario_periods(compute_scenario(dated(spark, sf), GROWTH, value=V))


@query("project_copy_year", f"""WITH {BASE}
    SELECT '2003' || substr(period, 5) AS period, c_mktsegment, COUNT(*) AS n, {money('v * 1.0625::DOUBLE')} AS value
    FROM r0 WHERE starts_with(period, '1997') GROUP BY 1, 2""")
def project_copy_year(spark, sf):
    spec = {"method": "copy_year", "source_year": 1997, "target_year": 2003, "growth_pct": 6.25}
    return by_period(project(rows(spark, sf), spec, V))


def _average_sql(where, periods, growth):
    return f"""WITH {BASE}, a AS (
    SELECT c_mktsegment, l_returnflag, CAST({exact('v')} AS DOUBLE) / COUNT(v) * {growth}::DOUBLE AS v FROM r0 {where} GROUP BY 1, 2)
    SELECT fp AS period, c_mktsegment, l_returnflag, {rounded('CAST(v AS DECIMAL(28,10))')} AS value FROM a, (VALUES {periods}) f(fp)"""


@query("project_average", _average_sql("", "('2003-01'), ('2003-02')", "1.1"))
def project_average(spark, sf):
    spec = {"method": "average", "growth_pct": 10, "target_periods": ["2003-01", "2003-02"]}
    got = project(rows(spark, sf), spec, V).select("period", "c_mktsegment", "l_returnflag", F.col(V).alias("value"))
    return cents(got, "value")


@query("project_last_n", f"""WITH {BASE}, last AS (SELECT DISTINCT period FROM r0 ORDER BY 1 DESC LIMIT 3),
    a AS (SELECT c_mktsegment, l_returnflag, CAST({exact('v')} AS DOUBLE) / COUNT(v) AS v FROM r0
          WHERE period IN (SELECT period FROM last) GROUP BY 1, 2),
    f AS (SELECT strftime(strptime((SELECT max(period) FROM r0) || '-01', '%Y-%m-%d') + to_months(CAST(k AS INTEGER)), '%Y-%m') AS fp
          FROM range(1, 13) t(k))
    SELECT fp AS period, c_mktsegment, l_returnflag, {rounded('CAST(v AS DECIMAL(28,10))')} AS value FROM a, f""")
def project_last_n(spark, sf):
    got = project(rows(spark, sf), {"method": "last_n_months", "last_n": 3}, V)
    return cents(got.select("period", "c_mktsegment", "l_returnflag", F.col(V).alias("value")), "value")


@query("project_then_rules", f"""WITH {BASE}, e0 AS (
    SELECT period, c_mktsegment, l_returnflag, v, 'actual' AS source FROM r0
    UNION ALL SELECT '2003' || substr(period, 5), c_mktsegment, l_returnflag, v * 1.0625::DOUBLE, 'projected'
    FROM r0 WHERE starts_with(period, '1997')),
    {step(1, "c_mktsegment = 'BUILDING' AND period >= '2003-06'", 'spread', '75000.0::DOUBLE').replace('FROM r0)', 'FROM e0)')}
    SELECT period, c_mktsegment, source, COUNT(*) AS n, {money('v')} AS value FROM r1 GROUP BY 1, 2, 3""")
def project_then_rules_(spark, sf):
    spec = {"method": "copy_year", "source_year": 1997, "target_year": 2003, "growth_pct": 6.25}
    rule = {"type": "offset", "offset": 75000, "filters": BUILDING, "periodFrom": "2003-06"}
    got = project_then_rules(rows(spark, sf), spec, [rule], V).withColumnRenamed("_data_source", "source")
    return by_period(got, ("period", "c_mktsegment", "source"))


# --- screen semantics --------------------------------------------------------------------------------------

NO_FEB = "period <> '1997-02'"
SEASONAL_SQL = f"""{BASE}, y AS (SELECT period, c_mktsegment, l_returnflag, v FROM r0 {IN_1997} AND {NO_FEB}),
    e0 AS (SELECT *, NULL AS tpl FROM y
    UNION ALL SELECT '2002-01', c_mktsegment, l_returnflag, v, '1997-01' FROM y WHERE period = '1997-01'
    UNION ALL SELECT DISTINCT '2002-02', c_mktsegment, l_returnflag, 0.0::DOUBLE, '_averaged' FROM y
    UNION ALL SELECT '2002-03', c_mktsegment, l_returnflag, v, '1997-03' FROM y WHERE period = '1997-03')"""
SEASON = {
    "id": "season", "name": "Season", "base_config": {"base_year": 1997, "date_column": "l_shipdate"},
    "rules": [
        {"type": "multiplier", "factor": 1.0375, "periodFrom": "2002-01", "periodTo": "2002-03"},
        {"type": "offset", "offset": 60000, "distribution": "equal", "filters": BUILDING, "periodFrom": "2002-01", "periodTo": "2002-03"},
        {"type": "multiplier", "factor": 1.0625, "filters": {"c_mktsegment": ["MACHINERY"]}, "periodFrom": "1997-03", "periodTo": "1997-05"},
    ],
}
SEASON_RULES = step(1, "period BETWEEN '2002-01' AND '2002-03'", "scale", "1.0375::DOUBLE", True).replace("FROM r0)", "FROM e0)") + ", " + step(
    2, "c_mktsegment = 'BUILDING' AND period BETWEEN '2002-01' AND '2002-03'", "equal", "60000.0::DOUBLE", True, "3.0::DOUBLE") + ", " + step(
    3, "c_mktsegment = 'MACHINERY' AND period BETWEEN '1997-03' AND '1997-05'", "scale", "1.0625::DOUBLE", True)


def _season_rows(spark, sf):
    return dated(spark, sf).filter(F.col("period") != "1997-02")


@query("ui_scenario_base", f"""WITH {BASE}
    SELECT period, c_mktsegment, COUNT(*) AS n, {money('v')} AS value FROM r0
    {IN_1997} AND l_returnflag IN ('A', 'R') GROUP BY 1, 2""")
def ui_scenario_base(spark, sf):
    filters = {"l_returnflag": ["A", "R"], "period": ["1997-01"], "c_mktsegment": []}
    return by_period(screen_base(dated(spark, sf), {"base_year": 1997, "date_column": "l_shipdate"}, filters))


@query("project_seasonal", f"""WITH {SEASONAL_SQL}
    SELECT period, c_mktsegment, COALESCE(tpl, '-') AS template, COUNT(*) AS n, {money('v')} AS value FROM e0 GROUP BY 1, 2, 3""")
def project_seasonal_(spark, sf):
    base = screen_base(_season_rows(spark, sf), {"base_year": 1997})
    got = project_seasonal(base, list(FUTURE), "1997", V).withColumn("template", F.coalesce("_baseline_period", F.lit("-")))
    return by_period(got, ("period", "c_mktsegment", "template"))


@query("ui_comparison_base", f"""WITH {SEASONAL_SQL}
    SELECT period, c_mktsegment, tpl IS NOT NULL AS shifted, COUNT(*) AS n, {money('v')} AS value FROM e0 GROUP BY 1, 2, 3""")
def ui_comparison_base(spark, sf):
    base = screen_base(_season_rows(spark, sf), {"base_year": 1997})
    plan = plan_seasonal(base, list(FUTURE), "1997", "period")
    got = comparison_base(base, plan, V).withColumn("shifted", F.coalesce("_is_comparison_base", F.lit(False)))
    return by_period(got, ("period", "c_mktsegment", "shifted"))


def _season(spark, sf):
    return screen_scenarios(_season_rows(spark, sf), [SEASON], value=V)["Season"]


@query("ui_variance_total", f"""WITH {SEASONAL_SQL}, {SEASON_RULES},
    t AS (SELECT (SELECT {exact('v')} FROM r3) AS s, (SELECT {exact('v')} FROM e0) AS b)
    SELECT {rounded('s')} AS total, {rounded('b')} AS base_total, {rounded('s - b')} AS variance,
           ROUND(CAST(s - b AS DOUBLE) / CAST(b AS DOUBLE) * 100, 6) AS pct FROM t""")
def ui_variance_total(spark, sf):
    season = _season(spark, sf)
    got = variance_total(season.base, season.scenario, V)
    return cents(got, "total", "base_total", "variance").withColumn("pct", F.round("pct", 6))


@query("ui_period_delta", f"""WITH {SEASONAL_SQL}, {SEASON_RULES},
    s AS (SELECT period, {exact('v')} AS s FROM r3 GROUP BY 1), b AS (SELECT period, {exact('v')} AS b FROM e0 GROUP BY 1)
    SELECT s.period, {rounded('s - b')} AS delta FROM s JOIN b ON s.period = b.period
    ORDER BY s.period LIMIT 6""")
def ui_period_delta(spark, sf):
    season = _season(spark, sf)
    return cents(period_delta(season.base, season.scenario, V), "delta")
