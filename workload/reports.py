"""Reports answered from stored sums; their SQL is that of the reports made from the rows."""

from __future__ import annotations

from planspark import ReportSet, Rollups, apply_rules, compute_scenarios
from . import compare, pivots  # noqa: F401  the SQL of the single reports
from .compare import PRICE, WATERFALL_RULES
from .registry import ORACLES, SALES, cents, query, rounded, sales
from .rules import V
from .scenario import CUT, GROWTH, dated


def priced(spark, sf) -> ReportSet:
    """One scenario and its own base, from one reading of the rows."""
    rows = sales(spark, sf, "period", "c_mktsegment", "l_returnflag", "n_name", V)
    return ReportSet(None, {"Priced": apply_rules(rows, [PRICE], V)}, [["period", "c_mktsegment"], ["c_mktsegment", "l_returnflag"], ["n_name"]], V)


def compared(spark, sf) -> ReportSet:
    """Two chained scenarios next to the actuals."""
    rows = dated(spark, sf)
    return ReportSet(rows, compute_scenarios(rows, [GROWTH, CUT], V), [["period", "c_mktsegment"], ["period"]], V)


@query("report_set_variance", ORACLES["variance"])
def report_set_variance(spark, sf):
    return priced(spark, sf).variance(["period"])


@query("report_set_waterfall", ORACLES["waterfall_server"])
def report_set_waterfall(spark, sf):
    rows = sales(spark, sf, "c_mktsegment", "n_name", V)
    return ReportSet(None, {"Changed": apply_rules(rows, WATERFALL_RULES, V)}, [["c_mktsegment", "n_name"], ["c_mktsegment"]], V).waterfall("c_mktsegment")


@query("report_set_waterfall_ui", ORACLES["waterfall_ui"])
def report_set_waterfall_ui(spark, sf):
    rows = sales(spark, sf, "c_mktsegment", "n_name", V)
    found = ReportSet(None, {"Scenario": apply_rules(rows, WATERFALL_RULES, V)}, [["c_mktsegment", "n_name"]], V).waterfall_screen("n_name")
    return cents(found, "value", "delta", "bottom")


@query("report_set_comparison", ORACLES["comparison"])
def report_set_comparison(spark, sf):
    got = compared(spark, sf).comparison(["period"])
    return cents(got, *[c for c in got.columns if c != "period"])


@query("report_set_comparison_pivot", ORACLES["comparison_pivot"])
def report_set_comparison_pivot(spark, sf):
    got = compared(spark, sf).comparison_pivot(["period"], "c_mktsegment", ["AUTOMOBILE", "BUILDING"])
    return cents(got, *[c for c in got.columns if c != "period"])


@query("report_set_chart", ORACLES["chart_series"])
def report_set_chart(spark, sf):
    return cents(compared(spark, sf).chart_series(["period"]), "Actuals", "Growth", "Cut")


@query("report_set_pivot", ORACLES["pivot_totals"])
def report_set_pivot(spark, sf):
    rows = sales(spark, sf, "c_mktsegment", "l_returnflag", V)
    kept = ReportSet(rows, {"Same": rows}, [["c_mktsegment", "l_returnflag"]], V)
    got = kept.pivot_wide(["c_mktsegment"], "l_returnflag", totals=True)
    return cents(got, *[c for c in got.columns if c != "c_mktsegment"])


@query("rollup_means", f"""WITH {SALES}
    SELECT period, c_mktsegment, {rounded('CAST(SUM(CAST(l_extendedprice AS DECIMAL(28,10))) AS DOUBLE) / COUNT(l_extendedprice)')} AS l_extendedprice
    FROM sales WHERE l_returnflag IN ('A', 'R') GROUP BY 1, 2""")
def rollup_means(spark, sf):
    rows = sales(spark, sf, "period", "c_mktsegment", "l_returnflag", V).filter("l_returnflag IN ('A', 'R')")
    return cents(Rollups(rows, [V], [["period", "c_mktsegment", "l_returnflag"], ["period", "c_mktsegment"]]).means(["period", "c_mktsegment"], V), V)
