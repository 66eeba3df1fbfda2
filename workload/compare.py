from __future__ import annotations

from planspark import (
    apply_rules, chart_series, comparison, comparison_pivot, compute_scenario, compute_scenarios, variance, variance_totals, waterfall,
    waterfall_screen,
)
from .registry import SALES, cents, exact, query, rounded, sales
from .rules import BUILDING, V, YEAR_1997
from .scenario import CUT, GROWTH, GROWTH_SQL, dated

PRICE = {"name": "price", "type": "multiplier", "factor": 1.05, "filters": BUILDING, **YEAR_1997}
PRICED = f"""{SALES}, x AS (SELECT *, {V} AS b,
    CASE WHEN c_mktsegment = 'BUILDING' AND period BETWEEN '1997-01' AND '1997-12' THEN {V} * 1.05::DOUBLE ELSE {V} END AS s FROM sales)"""


def figures(a, s):
    return f"""{rounded(a)} AS actual, {rounded(s)} AS scenario, {rounded(f'{s} - {a}')} AS delta,
           CASE WHEN {a} <> 0 THEN ROUND(ROUND(CAST({s} - {a} AS DOUBLE) / abs(CAST({a} AS DOUBLE)) * 100, 6), 2) END AS delta_pct"""


@query("variance", f"""WITH {PRICED}, g AS (SELECT period, {exact('b')} AS a, {exact('s')} AS s FROM x GROUP BY 1)
    SELECT period, {figures('a', 's')} FROM g""")
def variance_(spark, sf):
    changed = apply_rules(sales(spark, sf, "period", "c_mktsegment", V), [PRICE], V)
    return variance(None, changed, ["period"], V)


@query("variance_totals", f"""WITH {GROWTH_SQL}, g AS (
    SELECT (SELECT {exact('v')} FROM r0) AS a, (SELECT {exact('v')} FROM r2) AS s)
    SELECT actual AS total_actual, scenario AS total_scenario, delta AS total_delta, delta_pct AS total_delta_pct
    FROM (SELECT {figures('a', 's')} FROM g)""")
def variance_totals_(spark, sf):
    rows = dated(spark, sf)
    return variance_totals(rows, compute_scenario(rows, GROWTH, value=V), V, compare_to="baseline")


WATERFALL_RULES = [
    {"type": "multiplier", "factor": 1.05, "filters": BUILDING},
    {"type": "multiplier", "factor": 0.96, "filters": {"c_mktsegment": ["MACHINERY", "HOUSEHOLD"]}},
    {"type": "offset", "offset": 20, "filters": {"c_mktsegment": ["FURNITURE"]}},
]
WATERFALL_SQL = f"""{SALES}, f AS (SELECT {exact(V)} AS t FROM sales WHERE c_mktsegment = 'FURNITURE'),
    x AS (SELECT c_mktsegment, n_name, {V} AS b, CASE WHEN c_mktsegment = 'BUILDING' THEN {V} * 1.05::DOUBLE
              WHEN c_mktsegment IN ('MACHINERY', 'HOUSEHOLD') THEN {V} * 0.96::DOUBLE
              WHEN c_mktsegment = 'FURNITURE' THEN {V} + abs({V}) / CAST(t AS DOUBLE) * 20.0::DOUBLE ELSE {V} END AS s FROM sales, f)"""


def _changed(spark, sf):
    rows = sales(spark, sf, "c_mktsegment", "n_name", V)
    return rows, apply_rules(rows, WATERFALL_RULES, V)


@query("waterfall_server", f"""WITH {WATERFALL_SQL},
    t AS (SELECT {exact('b')} AS a, {exact('s')} AS s FROM x),
    g AS (SELECT c_mktsegment AS name, {exact('s')} - {exact('b')} AS d FROM x GROUP BY 1),
    k AS (SELECT name, d FROM g, t WHERE abs(d) > greatest(abs(a) * 0.0001, 1.0)),
    o AS (SELECT *, row_number() OVER (ORDER BY d DESC, name) AS i, SUM(d) OVER (ORDER BY d DESC, name) AS run FROM k)
    SELECT 1 AS pos, 'Actuals' AS name, {rounded('a')} AS value, {rounded('a')} AS running_total, TRUE AS is_total FROM t
    UNION ALL SELECT i + 1, name, {rounded('d')}, {rounded('a + run')}, FALSE FROM o, t
    UNION ALL SELECT (SELECT COUNT(*) FROM k) + 2, 'Scenario', {rounded('s')}, {rounded('s')}, TRUE FROM t""")
def waterfall_server(spark, sf):
    rows, changed = _changed(spark, sf)
    return waterfall(rows, changed, "c_mktsegment", V)


@query("waterfall_ui", f"""WITH {WATERFALL_SQL},
    t AS (SELECT {exact('b')} AS a, {exact('s')} AS s FROM x),
    g AS (SELECT COALESCE(n_name, 'Other') AS name, {exact('s')} - {exact('b')} AS d FROM x GROUP BY 1),
    k AS (SELECT name, d, row_number() OVER (ORDER BY abs(d) DESC, name) AS i FROM g WHERE abs(d) > 0.01),
    bars AS (SELECT i, name, d FROM k WHERE i <= 15
             UNION ALL SELECT 16, 'Other', SUM(d) FROM k WHERE i > 15 HAVING abs(SUM(d)) > 0.01),
    o AS (SELECT *, SUM(d) OVER (ORDER BY i) AS run FROM bars)
    SELECT 1 AS pos, 'Actuals' AS name, {rounded('a')} AS value, 0.0::DOUBLE AS delta, 0.0::DOUBLE AS bottom, TRUE AS is_total FROM t
    UNION ALL SELECT i + 1, name, {rounded('abs(d)')}, {rounded('d')}, {rounded('a + least(run - d, run)')}, FALSE FROM o, t
    UNION ALL SELECT (SELECT COUNT(*) FROM bars) + 2, 'Scenario', {rounded('s')}, 0.0, 0.0, TRUE FROM t""")
def waterfall_ui(spark, sf):
    rows, changed = _changed(spark, sf)
    return cents(waterfall_screen(rows, changed, "n_name", V), "value", "delta", "bottom")


COMPARED = f"""{GROWTH_SQL}, r3 AS (SELECT period, c_mktsegment, l_returnflag,
        CASE WHEN c_mktsegment = 'MACHINERY' THEN v * 0.9375::DOUBLE ELSE v END AS v FROM r2),
    u AS (SELECT period, c_mktsegment, v AS a, NULL::DOUBLE AS g, NULL::DOUBLE AS c FROM r0
          UNION ALL SELECT period, c_mktsegment, NULL, v, NULL FROM r2
          UNION ALL SELECT period, c_mktsegment, NULL, NULL, v FROM r3)"""


def _scenarios(spark, sf):
    rows = dated(spark, sf)
    return rows, compute_scenarios(rows, [GROWTH, CUT], V)


@query("comparison", f"""WITH {COMPARED}, k AS (SELECT period, {exact('a')} AS a, {exact('g')} AS g, {exact('c')} AS c FROM u GROUP BY 1)
    SELECT period, {rounded('a')} AS actual, {rounded('g')} AS "sc_Growth", {rounded('c')} AS "sc_Cut",
           {rounded('g - a')} AS "var_Growth", {rounded('c - a')} AS "var_Cut" FROM k""")
def comparison_(spark, sf):
    rows, outputs = _scenarios(spark, sf)
    got = comparison(rows, outputs, ["period"], V)
    return cents(got, *[c for c in got.columns if c != "period"])


def _pivot_sql():
    segments, cells = ("AUTOMOBILE", "BUILDING"), []
    for k in segments:
        a, g, c = (exact(f"CASE WHEN c_mktsegment = '{k}' THEN {x} END") for x in "agc")
        cells += [f'{rounded(a)} AS "act_{k}"', f'{rounded(g)} AS "sc_Growth_{k}"', f'{rounded(c)} AS "sc_Cut_{k}"',
                  f'{rounded(f"{g} - {a}")} AS "var_Growth_{k}"', f'{rounded(f"{c} - {a}")} AS "var_Cut_{k}"']
    a, g, c = (exact(x) for x in "agc")
    cells += [f'{rounded(a)} AS _total', f'{rounded(g)} AS "sc_Growth"', f'{rounded(c)} AS "sc_Cut"',
              f'{rounded(f"{g} - {a}")} AS "var_Growth"', f'{rounded(f"{c} - {a}")} AS "var_Cut"']
    return f"WITH {COMPARED} SELECT period, {', '.join(cells)} FROM u GROUP BY 1"


@query("comparison_pivot", _pivot_sql())
def comparison_pivot_(spark, sf):
    rows, outputs = _scenarios(spark, sf)
    got = comparison_pivot(rows, outputs, ["period"], "c_mktsegment", V, values=["AUTOMOBILE", "BUILDING"])
    return cents(got, *[c for c in got.columns if c != "period"])


@query("chart_series", f"""WITH {COMPARED}, k AS (
        SELECT period, {exact('a')} AS a, {exact('g')} AS g, {exact('c')} AS c, COUNT(a) AS n FROM u GROUP BY 1)
    SELECT period AS label, period, {rounded('a')} AS "Actuals", {rounded('g')} AS "Growth", {rounded('c')} AS "Cut"
    FROM k WHERE n > 0 ORDER BY period LIMIT 25""")
def chart_series_(spark, sf):
    rows, outputs = _scenarios(spark, sf)
    got = chart_series(rows, outputs, ["period"], V)
    return cents(got, "Actuals", "Growth", "Cut")
