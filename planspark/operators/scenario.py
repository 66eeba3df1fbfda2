"""Scenarios: base rows, future periods and rules put together; chained scenarios."""

from __future__ import annotations

import logging
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..functions.values import clean_measure, column, day_text, dtype_of, find_period, period_between, precise_sum
from ..plans.specs import BaseConfig, ProjectionSpec, Scenario
from .projection import (
    comparison_base, last_period_and_missing, plan_seasonal, project_future, project_then_rules,
    seasonal_rows,
)
from .query import screen_filter
from .rules import apply_rules, screen_period

log = logging.getLogger(__name__)

# Filters on these columns choose what is shown, not what a scenario is computed from.
CALENDAR_FIELDS = (
    "year", "month", "quarter", "month_year", "month_name", "_period", "period", "_year", "_month", "_month_name",
)


def select_base(
    df: DataFrame, config: BaseConfig | Mapping | None, period: str | None = None, period_mode: str = "prefix"
) -> DataFrame:
    """Rows of the base year, or of the period range, at the grain of the bounds."""
    config, name = BaseConfig.of(config), period or find_period(df)
    start, end = config.bounds()
    if name is None or not (start or end):
        return df
    kept = df
    if config.date_column and "_data_source" not in df.columns:
        # Only rows straight from the actuals: projected rows keep the native date of the row they were copied from.
        kept = kept.filter(period_between(kept, config.date_column, start, end))
    return kept.filter(period_between(kept, name, start, end, period_mode))


def _by_id(scenarios: Iterable[Scenario | Mapping] | Mapping | None) -> dict[str, Scenario]:
    if isinstance(scenarios, Mapping):
        scenarios = [s if isinstance(s, Scenario) else {"id": k, **s} for k, s in scenarios.items()]
    return {s.id: s for s in map(Scenario.of, scenarios or ())}


def compute_scenario(
    base: DataFrame,
    scenario: Scenario | Mapping,
    scenarios: Iterable[Scenario | Mapping] | Mapping | None = None,
    value: str = "amount",
    period_mode: str = "prefix",
) -> DataFrame:
    """Scenario rows: chosen base, copies of its last month for future months named by rules, then the rules.

    A scenario may start from another one's output, through any number of links; a circle of links raises.
    Rows taken over from another scenario count as actual, also those it projected, and keep the
    ``baseline_<value>`` of the first scenario in the chain.
    """
    return _compute(base, Scenario.of(scenario), _by_id(scenarios), value, period_mode, (), {})


def compute_scenarios(
    base: DataFrame,
    scenarios: Sequence[Scenario | Mapping],
    value: str = "amount",
    period_mode: str = "prefix",
) -> dict[str, DataFrame]:
    """All scenarios by name. One that others start from is worked out once, so its totals are read once."""
    known, done = _by_id(scenarios), {}
    return {s.name: _compute(base, s, known, value, period_mode, (), done) for s in known.values()}


def _compute(actuals, scenario, known, value, period_mode, above, done):
    if scenario.id in above:
        raise ValueError(f"scenarios start from each other: {' -> '.join([*above[above.index(scenario.id):], scenario.id])}")
    if scenario.id in done:
        return done[scenario.id]
    config, rows = scenario.base, actuals
    if config.source == "scenario" and config.source_scenario_id in known:
        rows = _compute(actuals, known[config.source_scenario_id], known, value, period_mode, (*above, scenario.id), done)
    rows = select_base(rows, config, period_mode=period_mode)
    targets = sorted({m for rule in scenario.rules for m in rule.target_months()})
    output = apply_rules(project_future(rows, targets), scenario.rules, value, period_mode=period_mode)
    done[scenario.id] = output
    return output


def scenario_with_projection(
    actuals: DataFrame,
    scenario: Scenario | Mapping,
    projection: ProjectionSpec | Mapping | None,
    scenarios: Iterable[Scenario | Mapping] | Mapping | None = None,
    value: str = "amount",
) -> DataFrame:
    """Scenario whose future rows come from an explicit projection of its base rows."""
    scenario, known = Scenario.of(scenario), _by_id(scenarios)
    spec, rows = ProjectionSpec.of(projection), actuals
    if scenario.base.source == "scenario" and scenario.base.source_scenario_id in known:
        rows = _compute(actuals, known[scenario.base.source_scenario_id], known, value, "prefix", (scenario.id,), {})
    return project_then_rules(select_base(rows, scenario.base), spec, scenario.rules, value)


def scenario_periods(df: DataFrame) -> DataFrame:
    """Distinct periods by origin with their row counts: ``data_source, period, rows``."""
    name = find_period(df)
    if name is None or "_data_source" not in df.columns:
        raise ValueError("a scenario result with a period column is needed")
    period = day_text(column(name), dtype_of(df, name)).alias("period")
    counted = df.groupBy(F.col("_data_source").alias("data_source"), period).agg(F.count(F.lit(1)).alias("rows"))
    return counted.filter("period IS NOT NULL")


@dataclass(frozen=True)
class ScreenResult:
    """One scenario as the comparison screen shows it: its rows and the rows they are compared with."""

    scenario: DataFrame
    base: DataFrame


def screen_base(
    baseline: DataFrame,
    config: BaseConfig | Mapping | None,
    filters: Mapping[str, Sequence] | None = None,
    computed: Mapping[str, DataFrame] | None = None,
) -> DataFrame:
    """Base rows on screen: non-calendar filters, then base year or range (text comparison); a source scenario
    replaces them only when it was computed earlier."""
    config = BaseConfig.of(config)
    rows = screen_filter(baseline, {k: v for k, v in (filters or {}).items() if k not in CALENDAR_FIELDS})
    period = screen_period(rows)
    if period is not None:
        when = column(period)
        if config.base_year:
            rows = rows.filter(period_between(rows, config.date_column, *config.bounds())) if config.date_column and "_data_source" not in rows.columns else rows
            rows = rows.filter(F.coalesce(when.startswith(config.base_year), F.lit(False)))
        else:
            shown = F.coalesce(when, F.lit(""))
            if config.period_from:
                rows = rows.filter(shown >= config.period_from)
            if config.period_to:
                rows = rows.filter(shown <= config.period_to)
    if config.source == "scenario" and computed and config.source_scenario_id in computed:
        rows = computed[config.source_scenario_id]
    return rows


def screen_scenarios(
    baseline: DataFrame,
    scenarios: Sequence[Scenario | Mapping],
    filters: Mapping[str, Sequence] | None = None,
    value: str = "amount",
    dims: Sequence[str] | None = None,
) -> dict[str, ScreenResult]:
    """All scenarios in list order, keyed by name, each with its comparison base. ``dims`` as in :func:`project_seasonal`.

    A rule with only an end adds no future month here. All filters, calendar ones included, are applied last.
    """
    filters, computed, plans, results = dict(filters or {}), {}, {}, {}
    for scenario in map(Scenario.of, scenarios):
        config = scenario.base
        rows = screen_base(baseline, config, filters, computed)
        period = screen_period(rows)
        targets = sorted({m for rule in scenario.rules for m in rule.target_months(single_end=False)})
        plan = plan_seasonal(rows, targets, config.base_year, period) if period and targets else {}
        output = apply_rules(seasonal_rows(rows, plan, value, period, dims), scenario.rules, value, mode="screen")
        computed[scenario.id] = screen_filter(output, filters)
        chained = config.source == "scenario" and config.source_scenario_id in plans
        plans[scenario.id] = {**(plans[config.source_scenario_id] if chained else {}), **plan}

        own_year = BaseConfig(base_year=config.base_year, date_column=config.date_column)
        compared, shifted = screen_base(baseline, own_year, filters), plans[scenario.id]
        if shifted and (chained or not config.base_year):
            _, missing = last_period_and_missing(compared, list(shifted), period)
            shifted = {m: shifted[m] for m in missing}
        shown = screen_filter(comparison_base(compared, shifted, value, period, dims), filters)
        results[scenario.name] = ScreenResult(computed[scenario.id], shown)
    return results


def _sides(base: DataFrame, scenario: DataFrame, value: str, keys: Mapping) -> DataFrame:
    none = F.lit(None).cast("double")
    b, s = (clean_measure(column(value), dtype_of(df, value)) for df in (base, scenario))
    left = base.select(*[c.alias(k) for k, c in keys.items()], b.alias("_b"), none.alias("_s"))
    right = scenario.select(*[c.alias(k) for k, c in keys.items()], none.alias("_b"), s.alias("_s"))
    return left.unionByName(right)


def variance_total(base: DataFrame, scenario: DataFrame, value: str = "amount") -> DataFrame:
    """Scenario total, base total, variance and percentage (0 when the base is 0), unrounded."""
    sums = _sides(base, scenario, value, {}).agg(
        precise_sum(F.col("_s")).alias("total"), precise_sum(F.col("_b")).alias("base_total")
    )
    difference = F.col("total") - F.col("base_total")
    percent = F.coalesce(F.try_divide(difference, F.abs("base_total")) * 100, F.lit(0.0))
    return sums.select("total", "base_total", difference.alias("variance"), percent.alias("pct"))


def period_delta(base: DataFrame, scenario: DataFrame, value: str = "amount", first: int = 6) -> DataFrame:
    """Scenario minus base for the first periods of the scenario: ``period, delta``."""
    period = screen_period(scenario)
    keys = {"period": column(period)}
    grouped = _sides(base, scenario, value, keys).filter("period IS NOT NULL").groupBy("period").agg(
        (precise_sum(F.col("_s")) - precise_sum(F.col("_b"))).alias("delta"), F.count("_s").alias("_rows")
    )
    return grouped.filter("_rows > 0").drop("_rows").orderBy("period").limit(first)
