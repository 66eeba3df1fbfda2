"""Projections, chained scenarios, screen scenarios."""

import pytest
from pyspark.sql import functions as F

from planspark import (
    ProjectionSpec, compute_scenario, period_delta, project, project_future, project_seasonal, project_then_rules,
    scenario_periods, scenario_with_projection, screen_scenarios, select_base, variance_total,
)
from planspark.functions import month_range, next_months
from tests.conftest import rows

SHAPE = "_row_id bigint, seg string, period string, amount double"
DATA = [(1, "a", "2024-11", 10.0), (2, "a", "2024-12", 20.0), (3, "b", "2024-12", 30.0), (4, "b", "2023-12", 5.0)]


@pytest.fixture
def base(spark):
    return spark.createDataFrame(DATA, SHAPE)


def test_month_ranges():
    assert month_range("2024-11", "2025-02") == ["2024-11", "2024-12", "2025-01", "2025-02"]
    assert month_range("bad", "2025-02") == [] and month_range("2025-02", "2025-01") == []
    assert len(month_range("2000-01", "2050-01")) == 601
    assert next_months("2024-11", 3) == ["2024-12", "2025-01", "2025-02"]


def test_future_periods_copy_the_last_month_and_take_rules(base):
    scenario = {"id": "s", "base_config": {"base_year": 2024}, "rules": [
        {"type": "multiplier", "factor": 2, "periodFrom": "2025-01", "periodTo": "2025-02"}]}
    got = compute_scenario(base, scenario).select("seg", "period", "amount", "baseline_amount", "_data_source", "_row_id")
    assert rows(got) == sorted([
        ("a", "2024-11", 10.0, 10.0, "actual", 1), ("a", "2024-12", 20.0, 20.0, "actual", 2),
        ("b", "2024-12", 30.0, 30.0, "actual", 3),
        ("a", "2025-01", 40.0, 20.0, "projected", None), ("b", "2025-01", 60.0, 30.0, "projected", None),
        ("a", "2025-02", 40.0, 20.0, "projected", None), ("b", "2025-02", 60.0, 30.0, "projected", None),
    ], key=repr)
    counted = scenario_periods(compute_scenario(base, scenario))
    assert rows(counted) == [("actual", "2024-11", 1), ("actual", "2024-12", 2), ("projected", "2025-01", 2), ("projected", "2025-02", 2)]


def test_months_that_exist_are_not_projected_also_at_day_grain(spark):
    days = spark.createDataFrame([(1, "a", "2024-12-30", 1.0), (2, "a", "2024-12-31", 2.0)], SHAPE)
    got = project_future(days, ["2024-12", "2025-01"])
    assert rows(got.select("period", "amount", "_data_source")) == [
        ("2024-12-30", 1.0, "actual"), ("2024-12-31", 2.0, "actual"),
        ("2025-01", 1.0, "projected"), ("2025-01", 2.0, "projected")]


def test_native_dates_become_text_when_months_are_projected(base):
    dated = base.withColumn("period", F.to_date(F.concat("period", F.lit("-05"))))
    scenario = {"id": "s", "base_config": {"base_year": 2024}, "rules": [{"type": "multiplier", "factor": 2, "periodFrom": "2025-01"}]}
    got = compute_scenario(dated, scenario).select("period", "amount")
    assert rows(got) == [("2024-11-05", 10.0), ("2024-12-05", 20.0), ("2024-12-05", 30.0), ("2025-01", 40.0), ("2025-01", 60.0)]


def test_empty_base_projects_nothing(base):
    got = compute_scenario(base, {"id": "s", "base_config": {"base_year": 1999}, "rules": [
        {"type": "offset", "offset": 5, "periodFrom": "2025-01"}]})
    assert got.count() == 0 and "_data_source" in got.columns


def test_chain_uses_the_other_output_and_keeps_the_first_baseline(base):
    first = {"id": "one", "base_config": {"base_year": 2024}, "rules": [{"type": "multiplier", "factor": 2}]}
    second = {"id": "two", "base_config": {"source": "scenario", "source_scenario_id": "one", "period_from": "2024-12"},
              "rules": [{"type": "multiplier", "factor": 10}]}
    got = compute_scenario(base, second, [first, second]).select("seg", "amount", "baseline_amount")
    assert rows(got) == [("a", 400.0, 20.0), ("b", 600.0, 30.0)]


def test_circular_chain_raises_naming_the_scenarios(base):
    loop = [{"id": i, "base_config": {"source": "scenario", "source_scenario_id": j}, "rules": [{"type": "multiplier", "factor": 2}]}
            for i, j in (("x", "y"), ("y", "x"))]
    with pytest.raises(ValueError, match="x -> y -> x"):
        compute_scenario(base, loop[0], loop)


def test_long_chain_starts_from_the_actuals(base):
    chain = [{"id": str(i), "base_config": {"source": "scenario", "source_scenario_id": str(i - 1)} if i else {},
              "rules": [{"type": "multiplier", "factor": 2}]} for i in range(8)]
    got = compute_scenario(base, chain[-1], chain)
    assert rows(got.filter("_row_id = 1").select("amount", "baseline_amount")) == [(2560.0, 10.0)]


def test_projection_reaches_every_month_of_a_long_range(base):
    got = compute_scenario(base, {"id": "s", "rules": [{"type": "offset", "offset": 1800, "distribution": "equal", "periodFrom": "2025-01", "periodTo": "2039-12"}]})
    assert got.filter("_data_source = 'projected'").select("period").distinct().count() == 180
    moved = got.filter("_data_source = 'projected'").selectExpr("sum(amount - baseline_amount) as s").first()[0]
    assert moved == pytest.approx(1800)


def test_screen_offset_over_a_long_range_is_conserved(spark):
    from planspark import apply_rules
    months = [f"{y}-{m:02d}" for y in range(2025, 2040) for m in range(1, 13)]
    data = spark.createDataFrame([(p, 100.0) for p in months], "period string, amount double")
    got = apply_rules(data, [{"type": "offset", "offset": 1800, "distribution": "equal", "periodFrom": months[0], "periodTo": months[-1]}], mode="screen")
    assert got.selectExpr("sum(amount)").first()[0] == pytest.approx(18_000 + 1_800)


def test_date_column_does_not_drop_projected_rows(spark):
    import datetime as dt
    data = spark.createDataFrame([("2024-12", dt.date(2024, 12, 5), 10.0, 1), ("2024-12", dt.date(2024, 12, 9), 20.0, 2)],
                                 "period string, day date, amount double, _row_id long")
    first = {"id": "a", "base_config": {"base_year": 2024, "date_column": "day"}, "rules": [{"type": "multiplier", "factor": 2, "periodFrom": "2025-01", "periodTo": "2025-01"}]}
    second = {"id": "b", "base_config": {"source": "scenario", "source_scenario_id": "a", "base_year": 2025, "date_column": "day"},
              "rules": [{"type": "multiplier", "factor": 3}]}
    got = compute_scenario(data, second, [first, second])
    assert rows(got.select("period", "amount")) == [("2025-01", 120.0), ("2025-01", 60.0)]


def test_unknown_source_falls_back_to_actuals(base):
    got = compute_scenario(base, {"id": "s", "base_config": {"source": "scenario", "source_scenario_id": "gone"}})
    assert got.count() == 4


def test_range_base(base):
    assert rows(select_base(base, {"period_from": "2024-12"}).select("_row_id")) == [(2,), (3,)]
    assert rows(select_base(base, {"period_to": "2023-12"}).select("_row_id")) == [(4,)]


def test_copy_year(base):
    got = project(base, {"method": "copy_year", "source_year": 2024, "target_year": 2026, "growth_pct": 50})
    assert rows(got.select("seg", "period", "amount", "_data_source")) == [
        ("a", "2026-11", 15.0, "projected"), ("a", "2026-12", 30.0, "projected"), ("b", "2026-12", 45.0, "projected")]
    assert "_row_id" not in got.columns


def test_average_over_all_and_over_the_last_periods(base):
    whole = project(base, ProjectionSpec(method="average", target_periods=("2025-01",)))
    assert rows(whole.select("seg", "period", "amount")) == [("a", "2025-01", 15.0), ("b", "2025-01", 17.5)]
    recent = project(base, ProjectionSpec(method="last_n_months", last_n=1))
    assert recent.count() == 24 and rows(recent.filter("period = '2025-12'").select("seg", "amount")) == [("a", 20.0), ("b", 30.0)]


def test_no_method_projects_nothing(base):
    assert project(base, {"method": "none"}) is None and project(base, {"method": "copy_year"}) is None
    with pytest.raises(ValueError):
        project(base, {"method": "magic"})


def test_projection_then_rules_covers_both(base):
    spec = {"method": "copy_year", "source_year": 2024, "target_year": 2025}
    got = project_then_rules(base, spec, [{"type": "multiplier", "factor": 2, "filters": {"seg": ["b"]}}])
    assert rows(got.filter("seg = 'b'").select("period", "amount", "_data_source")) == [
        ("2023-12", 10.0, "actual"), ("2024-12", 60.0, "actual"), ("2025-12", 60.0, "projected")]


def test_projection_settings_of_a_scenario_are_honoured(base):
    scenario = {"id": "s", "base_config": {"base_year": 2024}, "rules": []}
    spec = {"method": "copy_year", "source_year": 2024, "target_year": 2025, "growth_pct": 100}
    got = scenario_with_projection(base, scenario, spec)
    assert got.count() == 6 and got.agg(F.sum("amount")).first()[0] == 180.0


SCREEN = "seg string, period string, month string, month_name string, quarter string, amount double"
SCREEN_ROWS = [("a", "2024-01", "01", "January", "Q1 2024", 10.0), ("b", "2024-01", "01", "January", "Q1 2024", 20.0),
               ("a", "2024-03", "03", "March", "Q1 2024", 30.0), ("a", "2023-01", "01", "January", "Q1 2023", 99.0)]


@pytest.fixture
def screen(spark):
    return spark.createDataFrame(SCREEN_ROWS, SCREEN)


def test_seasonal_copies_the_month_or_gives_zero_rows(screen):
    base = screen.filter("period >= '2024-01'")
    got = project_seasonal(base, ["2025-01", "2025-02"], "2024").filter("_data_source = 'projected'")
    assert rows(got.select("seg", "period", "month", "month_name", "quarter", "amount", "_baseline_period")) == [
        ("a", "2025-01", "01", "January", "Q1 2025", 10.0, "2024-01"),
        ("a", "2025-02", "02", "February", "Q1 2025", 0.0, "_averaged"),
        ("b", "2025-01", "01", "January", "Q1 2025", 20.0, "2024-01"),
        ("b", "2025-02", "02", "February", "Q1 2025", 0.0, "_averaged"),
    ]


SEASON = {"id": "1", "name": "Plan", "base_config": {"base_year": 2024}, "rules": [
    {"type": "multiplier", "factor": 1.5, "periodFrom": "2025-01", "periodTo": "2025-02"}]}


def test_screen_scenario_and_its_comparison_base(screen):
    plan = screen_scenarios(screen, [SEASON])["Plan"]
    assert rows(plan.scenario.select("seg", "period", "amount")) == [
        ("a", "2024-01", 10.0), ("a", "2024-03", 30.0), ("a", "2025-01", 15.0), ("a", "2025-02", 0.0),
        ("b", "2024-01", 20.0), ("b", "2025-01", 30.0), ("b", "2025-02", 0.0)]
    assert rows(plan.base.select("seg", "period", "amount")) == [
        ("a", "2024-01", 10.0), ("a", "2024-03", 30.0), ("a", "2025-01", 10.0), ("a", "2025-02", 0.0),
        ("b", "2024-01", 20.0), ("b", "2025-01", 20.0), ("b", "2025-02", 0.0)]
    assert rows(variance_total(plan.base, plan.scenario)) == [(105.0, 90.0, 15.0, pytest.approx(100 / 6))]
    assert rows(period_delta(plan.base, plan.scenario), "period") == [
        ("2024-01", 0.0), ("2024-03", 0.0), ("2025-01", 15.0), ("2025-02", 0.0)]


def test_calendar_filters_only_choose_what_is_shown(screen):
    plan = screen_scenarios(screen, [SEASON], {"period": ["2025-01"], "seg": ["a"]})["Plan"]
    assert rows(plan.scenario.select("seg", "period", "amount")) == [("a", "2025-01", 15.0)]
    assert rows(plan.base.select("seg", "period", "amount")) == [("a", "2025-01", 10.0)]


def test_screen_chain_needs_the_source_first(screen):
    follow = {"id": "2", "name": "Follow", "base_config": {"source": "scenario", "source_scenario_id": "1", "base_year": 2024},
              "rules": [{"type": "multiplier", "factor": 2}]}
    in_order = screen_scenarios(screen, [SEASON, follow])["Follow"]
    assert in_order.scenario.agg(F.sum("amount")).first()[0] == 210.0
    assert in_order.base.agg(F.sum("amount")).first()[0] == 90.0
    reversed_ = screen_scenarios(screen, [follow, SEASON])["Follow"]
    assert reversed_.scenario.agg(F.sum("amount")).first()[0] == 120.0


def test_end_only_rule_adds_no_month_on_screen(screen):
    rule = {"type": "offset", "offset": 1, "periodTo": "2025-06"}
    plan = screen_scenarios(screen, [{"id": "1", "name": "P", "base_config": {"base_year": 2024}, "rules": [rule]}])["P"]
    assert plan.scenario.count() == 3


def test_zero_base_total_has_zero_percent(screen):
    none = screen.withColumn("amount", F.lit(0.0))
    assert rows(variance_total(none, screen).select("pct")) == [(0.0,)]
