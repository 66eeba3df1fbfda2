"""Reports from stored sums against the same reports made from the rows."""

import math
import random

import pytest
from pyspark.sql import functions as F

from planspark import (
    ReportSet, Rollups, apply_rules, chart_series, comparison, comparison_pivot, period_delta, pivot_long, pivot_wide, variance,
    variance_total, variance_totals, waterfall, waterfall_screen,
)
from tests.conftest import rows


def facts(spark, seed=1, number=400):
    rng = random.Random(seed)
    data = [(rng.choice(["a", "b", "c", None]), rng.choice(["x", "y", None]), f"2024-{rng.randint(1, 8):02d}",
             rng.choice([None, round(rng.uniform(-50, 400), 2), round(rng.uniform(-50, 400), 2)])) for _ in range(number)]
    return spark.createDataFrame(data, "seg string, region string, period string, amount double")


RULES = [{"type": "multiplier", "factor": 1.1, "filters": {"seg": ["a"]}}, {"type": "offset", "offset": 900.0, "filters": {"region": ["x"]}}]
GROUPINGS = [["seg", "region"], ["period", "seg"], ["period"]]


def near(got, want):
    got, want = rows(got), rows(want)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert [x for x in g if not isinstance(x, float)] == [x for x in w if not isinstance(x, float)]
        assert [x for x in g if isinstance(x, float)] == pytest.approx([x for x in w if isinstance(x, float)], abs=1e-6)


def test_every_report_equals_the_one_from_rows(spark):
    base = facts(spark)
    one, two = apply_rules(base, RULES), apply_rules(facts(spark, 2), RULES[:1])
    kept = ReportSet(base, {"One": one, "Two": two}, GROUPINGS)
    near(kept.variance(["seg"], "One"), variance(None, one, ["seg"]))
    near(kept.variance(["seg", "region"], "Two", "baseline"), variance(base, two, ["seg", "region"], compare_to="baseline"))
    near(kept.variance_totals("Two", "baseline"), variance_totals(base, two, compare_to="baseline"))
    near(kept.waterfall("region", "One"), waterfall(base, one, "region"))
    near(kept.waterfall_screen("seg", "Two"), waterfall_screen(base, two, "seg", scenario_name="Two"))
    near(kept.comparison(["seg"], "region"), comparison(base, {"One": one, "Two": two}, ["seg"], col="region"))
    near(kept.comparison_pivot(["seg"], "region"), comparison_pivot(base, {"One": one, "Two": two}, ["seg"], "region"))
    near(kept.chart_series(["period"]), chart_series(base, {"One": one, "Two": two}, ["period"]))
    near(kept.pivot_long(["seg"], "region", "One"), pivot_long(one, ["seg"], "region", "amount"))
    near(kept.pivot_wide(["region"], "seg", "Two", totals=True), pivot_wide(two, ["region"], "seg", "amount", totals=True))
    near(kept.variance_total("Two"), variance_total(base, two))
    near(kept.period_delta("One"), period_delta(base, one))
    with pytest.raises(ValueError):
        kept.variance(["seg"])


def test_own_base_comes_from_the_same_reading(spark):
    base = facts(spark, 3)
    changed = apply_rules(base, RULES)
    kept = ReportSet(None, {"One": changed}, GROUPINGS)
    near(kept.variance(["seg"]), variance(None, changed, ["seg"]))
    near(kept.comparison(["region"]), comparison(base, {"One": changed}, ["region"]))
    near(kept.waterfall_screen("seg"), waterfall_screen(base, changed, "seg"))
    with pytest.raises(ValueError):
        ReportSet(None, {"One": base}, GROUPINGS)


def test_rows_are_read_once_for_all_reports(spark):
    reads = spark.sparkContext.accumulator(0)

    def note(segment):
        reads.add(1)
        return segment

    base = facts(spark, 4).withColumn("seg", F.udf(note, "string").asNondeterministic()("seg"))
    kept = ReportSet(None, {"One": apply_rules(base, RULES[:1])}, GROUPINGS)
    for report in (kept.variance(["seg"]), kept.waterfall("region"), kept.comparison(["seg"], "region"), kept.pivot_wide(["period"], "seg"), kept.period_delta()):
        report.collect()
    assert reads.value == 400


def test_the_smallest_grouping_that_serves_is_read(spark):
    base = facts(spark, 5)
    kept = Rollups(base, ["amount"], GROUPINGS)
    assert [sorted(r.by) for r in kept.stored][-1] == ["period", "region", "seg"] and kept.stored == sorted(kept.stored, key=lambda r: r.rows)
    assert kept.smallest(["period"]).by == {"period"} and kept.smallest(["seg"]).by == {"seg", "region"}
    assert kept.smallest(["region", "period"]).by == {"period", "region", "seg"}
    assert kept.add(["region"]).by == {"region"} and kept.smallest(["region"]).rows == 3
    with pytest.raises(ValueError):
        Rollups(base, ["amount"], [["seg"]]).smallest(["period"])
    near(kept.means(["seg"], "amount"), base.groupBy("seg").agg(F.avg("amount").alias("amount")))
    filtered = kept.table(["seg"], filters={"region": ["x", "y"]}).groupBy("seg").agg(F.sum("amount").alias("amount"))
    near(filtered, base.filter("region IN ('x', 'y')").groupBy("seg").agg(F.sum("amount").alias("amount")))


def test_sums_of_empty_odd_and_missing_values(spark):
    odd = spark.createDataFrame([("a", None), ("a", None), ("b", math.nan), ("b", 1.0), ("c", 0.0)], "seg string, amount double")
    kept = Rollups(odd, ["amount"], [["seg", "nowhere"], []])
    assert {r.seg: r.amount for r in kept.table(["seg"], clean=True).collect()} == {"a": 0.0, "b": 1.0, "c": 0.0}
    plain = {r.seg: r.amount for r in kept.table(["seg"]).collect()}
    assert plain["a"] is None and math.isnan(plain["b"]) and plain["c"] == 0.0
    assert sorted(r.seg for r in kept.table(["seg"], having="amount").collect()) == ["b", "c"]
    empty = Rollups(odd.limit(0), ["amount"], [["seg"]])
    assert empty.table(["seg"]).count() == 0
    with pytest.raises(Exception):
        Rollups(odd, ["seg"], [["seg"]])
