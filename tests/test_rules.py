"""Rules: worked examples, and random chains against a row-by-row simulation."""

import math
import random

import pytest
from pyspark.sql import functions as F

from planspark import Rule, apply_rules, preview_rules
from planspark.functions import month_range
from tests.conftest import rows

SHAPE = "id int, seg string, period string, amount double"


def frame(spark, values, shape=SHAPE):
    return spark.createDataFrame(values, shape)


def amounts(df):
    return [r["amount"] for r in df.orderBy("id").collect()]


def simulate(data, rules, mode):
    """Row-by-row application of rules to ``[id, seg, period, amount]`` lists."""
    data = [list(r) for r in data]
    cents = lambda x: math.floor(x * 100 + 0.5) / 100

    for rule in rules:
        def hit(r):
            for name, wanted in (rule.get("filters") or {}).items():
                if mode == "screen" and not wanted:
                    continue
                if r[{"id": 0, "seg": 1}[name]] not in wanted:
                    return False
            lo, hi, p = rule.get("periodFrom"), rule.get("periodTo"), r[2]
            if p is None:
                return mode == "screen" or not (lo or hi)
            return not (lo and p < lo) and not (hi and p[:len(hi)] > hi)

        m = [r for r in data if hit(r)]
        equal = rule.get("distribution") == "equal"
        total = math.fsum(abs(r[3] or 0.0) for r in m)
        periods = {}
        for r in m:
            periods[r[2]] = periods.get(r[2], 0) + 1
        n_periods = len(periods)
        if mode == "screen" and rule.get("periodFrom") and rule.get("periodTo"):
            n_periods = len(month_range(rule["periodFrom"], rule["periodTo"]))
        if rule["type"] == "offset" and rule["offset"] == 0 and mode == "server":
            continue
        new = []
        for r in m:
            v = r[3]
            if v is None and mode == "screen":
                v = 0.0
            if v is None:
                new.append(None)
                continue
            if rule["type"] == "multiplier" and not equal:
                v = v * rule["factor"]
            elif rule["type"] == "multiplier":
                delta = total * (rule["factor"] - 1)
                v += delta / len(m) if mode == "server" else delta / n_periods / periods[r[2]]
            elif equal:
                v += rule["offset"] / n_periods / periods[r[2]]
            else:
                v += rule["offset"] / len(m) if total == 0 else abs(v) / total * rule["offset"]
            new.append(cents(v) if mode == "screen" else v)
        for r, v in zip(m, new):
            r[3] = v
    return [r[3] for r in sorted(data, key=lambda r: r[0])]


def close(got, want, tolerance=1e-6):
    assert len(got) == len(want)
    for g, w in zip(got, want):
        if w is None:
            assert g is None
        else:
            assert g == pytest.approx(w, abs=tolerance, rel=1e-9)


THREE = [(1, "a", "2024-01", 100.0), (2, "a", "2024-01", -50.0), (3, "a", "2024-02", 50.0)]


@pytest.mark.parametrize("rule, want", [
    ({"type": "offset", "offset": 40}, [120.0, -40.0, 60.0]),
    ({"type": "multiplier", "factor": 1.1, "distribution": "equal"}, [100 + 20 / 3, -50 + 20 / 3, 50 + 20 / 3]),
    ({"type": "offset", "offset": 40, "distribution": "equal"}, [110.0, -40.0, 70.0]),
    ({"type": "multiplier", "factor": 2}, [200.0, -100.0, 100.0]),
    ({"type": "multiplier", "factor": 2, "periodFrom": "2024-02"}, [100.0, -50.0, 100.0]),
    ({"type": "offset", "offset": 40, "filters": {"seg": ["none"]}}, [100.0, -50.0, 50.0]),
    ({"type": "shift", "offset": 40}, [100.0, -50.0, 50.0]),
    ({"type": "multiplier", "factor": 2, "filters": {"missing": ["x"]}}, [200.0, -100.0, 100.0]),
])
def test_single_rule(spark, rule, want):
    got = apply_rules(frame(spark, THREE), [rule])
    close(amounts(got), want)
    assert [r["baseline_amount"] for r in got.orderBy("id").collect()] == [100.0, -50.0, 50.0]


def test_zero_base_is_spread_evenly(spark):
    zeros = [(1, "a", "2024-01", 0.0), (2, "a", "2024-02", 0.0), (3, "a", "2024-02", None)]
    got = apply_rules(frame(spark, zeros), [{"type": "offset", "offset": 9}])
    close(amounts(got), [3.0, 3.0, None])


def test_null_period_is_a_period(spark):
    data = [(1, "a", None, 10.0), (2, "a", "2024-01", 10.0), (3, "a", "2024-01", 10.0)]
    got = apply_rules(frame(spark, data), [{"type": "offset", "offset": 8, "distribution": "equal"}])
    close(amounts(got), [14.0, 12.0, 12.0])


def test_monthly_bound_keeps_the_days_of_the_month(spark):
    data = [(1, "a", "2024-12-31", 1.0), (2, "a", "2025-01-01", 1.0)]
    rule = {"type": "multiplier", "factor": 2, "periodTo": "2024-12"}
    close(amounts(apply_rules(frame(spark, data), [rule])), [2.0, 1.0])
    close(amounts(apply_rules(frame(spark, data), [rule], period_mode="lexical")), [1.0, 1.0])


def test_native_date_period(spark):
    df = frame(spark, [(1, "a", "2024-12-31", 1.0), (2, "a", "2025-01-01", 1.0)]).withColumn("period", F.to_date("period"))
    got = apply_rules(df, [{"type": "multiplier", "factor": 2, "periodFrom": "2024-12", "periodTo": "2024-12"}])
    close(amounts(got), [2.0, 1.0])


def test_numeric_filter_values_are_compared_as_numbers(spark):
    got = apply_rules(frame(spark, THREE), [{"type": "multiplier", "factor": 2, "filters": {"id": ["1", 3.0, "x"]}}])
    close(amounts(got), [200.0, -50.0, 100.0])


def test_filter_on_the_value_itself_sees_changed_values(spark):
    rules = [{"type": "multiplier", "factor": 2}, {"type": "offset", "offset": 30, "filters": {"amount": [200, 100]}}]
    close(amounts(apply_rules(frame(spark, THREE), rules)), [220.0, -100.0, 110.0])


def test_offset_that_crosses_zero_before_a_spread(spark):
    rules = [{"type": "offset", "offset": 180, "distribution": "equal"}, {"type": "offset", "offset": 100}]
    close(amounts(apply_rules(frame(spark, THREE), rules)), simulate(THREE, [dict(r, distribution=r.get("distribution")) for r in rules], "server"))


def test_text_measure_is_rejected(spark):
    with pytest.raises(ValueError, match="not numeric"):
        apply_rules(frame(spark, THREE), [], value="seg")


def test_missing_measure_changes_nothing(spark):
    df = frame(spark, THREE)
    assert apply_rules(df, [{"type": "multiplier", "factor": 2}], value="nope").columns == df.columns


def test_existing_baseline_is_kept(spark):
    df = frame(spark, THREE).withColumn("baseline_amount", F.lit(7.0))
    assert {r["baseline_amount"] for r in apply_rules(df, [{"type": "multiplier", "factor": 2}]).collect()} == {7.0}


def test_screen_without_period_column_is_one_period(spark):
    df = frame(spark, THREE).drop("period")
    rule = {"type": "offset", "offset": 30, "distribution": "equal"}
    close(amounts(apply_rules(df, [rule], mode="screen")), [110.0, -40.0, 60.0])


def random_case(rng):
    data = [
        (i, rng.choice("abc"), rng.choice(["2024-01", "2024-02", "2024-03", None]),
         rng.choice([None, 0.0, round(rng.uniform(-100, 100), 2), round(rng.uniform(0, 1000), 2)]))
        for i in range(40)
    ]
    rules = []
    for _ in range(rng.randint(1, 6)):
        rule = {"type": rng.choice(["multiplier", "offset"]), "distribution": rng.choice(["use_base", "equal"])}
        rule["factor" if rule["type"] == "multiplier" else "offset"] = (
            rng.choice([0.0, 0.5, 1.25, -1.5]) if rule["type"] == "multiplier" else rng.choice([0.0, 500.0, -321.5]))
        if rng.random() < 0.7:
            rule["filters"] = {"seg": rng.sample("abc", rng.randint(1, 2))}
        if rng.random() < 0.4:
            rule["periodFrom"] = rng.choice(["2024-01", "2024-02"])
        if rng.random() < 0.4:
            rule["periodTo"] = rng.choice(["2024-02", "2024-03"])
        rules.append(rule)
    return data, rules


@pytest.mark.parametrize("mode", ["server", "screen"])
@pytest.mark.parametrize("seed", range(8))
def test_random_chains(spark, seed, mode):
    data, rules = random_case(random.Random(seed))
    df = frame(spark, data).repartition(3)
    want = simulate(data, rules, mode)
    tolerance = 0.011 if mode == "screen" else 1e-6  # a half cent may round either way
    close(amounts(apply_rules(df, rules, mode=mode)), want, tolerance)


def counted(spark, data):
    """The rows, and how many of them have been read so far."""
    reads = spark.sparkContext.accumulator(0)

    def note(segment):
        reads.add(1)
        return segment

    seen = F.udf(note, "string").asNondeterministic()
    return frame(spark, data).withColumn("seg", seen("seg")), reads


SPREADING = [
    {"type": "offset", "offset": 900.0, "distribution": "equal"},
    {"type": "offset", "offset": -120.0, "filters": {"seg": ["a", "b"]}},
    {"type": "multiplier", "factor": 1.5, "distribution": "equal", "filters": {"seg": ["b", "c"]}},
    {"type": "offset", "offset": 300.0, "distribution": "equal", "periodFrom": "2024-02"},
    {"type": "multiplier", "factor": 0.8, "filters": {"seg": ["c"]}},
    {"type": "offset", "offset": 77.0, "filters": {"seg": ["c"]}},
    {"type": "multiplier", "factor": 0.9, "distribution": "equal"},
]


@pytest.mark.parametrize("mode,cells", [("server", 10), ("server", 50_000), ("screen", 10), ("screen", 50_000)])
def test_readings_do_not_grow_with_the_rules(spark, mode, cells):
    rng = random.Random(3)
    data = [(i, rng.choice("abc"), f"2024-{rng.randint(1, 6):02d}", round(rng.uniform(50, 900), 2)) for i in range(300)]
    df, reads = counted(spark, data)
    out = apply_rules(df, SPREADING, mode=mode, max_cells=cells)
    before = 2 if mode == "server" and cells == 10 else 1  # too many cells for the driver: seen by the first reading, stored by the second
    assert reads.value == before * len(data)
    got = [r["amount"] for r in sorted(out.collect(), key=lambda r: r["id"])]
    close(got, simulate(data, SPREADING, mode), 0.011 * len(SPREADING) if mode == "screen" else 1e-6)
    assert reads.value == (before + 1) * len(data)


def test_a_spread_across_zero_costs_one_more_reading(spark):
    rng = random.Random(4)
    data = [(i, rng.choice("abc"), f"2024-{rng.randint(1, 6):02d}", rng.uniform(-90, 90)) for i in range(200)]
    df, reads = counted(spark, data)
    out = apply_rules(df, SPREADING * 2)
    assert reads.value == 2 * len(data)
    close(amounts(out), simulate(data, SPREADING * 2, "server"))


@pytest.mark.parametrize("mode", ["server", "screen"])
@pytest.mark.parametrize("seed", range(3))
def test_stored_tables_replace_cells_when_there_are_too_many(spark, seed, mode):
    data, rules = random_case(random.Random(100 + seed))
    close(amounts(apply_rules(frame(spark, data), rules, mode=mode, max_cells=1)), simulate(data, rules, mode),
          0.011 if mode == "screen" else 1e-6)


@pytest.mark.parametrize("distribution", ["use_base", "equal"])
def test_the_whole_offset_is_distributed(spark, distribution):
    rng = random.Random(5)
    data = [(i, "a" if i % 3 else "b", f"2024-{rng.randint(1, 12):02d}", rng.uniform(-500, 500)) for i in range(200)]
    got = apply_rules(frame(spark, data), [{"type": "offset", "offset": 777.5, "distribution": distribution, "filters": {"seg": ["a"]}}])
    moved = got.agg(F.sum(F.col("amount") - F.col("baseline_amount"))).first()[0]
    assert moved == pytest.approx(777.5, abs=1e-6)


def test_rules_on_disjoint_rows_commute(spark):
    rules = [{"type": "offset", "offset": 50, "filters": {"seg": ["a"]}},
             {"type": "multiplier", "factor": 1.5, "distribution": "equal", "filters": {"seg": ["b"]}}]
    data = [(i, "ab"[i % 2], "2024-01", float(i)) for i in range(20)]
    one, two = (amounts(apply_rules(frame(spark, data), r)) for r in (rules, rules[::-1]))
    close(one, two)


def test_preview_counts_and_warns(spark):
    got = preview_rules(frame(spark, THREE), [
        Rule("half", factor=0.5, period_to="2024-01"), Rule("none", factor=2, filters={"seg": ["z"]}),
        Rule("all", type="offset", offset=5.0, filters={"seg": ["a"]}),
    ])
    assert rows(got, "rule_no") == [
        (1, "half", "multiplier", 2, 3, -25.0, None),
        (2, "none", "multiplier", 0, 3, 0.0, "no rows matched"),
        (3, "all", "offset", 3, 3, 5.0, "filter matched all rows"),
    ]


def test_legacy_preview_ignores_periods_and_takes_the_first_number(spark):
    got = preview_rules(frame(spark, THREE), [Rule("half", factor=0.5, period_to="2024-01")], legacy=True)
    assert rows(got)[0][3:6] == (3, 3, -3.0)
