"""Queries, pivots, comparisons, transformations, labels, metrics."""

import pytest
from pyspark.sql import functions as F

from planspark import (
    TableModel, aggregate_rule, apply_rules, apply_step, apply_steps, auto_labels_for, available_periods, build_all_baselines, calendar_dim,
    calendar_links, chart_series, comparison, comparison_pivot, comparison_totals, derive_period, detect_relationships,
    dimension_size, dimension_values, eval_metric, filter_values, first_per_key, glossary, grouping_values, join_dimension,
    mark_applied, metric_ratio, output_role, pivot_long, pivot_wide, preview_step, profile_columns, query_grouped, reject, relationship_coverage, run_query,
    screen_filter, sort_pivot, upsert_labels, value_column, variance, variance_totals, waterfall, waterfall_screen,
)
from planspark.operators.labels import describing_column
from planspark.operators.query import pivot_fields
from planspark.operators.relationships import CALENDAR
from planspark.plans.specs import QuerySpec, Relationship
from tests.conftest import rows


@pytest.fixture
def facts(spark):
    return spark.createDataFrame([
        ("a", "2024-01", 10.0, 1), ("a", "2024-02", None, 2), ("b", "2024-01", 5.0, 3), (None, "2024-02", -4.0, 4),
    ], "seg string, period string, amount double, n int")


# --- queries -------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("fn, want", [
    ("sum", [(None, -4.0), ("a", 10.0), ("b", 5.0)]), ("avg", [(None, -4.0), ("a", 10.0), ("b", 5.0)]),
    ("count", [(None, 1), ("a", 1), ("b", 1)]), ("min", [(None, -4.0), ("a", 10.0), ("b", 5.0)]),
])
def test_group_query(facts, fn, want):
    got = run_query(facts, {"group_by": ["seg"], "aggregations": {"amount": fn}, "order_by": [{"column": "seg"}]})
    assert [tuple(r) for r in got.collect()] == want


def test_sum_of_nothing_is_zero(facts):
    got = run_query(facts.filter("amount IS NULL"), {"group_by": ["seg"], "aggregations": {"amount": "sum"}})
    assert rows(got) == [("a", 0.0)]


def test_query_rules(facts):
    assert run_query(facts, {"group_by": ["seg"]}).count() == 4
    assert [r["seg"] for r in run_query(facts, {"order_by": [["seg", "desc"], ["n", "asc"]], "limit": 2}).collect()] == [None, "b"]
    assert run_query(facts, {"filters": {"n": ["1", 2.0], "seg": "a"}}).count() == 2
    for bad in ({"filters": {"zzz": 1}}, {"group_by": ["seg"], "aggregations": {"amount": "median"}},
                {"group_by": ["n"], "aggregations": {"n": "sum"}}):
        with pytest.raises(ValueError):
            run_query(facts, bad)
    assert run_query(facts, {"filters": {"zzz": 1}}, lenient=True).count() == 4
    with pytest.raises(ValueError):
        QuerySpec.of({"limit": 10_001}, max_limit=10_000)


def test_tool_query(facts):
    assert [tuple(r) for r in query_grouped(facts, ["seg"], "amount").collect()] == [("a", 10.0), ("b", 5.0), (None, -4.0)]
    assert [tuple(r) for r in query_grouped(facts, [], "amount", "max", {"seg": ["b"]}).collect()] == [(5.0,)]
    with pytest.raises(ValueError, match="numeric columns"):
        query_grouped(facts, [], "seg")


def test_screen_filter_and_small_lookups(facts):
    assert screen_filter(facts, {"seg": [], "n": [1, 3]}).count() == 2 and screen_filter(facts, {"gone": ["x"]}).count() == 0
    assert value_column(facts, "nope") == "amount" and value_column(facts.drop("amount"), "nope") == "n"
    assert rows(available_periods(facts)) == [("2024-01", "2024"), ("2024-02", "2024")]
    assert pivot_fields(facts.withColumn("baseline_amount", F.col("amount"))) == (["period", "seg"], ["amount", "n", "baseline_amount"])


def test_period_is_derived_from_the_first_dated_text(spark):
    df = spark.createDataFrame([("x", "2024-01-05", "2023-02"), ("x", "n", "2023-02-01"), (None, None, None)], "a string, b string, c string")
    assert [r["_period"] for r in derive_period(df).collect()] == ["2024-01", "2023-02", None]
    assert derive_period(df.withColumn("month_year", F.lit("2020-07"))).first()["_period"] == "2020-07"


# --- joins ---------------------------------------------------------------------------------------------------

def test_dimension_join_never_multiplies_rows(spark, facts):
    dim = spark.createDataFrame([(2, "a", "second"), (1, "a", "first"), (3, None, "no key")], "_row_id bigint, seg string, name string")
    got = join_dimension(facts, dim, "seg", "seg")
    assert got.columns == [*facts.columns, "name"]
    assert rows(got.select("n", "name")) == [(1, "first"), (2, "first"), (3, None), (4, None)]
    assert rows(first_per_key(dim.drop("_row_id"), "seg")) == [("a", "first")]


def test_keys_of_different_kinds_meet_as_text(spark, facts):
    dim = spark.createDataFrame([("1", "one"), ("3", "three")], "code string, name string")
    got = join_dimension(facts, dim, "n", "code")
    assert rows(got.select("n", "name")) == [(1, "one"), (2, None), (3, "three"), (4, None)] and dict(got.dtypes)["n"] == "int"


def test_coverage_and_detection(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z"), (3, None), (None, "w")], "k int, t string")
    b = spark.createDataFrame([(1.0, "q"), (2.0, "r"), (9.0, "s")], "k double, t string")
    assert rows(relationship_coverage(a, "k", b, "k")) == [(66, 2)]
    assert rows(relationship_coverage(a.filter("k > 5"), "k", b, "k")) == [(0, 0)]
    assert rows(detect_relationships({"a": a, "b": b})) == [("a", "b", "k", 66, 2)]
    assert rows(detect_relationships({"a": a.select("t"), "b": b.select("k")})) == []


def test_calendar(spark):
    cal = calendar_dim(spark)
    assert cal.count() == 2922
    assert rows(cal.filter("date = '2024-02-29'")) == [("2024-02-29", "2024-02", "2024", "02", "February", "Q1 2024")]
    df = spark.createDataFrame([("2024-01", "2024-01-05", "x"), ("2024-02", "2024-01-06", "y")], "month string, date string, t string")
    profile, _ = profile_columns(df)
    assert calendar_links("f", profile) == [Relationship("f", "month", CALENDAR, "month_year"), Relationship("f", "date", CALENDAR, "date")]
    assert calendar_links("f", profile, [Relationship("f", "month", CALENDAR, "month_year")]) == [Relationship("f", "date", CALENDAR, "date")]
    assert filter_values(df.withColumnRenamed("month", "period"), "period", cal).count() == 96
    assert [r[0] for r in filter_values(df, "t", cal).collect()] == ["x", "y"]


# --- pivots --------------------------------------------------------------------------------------------------

def test_pivots(facts):
    assert rows(pivot_long(facts, ["seg"], "period", "amount")) == sorted(
        [("a", "2024-01", 10.0), ("a", "2024-02", 0.0), ("b", "2024-01", 5.0), ("—", "2024-02", -4.0)], key=repr)
    wide = pivot_wide(facts, ["seg"], "period", "amount", totals=True)
    assert rows(wide) == sorted([("a", 10.0, 0.0, 10.0), ("b", 5.0, 0.0, 5.0), ("—", 0.0, -4.0, -4.0), ("Total", 15.0, -4.0, 11.0)], key=repr)
    part = pivot_wide(facts, ["seg"], "period", "amount", values=["2024-01"])
    assert rows(part.filter("seg = '—'")) == [("—", 0.0, -4.0)]


@pytest.mark.parametrize("mode, rowf, first", [("auto", "seg", "a"), ("auto", "period", "2024-01"), ("time_desc", "period", "2024-02"), ("value_desc", "period", "2024-01")])
def test_pivot_order(facts, mode, rowf, first):
    got = sort_pivot(pivot_long(facts, [rowf], None, "amount"), [rowf], "amount", mode)
    assert got.filter("pos = 1").first()[rowf] == first


def test_many_pivot_columns(spark):
    df = spark.range(600).select((F.col("id") % 3).cast("string").alias("r"), F.format_string("c%03d", F.col("id") % 150).alias("c"), F.lit(1.5).alias("v"))
    wide = pivot_wide(df, ["r"], "c", "v")
    assert len(wide.columns) == 152
    got = wide.filter("r = '1'").first()
    assert (got["c001"], got["c000"], got["_total"]) == (6.0, 0.0, 300.0)


# --- comparison ----------------------------------------------------------------------------------------------

def sides(spark):
    base = spark.createDataFrame([("a", 0.0), ("b", -200.0), (None, 10.0), ("c", 5.0)], "g string, amount double")
    new = spark.createDataFrame([("a", 5.0), ("b", -220.0), (None, 10.0), ("d", 7.0)], "g string, amount double")
    return base, new


def test_variance(spark):
    base, new = sides(spark)
    want = [("a", 0.0, 5.0, 5.0, None), ("b", -200.0, -220.0, -20.0, -10.0), (None, 10.0, 10.0, 0.0, 0.0),
            ("c", 5.0, 0.0, -5.0, -100.0), ("d", 0.0, 7.0, 7.0, None)]
    assert rows(variance(base, new, ["g", "missing"])) == sorted(want, key=repr)
    assert rows(variance_totals(base, new, compare_to="baseline")) == [(-185.0, -198.0, -13.0, -7.03)]
    changed = apply_rules(base, [{"type": "multiplier", "factor": 2, "filters": {"g": ["b"]}}])
    assert sum(r["delta"] for r in variance(None, changed, ["g"]).collect()) == variance_totals(None, changed).first()["total_delta"] == -200.0
    with pytest.raises(ValueError):
        variance(None, base, ["g"])


def test_server_waterfall(spark):
    base = spark.createDataFrame([("a", 4000.0), ("b", 3000.0), ("c", 2000.0), (None, 1000.0)], "g string, amount double")
    new = spark.createDataFrame([("a", 4001.0), ("b", 3002.0), ("c", 1990.0), (None, 1005.0)], "g string, amount double")
    got = [tuple(r) for r in waterfall(base, new, "g", compare_to="baseline").collect()]
    assert got == [(1, "Actuals", 10000.0, 10000.0, True), (2, None, 5.0, 10005.0, False), (3, "b", 2.0, 10007.0, False),
                   (4, "c", -10.0, 9997.0, False), (5, "Scenario", 9998.0, 9998.0, True)]
    assert waterfall(base, new, "gone").count() == 0


def test_screen_waterfall_sums_up_the_rest(spark):
    base = spark.createDataFrame([(f"g{i:02d}", 100.0) for i in range(20)] + [(None, 1.0)], "g string, amount double")
    new = base.withColumn("amount", F.when(F.col("g") == "g00", F.col("amount")).otherwise(F.col("amount") - F.coalesce(F.substring("g", 2, 2).cast("double"), F.lit(50.0))))
    got = [tuple(r) for r in waterfall_screen(base, new, "g", scenario_name="Plan").collect()]
    assert len(got) == 18 and got[0] == (1, "Actuals", 2001.0, 0.0, 0.0, True)
    assert got[1] == (2, "Other", 50.0, -50.0, 1951.0, False) and got[2][:4] == (3, "g19", 19.0, -19.0)
    assert got[16][1:4] == ("Other", 15.0, -15.0) and got[17] == (18, "Plan", 1761.0, 0.0, 0.0, True)


def test_comparison_tables(spark):
    base, new = sides(spark)
    got = comparison(base, {"S": new}, ["g"])
    assert rows(got.select("g", "actual", "sc_S", "var_S")) == sorted([
        ("a", 0.0, 5.0, 5.0), ("b", -200.0, -220.0, -20.0), ("—", 10.0, 10.0, 0.0), ("c", 5.0, 0.0, -5.0), ("d", 0.0, 7.0, 7.0)], key=repr)
    assert rows(comparison_totals(got, ["g"])) == [(-185.0, -198.0, -13.0)]
    chart = chart_series(base, {"S": new}, ["g"])
    assert [tuple(r) for r in chart.collect()] == [("—", "—", 10.0, 10.0), ("c", "c", 5.0, 0.0), ("a", "a", 0.0, 5.0), ("b", "b", -200.0, -220.0)]
    by = lambda df: df.withColumn("h", F.when(F.col("g") == "a", "x").when(F.col("g") == "b", "y"))
    wide = comparison_pivot(by(base), {"S": by(new)}, ["g"], "h").filter("g = 'b'").first()
    assert (wide["act_x"], wide["act_y"], wide["sc_S_y"], wide["var_S_y"], wide["_total"], wide["var_S"]) == (0.0, -200.0, -220.0, -20.0, -200.0, -20.0)


# --- transformations -----------------------------------------------------------------------------------------

def reclass(rules):
    return {"step_type": "reclassification", "source_column": "code", "output_column": "cls", "rules": rules}


@pytest.mark.parametrize("rules, want", [
    ([{"condition": {"op": "between", "values": ["400", "499"]}, "result": "A"}, {"default": "Z"}], ["A", "Z", "Z"]),
    ([{"condition": {"op": "like", "value": "4"}, "result": "A"}], ["Other"] * 3),
    ([{"default": None}, {"condition": {"op": "not_equals", "value": "45"}, "result": "B"}], ["Other", "B", "Other"]),
    ([{"default": "x"}, {"default": "y"}], ["y"] * 3),
])
def test_reclassification(spark, rules, want):
    df = spark.createDataFrame([(1, "45"), (2, "500"), (3, None)], "i int, code string")
    assert [r["cls"] for r in apply_step(df, reclass(rules)).orderBy("i").collect()] == want


@pytest.mark.parametrize("expression, want", [
    ({"op": "divide", "left": {"column": "a"}, "right": {"column": "b"}}, [None, 4.0, None]),
    ({"op": "add", "left": {"column": "a"}, "right": {"literal": 1}, "null_handling": "zero"}, [2.0, 3.0, 1.0]),
    ({"op": "add", "left": {"column": "a", "null_handling": "zero"}, "right": {"literal": 1}}, [2.0, 3.0, None]),
    ({"op": "round", "left": {"op": "negate", "left": {"literal": 2.345}}}, [-2.35] * 3),
])
def test_calculated_column(spark, expression, want):
    df = spark.createDataFrame([(1, "1", 0.0), (2, "2", 0.5), (3, "n/a", 1.0)], "i int, a string, b double")
    step = {"step_type": "calculated_column", "output_column": "r", "expression": expression}
    assert [r["r"] for r in apply_step(df, step).orderBy("i").collect()] == want


def test_steps_preview_and_errors(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "b", "x")], "i int, a string, b string")
    concat = {"step_type": "concat", "columns": ["a", "b", "i"], "separator": "-", "output_column": "c"}
    assert rows(apply_step(df, concat).select("c")) == [("a--1",), ("b-x-2",)]
    assert rows(apply_step(df, {**concat, "columns": []}).select("c")) == [("",), ("",)]
    seen = preview_step(df, concat)
    assert (seen.new_columns, seen.removed_columns, seen.affected_rows, seen.error) == (["c"], [], 2, None)
    assert rows(seen.new_column_stats["c"]) == [("a--1", 1), ("b-x-2", 1)]
    renamed = preview_step(df, {"step_type": "rename", "from_column": "a", "to_column": "z"})
    assert (renamed.new_columns, renamed.removed_columns) == (["z"], ["a"])
    assert preview_step(df, {"step_type": "pivot"}).error and preview_step(df, {**concat, "columns": ["q"]}).error
    done = apply_steps(df, [{**concat, "status": "applied"}, {**concat, "step_order": 1, "output_column": "d", "output_type": "integer", "columns": ["i"]}])
    assert done.columns == ["i", "a", "b", "d"] and dict(done.dtypes)["d"] == "bigint"


def test_step_status():
    steps = [{"status": "pending"}, {"status": "rejected"}, {}]
    assert [s["status"] for s in mark_applied(steps)] == ["applied", "rejected", "applied"]
    assert reject({"status": "pending"}) == {"status": "rejected"} and output_role({}) == "attribute"
    assert output_role({"output_type": "numeric"}) == "measure"
    with pytest.raises(ValueError):
        reject({"status": "applied"})


def test_all_baselines(spark, facts):
    dim = spark.createDataFrame([("a", "Alpha")], "seg string, name string")
    model = TableModel({"f": facts, "d": dim}, [Relationship("f", "seg", "d", "seg")])
    wide = build_all_baselines(model)
    assert sorted(wide) == ["d", "f"] and wide["f"].count() == 4 and wide["f"].columns[-1] == "name"


# --- labels and metrics --------------------------------------------------------------------------------------

LABEL = "column_name string, raw_value string, display_label string, category string"


def test_labels_from_a_dimension(spark):
    fact = spark.createDataFrame([(400, 1.5), (401, 2.5), (402, 3.25)], "konto int, amount double")
    dim = spark.createDataFrame([(400, "g1", "Staff"), (401, "g2", "Goods"), (402, "g1", None)], "konto int, gruppe string, bezeichnung string")
    profiles = {"f": profile_columns(fact)[0], "d": profile_columns(dim)[0]}
    known = spark.createDataFrame([("konto", "401", "old", None)], LABEL)
    link = Relationship("d", "konto", "f", "konto")
    assert describing_column(profiles["d"], "konto") == "bezeichnung"
    assert rows(auto_labels_for({"f": fact, "d": dim}, profiles, link, known)) == [("konto", "400", "Staff", None)]
    assert auto_labels_for({"f": fact, "d": dim}, {"f": profiles["f"], "d": profiles["f"]}, link) is None
    many = spark.createDataFrame([(i, f"v{i:02d}", "one") for i in range(12)], "k int, a string, b string")
    assert rows(grouping_values(many, "k")) == [("a", ", ".join(f"v{i:02d}" for i in range(10)) + "..."), ("b", "one")]


def test_label_upsert(spark):
    old = spark.createDataFrame([("c", "1", "one", "x"), ("c", "2", "two", None)], LABEL)
    new = spark.createDataFrame([("c", "1", "ONE", None, 1), ("c", "1", "One", None, 2), ("c", "3", None, "y", 1), ("c", "", "no", None, 1)], LABEL + ", seq int")
    assert rows(upsert_labels(old, new)) == [("c", "1", "One", "x"), ("c", "2", "two", None), ("c", "3", "3", "y")]


def test_dimension_values(spark, facts):
    labels = spark.createDataFrame([("seg", "a", "Alpha", ""), ("seg", "zz", "none", "c"), ("other", "b", "x", "y")], LABEL)
    assert [tuple(r) for r in dimension_values(facts, "seg", labels).collect()] == [("a", "Alpha", None), ("b", None, None)]
    assert [tuple(r) for r in dimension_values(facts, "seg", search="B").collect()] == [("b",)]
    assert dimension_values(facts, "seg", search=".").count() == 0
    assert [tuple(r) for r in dimension_values(facts, "n", top=2).collect()] == [("1",), ("2",)]
    assert rows(dimension_size(facts, "seg")) == [(3,)]


def test_glossary_order_and_first_phrase_wins(spark):
    labels = spark.createDataFrame([("c", str(i), f"l{i}", "Costs") for i in range(7)] + [("c", "9", "l", "")], LABEL)
    words = "seq int, column_name string, value string, term string"
    got = glossary(labels, spark.createDataFrame([(1, "c", "Konto")], "seq int, column_name string, synonym string"),
                   spark.createDataFrame([(1, "t", "v", "KONTO"), (2, "t", "", "empty")], words))
    assert [tuple(r) for r in got.collect()] == [
        (1, "konto", 't = "v"'), (2, "costs", "c IN ['0', '1', '2', '3', '4'...]")]


def test_metrics(spark, facts):
    other = spark.createDataFrame([("a", 4.0), ("z", 2.0), ("b", 0.0)], "seg string, hours double")
    parts = [{"source_table": "f", "value_column": "amount", "filters": [{"column": "period", "operator": "gte", "value": "2024-01"}]},
             {"source_table": "o", "value_column": "hours", "sign": "-", "aggregation": "sum"}]
    assert rows(eval_metric({"f": facts, "o": other}, parts)) == [(5.0,)]
    assert rows(eval_metric({"f": facts, "o": other}, parts, ["seg"])) == sorted([("a", 6.0), ("b", 5.0), (None, -4.0), ("z", -2.0)], key=repr)
    assert rows(metric_ratio(facts, "amount", other, "hours", ["seg"]).select("seg", "ratio")) == sorted(
        [("a", 2.5), ("b", None), (None, None), ("z", 0.0)], key=repr)
    rule = {"source_table": "f", "operation_config": {"group_by": ["seg"], "aggregations": {"amount": "max"},
            "filters": [{"column": "seg", "operator": "neq", "value": "a"}]}}
    assert rows(aggregate_rule({"f": facts}, rule)) == [("b", 5.0)]
    with pytest.raises(ValueError, match="unknown operator"):
        eval_metric({"f": facts}, [{**parts[0], "filters": [{"column": "n", "operator": "near", "value": 1}]}])
