"""Scenario against actuals: variance, waterfalls, comparison tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.values import clean_measure, column, dtype_of, precise_sum, resolve, to_cents
from ..sources.shared import settle
from .ordering import with_running
from .pivot import column_keys, label, pivot_order

SHARE_OF_TOTAL = 0.0001  # fixed value: a waterfall bar must exceed this share of the total ...
SMALLEST_BAR = 1.0  # fixed value: ... and this amount
SCREEN_SMALLEST = 0.01  # fixed value: smallest change shown on screen
SCREEN_BARS = 15  # fixed value: bars on screen before the rest is summed up
CHART_ROWS = 25  # fixed value: points of a chart


def _sums_by(base: DataFrame, scenario: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Both sums per group from one shuffle: the sides are stacked, not joined, so a NULL group is one group."""
    none = F.lit(None).cast("double")
    b, s = column(resolve(base, value)).cast("double"), column(resolve(scenario, value)).cast("double")
    stacked = base.select(*[column(c) for c in by], b.alias("_b"), none.alias("_s")).unionByName(
        scenario.select(*[column(c) for c in by], none.alias("_b"), s.alias("_s"))
    )
    return _both_sums(stacked, by, F.col("_b"), F.col("_s"))


def _both_sums(rows: DataFrame, by: Sequence[str], before: Column, after: Column) -> DataFrame:
    actual, changed = precise_sum(before), precise_sum(after)
    return rows.groupBy(*[column(c) for c in by]).agg(actual.alias("actual"), changed.alias("scenario"))


def _with_delta(sums: DataFrame) -> DataFrame:
    delta = F.col("scenario") - F.col("actual")
    percent = F.when(F.col("actual") != 0, F.try_divide(delta, F.abs("actual")) * 100)
    return sums.withColumn("delta", delta).withColumn("delta_pct", percent)


def _rounded(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.withColumns({n: to_cents(F.col(n)) for n in names})


def _common(base: DataFrame, scenario: DataFrame, by: Sequence[str]) -> list[str]:
    return [c for c in by if c in base.columns and c in scenario.columns]


FIGURES = ("actual", "scenario", "delta", "delta_pct")


def variance(
    base: DataFrame | None,
    scenario: DataFrame,
    by: Sequence[str],
    value: str = "amount",
    compare_to: str = "scenario_base",
) -> DataFrame:
    """Actual, scenario, delta and percent per group, rounded to cents; percent is NULL when actual is 0.

    ``compare_to="scenario_base"`` compares each scenario row with its own ``baseline_<value>``, from one
    read of the scenario and no union; ``"baseline"`` compares with all rows of ``base``.
    """
    sums = _compared(base, scenario, by, value, compare_to)
    return _rounded(_with_delta(sums), FIGURES)


def _compared(base, scenario, by, value, compare_to):
    kept = f"baseline_{value}"
    if compare_to == "scenario_base":
        if kept in scenario.columns:
            keys = [c for c in by if c in scenario.columns]
            return _both_sums(scenario, keys, column(kept), column(value).cast("double"))
    elif compare_to != "baseline":
        raise ValueError(f"unknown compare_to {compare_to!r}")
    if base is None:
        raise ValueError(f"base rows are needed when the scenario has no {kept!r} column or is compared with them")
    return _sums_by(base, scenario, _common(base, scenario, by), value)


def variance_totals(
    base: DataFrame | None, scenario: DataFrame, value: str = "amount", compare_to: str = "scenario_base"
) -> DataFrame:
    """One row: total_actual, total_scenario, total_delta, total_delta_pct."""
    totals = variance(base, scenario, [], value, compare_to)
    return totals.select(*[column(c).alias(f"total_{c}") for c in FIGURES])


def waterfall(
    base: DataFrame | None,
    scenario: DataFrame,
    by: str,
    value: str = "amount",
    compare_to: str = "scenario_base",
) -> DataFrame:
    """Bridge from the actual to the scenario total: ``pos, name, value, running_total, is_total``.

    Bars are the groups whose delta exceeds 0.01 % of the actual total and 1.0, ordered by signed delta,
    largest first. The closing bar is the true scenario total, so omitted groups leave a gap before it. An
    empty frame comes back when a side lacks the column.
    """
    if by not in scenario.columns or (base is not None and by not in base.columns):
        return _empty_waterfall(scenario)
    groups = settle(
        _compared(base, scenario, [by], value, compare_to).withColumn("delta", F.col("scenario") - F.col("actual"))
    )
    actual, final = groups.agg(precise_sum(F.col("actual")), precise_sum(F.col("scenario"))).first()
    limit = max(abs(actual) * SHARE_OF_TOTAL, SMALLEST_BAR)
    bars = groups.filter(F.abs("delta") > limit).select(
        F.lit(1).alias("_part"), column(by).cast("string").alias("name"), F.col("delta").alias("value")
    )
    steps = bars.unionByName(_rows_of(groups, [(0, "Actuals", actual), (2, "Scenario", final)], ("_part", "name", "value")))
    order = [F.col("_part"), F.col("value").desc(), F.col("name").asc_nulls_first()]
    numbered = with_running(steps, order, position="pos", running={"_running": "value"})
    running = F.when(F.col("_part") == 2, F.col("value")).otherwise(F.col("_running"))
    return numbered.select(
        F.col("pos").cast("bigint").alias("pos"), "name", to_cents(F.col("value")).alias("value"),
        to_cents(running).alias("running_total"), (F.col("_part") != 1).alias("is_total"),
    ).orderBy("pos")


def _rows_of(df: DataFrame, rows: Sequence[tuple], names: Sequence[str]) -> DataFrame:
    """A few literal rows."""
    structs = [F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row)]) for row in rows]
    return df.sparkSession.range(1).select(F.inline(F.array(*structs)))


def _empty_waterfall(df: DataFrame) -> DataFrame:
    shape = "pos bigint, name string, value double, running_total double, is_total boolean"
    return df.sparkSession.createDataFrame([], shape)


def waterfall_screen(
    base: DataFrame,
    scenario: DataFrame,
    by: str,
    value: str = "amount",
    scenario_name: str = "Scenario",
    top: int = SCREEN_BARS,
) -> DataFrame:
    """Bridge as drawn on screen: ``pos, name, value, delta, bottom, is_total``.

    The ``top`` largest changes (absolute, above one cent) are bars; the others are summed as ``Other``. NULL
    groups count as group ``Other``. Bars hold absolute values; ``bottom`` is where the bar starts.
    """
    def side(df: DataFrame) -> DataFrame:
        key = F.coalesce(column(resolve(df, by)).cast("string"), F.lit("Other")).alias("name")
        return df.select(key, clean_measure(column(resolve(df, value)), dtype_of(df, value)).alias(value))

    groups = settle(_sums_by(side(base), side(scenario), ["name"], value).withColumn(
        "delta", F.col("scenario") - F.col("actual")
    ))
    changed = F.abs("delta") > SCREEN_SMALLEST
    before, after, moved, several = groups.agg(
        precise_sum(F.col("actual")), precise_sum(F.col("scenario")),
        precise_sum(F.when(changed, F.col("delta"))), F.count_if(changed),
    ).first()
    bars = groups.filter(changed).orderBy(F.abs("delta").desc(), "name").limit(top)
    rest = moved - bars.agg(precise_sum(F.col("delta"))).first()[0] if several > top else 0.0
    ends = [(0, "Actuals", before, 0.0), (3, scenario_name, after, 0.0)]
    if abs(rest) > SCREEN_SMALLEST:
        ends.append((2, "Other", 0.0, rest))
    steps = bars.select(F.lit(1).alias("_part"), "name", F.lit(0.0).alias("_size"), "delta").unionByName(
        _rows_of(groups, ends, ("_part", "name", "_size", "delta"))
    )
    order = [F.col("_part"), F.abs("delta").desc(), F.col("name").asc()]
    upto = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)  # at most top + 3 rows
    move = F.when(F.col("_part") == 0, F.col("_size")).otherwise(F.col("delta"))
    numbered = steps.select("*", F.row_number().over(Window.orderBy(*order)).alias("pos"), F.sum(move).over(upto).alias("_after"))
    is_total = F.col("_part").isin(0, 3)
    start = F.col("_after") - F.col("delta")
    bottom = F.when(is_total, F.lit(0.0)).otherwise(F.least(start, F.col("_after")))
    return numbered.select(
        F.col("pos").cast("bigint").alias("pos"),
        F.when(~is_total & (F.length("name") > 20), F.concat(F.substring("name", 1, 18), F.lit("…")))
        .otherwise(F.col("name")).alias("name"),
        F.when(is_total, F.col("_size")).otherwise(F.abs("delta")).alias("value"),
        "delta", bottom.alias("bottom"), is_total.alias("is_total"),
    ).orderBy("pos")


def comparison(
    base: DataFrame,
    scenarios: Mapping[str, DataFrame],
    rows: Sequence[str],
    value: str = "amount",
    col: str | None = None,
) -> DataFrame:
    """Per row key (and column key): ``actual``, ``sc_<name>`` and ``var_<name>`` for each scenario.

    All sides are stacked with a tag and summed in one shuffle; keys found on any side appear.
    """
    return _compare(base, scenarios, rows, value, col).drop("_in_base")


def _compare(base, scenarios, rows, value, col=None) -> DataFrame:
    keys = [*rows, *([col] if col else [])]
    sides = []
    for tag, df in (("", base), *scenarios.items()):
        measure = clean_measure(column(resolve(df, value)), dtype_of(df, value))
        sides.append(df.select(*[label(df, k) for k in keys], F.lit(tag).alias("_side"), measure.alias("_v")))
    stacked = sides[0]
    for side in sides[1:]:
        stacked = stacked.unionByName(side)
    # one narrow sum per side; the wide form is made from the grouped result
    long = stacked.groupBy(*[column(k) for k in keys], "_side").agg(precise_sum(F.col("_v")).alias("_v"))

    def of(tag: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("_side") == tag, F.col("_v"))), F.lit(0.0))

    wide = long.groupBy(*[column(k) for k in keys]).agg(
        of("").alias("actual"), *[of(n).alias(f"sc_{n}") for n in scenarios],
        F.max(F.col("_side") == "").alias("_in_base"),
    )
    return wide.withColumns({f"var_{n}": column(f"sc_{n}") - F.col("actual") for n in scenarios})


def comparison_pivot(
    base: DataFrame,
    scenarios: Mapping[str, DataFrame],
    rows: Sequence[str],
    col: str,
    value: str = "amount",
    values: Sequence[str] | None = None,
) -> DataFrame:
    """Wide comparison: ``act_<key>``, ``sc_<name>_<key>``, ``var_<name>_<key>`` per column key, plus totals.

    Column keys are the non-null ones of the base; totals include every row.
    """
    if values is None:
        values = column_keys(base.filter(column(resolve(base, col)).isNotNull()), col)
    long = comparison(base, scenarios, rows, value, col)

    def cell(key: str, figure: str) -> Column:
        return F.coalesce(F.sum(F.when(column(col) == key, column(figure))), F.lit(0.0))

    figures = []
    for key in values:
        figures.append(cell(key, "actual").alias(f"act_{key}"))
        for name in scenarios:
            figures.append(cell(key, f"sc_{name}").alias(f"sc_{name}_{key}"))
            figures.append(cell(key, f"var_{name}").alias(f"var_{name}_{key}"))
    figures.append(F.sum("actual").alias("_total"))
    for name in scenarios:
        figures.append(F.sum(column(f"sc_{name}")).alias(f"sc_{name}"))
        figures.append(F.sum(column(f"var_{name}")).alias(f"var_{name}"))
    return long.groupBy(*[column(r) for r in rows]).agg(*figures)


def comparison_totals(compared: DataFrame, rows: Sequence[str]) -> DataFrame:
    """Total row of a comparison table."""
    figures = [c for c in compared.columns if c not in rows]
    return compared.agg(*[F.sum(column(c)).alias(c) for c in figures])


def chart_series(
    base: DataFrame,
    scenarios: Mapping[str, DataFrame],
    rows: Sequence[str],
    value: str = "amount",
    top: int = CHART_ROWS,
) -> DataFrame:
    """First points of a chart: ``label``, ``Actuals`` and one column per scenario, for keys of the base only."""
    kept = _compare(base, scenarios, rows, value).filter("_in_base")
    first = kept.orderBy(*pivot_order(rows, "actual", "auto")).limit(top)
    return first.select(
        F.concat_ws(" | ", *[column(r) for r in rows]).alias("label"), *[column(r) for r in rows],
        F.col("actual").alias("Actuals"), *[column(f"sc_{n}").alias(n) for n in scenarios],
    )
