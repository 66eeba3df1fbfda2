"""Several reports from one reading of the rows: stored sums per grouping, and the choice of the smallest that serves.

A report needs sums by some columns only. A set of reports sums each side once at the finest grouping that any of its
reports needs and stores the result; a coarser grouping that is asked for often is stored as well, made from the smallest stored
one that contains it. Every report then reads the smallest stored table with all its columns, never the rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.values import clean_measure, column, dtype_of, find_period, precise_sum, require_numeric, resolve
from ..sources.shared import settle
from . import compare, pivot, scenario as scenarios_
from .rules import screen_period


def _sum_or_null(value: Column) -> Column:
    """The sum, NULL where there is no value: a group without values stays told apart from one that sums to nothing."""
    return F.when(F.count(value) > 0, precise_sum(value))


@dataclass(frozen=True)
class Rollup:
    """One stored grouping."""

    by: frozenset[str]
    rows: int
    table: DataFrame


class Rollups:
    """Sums of the measures of one table at several groupings.

    ``groupings`` are the column lists that reports will ask for; the union of them is read from the rows, once. A column that the table lacks
    is left out of a grouping. Measures are numeric columns; each is kept as its sum, the sum of its cleaned values (as pivots and
    comparisons read it: NULL and NaN count as 0) and the number of values.
    """

    def __init__(self, rows: DataFrame, measures: Sequence[str], groupings: Sequence[Sequence[str]]):
        self.measures = [resolve(rows, m) for m in measures]
        for m in self.measures:
            require_numeric(rows, m)
        self.columns = rows.columns
        wanted = {self._known(g) for g in groupings}
        finest = frozenset().union(*wanted) if wanted else frozenset()
        first = []
        for m in self.measures:
            plain, clean = column(m).cast("double"), clean_measure(column(m), dtype_of(rows, m))
            first += [_sum_or_null(plain).alias(f"_sum_{m}"), _sum_or_null(clean).alias(f"_clean_{m}"), F.count(plain).alias(f"_n_{m}")]
        self.stored: list[Rollup] = []
        self._keep(finest, rows.groupBy(*[column(c) for c in self._ordered(finest)]).agg(*first))
        for by in sorted(wanted - {finest}, key=len, reverse=True):
            self.add(self._ordered(by))

    def _known(self, by: Sequence[str]) -> frozenset[str]:
        return frozenset(c for c in by if c in self.columns)

    def _ordered(self, by) -> list[str]:
        return [c for c in self.columns if c in by]

    def _keep(self, by: frozenset[str], sums: DataFrame) -> Rollup:
        table = settle(sums)
        found = Rollup(by, table.count(), table)
        self.stored = sorted([*self.stored, found], key=lambda r: (r.rows, len(r.by)))
        return found

    def smallest(self, by: Sequence[str]) -> Rollup:
        """The stored grouping with the fewest rows that has all these columns."""
        wanted = self._known(by)
        for rollup in self.stored:
            if wanted <= rollup.by:
                return rollup
        raise ValueError(f"no stored grouping has {sorted(wanted)}; stored: {[sorted(r.by) for r in self.stored]}")

    def add(self, by: Sequence[str]) -> Rollup:
        """Store a coarser grouping, from the smallest stored one that contains it."""
        source, wanted = self.smallest(by), self._known(by)
        if source.by == wanted:
            return source
        again = []
        for m in self.measures:
            again += [_sum_or_null(column(f"_{kind}_{m}")).alias(f"_{kind}_{m}") for kind in ("sum", "clean")]
            again.append(F.sum(column(f"_n_{m}")).alias(f"_n_{m}"))
        return self._keep(wanted, source.table.groupBy(*[column(c) for c in self._ordered(wanted)]).agg(*again))

    def table(self, by: Sequence[str], clean: bool = False, filters: Mapping[str, Sequence] | None = None, having: str | None = None) -> DataFrame:
        """The grouping's columns with one sum per measure under the measure's own name: stands in for the rows in a report.

        ``filters`` (column to allowed values, on columns of a stored grouping) are applied before; ``having`` keeps groups
        with a value of that measure only.
        """
        rollup = self.smallest([*by, *(filters or {})])
        table = rollup.table
        for name, values in (filters or {}).items():
            table = table.filter(column(name).isin(list(values)))
        if having:
            table = table.filter(column(f"_n_{having}") > 0)
        kind = "clean" if clean else "sum"
        return table.select(*[column(c) for c in self._ordered(rollup.by)], *[column(f"_{kind}_{m}").alias(m) for m in self.measures])

    def means(self, by: Sequence[str], measure: str) -> DataFrame:
        """Mean of a measure's values per group, from sums and numbers; NULL where there are none."""
        m = next(x for x in self.measures if x.lower() == measure.lower())
        mean = F.try_divide(precise_sum(column(f"_sum_{m}")), F.sum(column(f"_n_{m}")))
        return self.smallest(by).table.groupBy(*[column(c) for c in self._ordered(self._known(by))]).agg(mean.alias(m))


class ReportSet:
    """Variance, waterfalls, comparisons and pivots of scenarios, each side read once.

    ``groupings`` lists the columns of the reports to come. With ``base=None`` the actuals are the ``baseline_<value>`` of the only
    scenario, so both sides come from one reading of it; a group whose rows all lack it is not in the base. Otherwise ``base`` is read once as well. Reports
    take the arguments of the functions of the same name and give the same rows.
    """

    def __init__(self, base: DataFrame | None, scenarios: Mapping[str, DataFrame], groupings: Sequence[Sequence[str]], value: str = "amount"):
        self.value, self.kept = value, f"baseline_{value}"
        if base is None and (len(scenarios) != 1 or any(self.kept not in s.columns for s in scenarios.values())):
            raise ValueError(f"without base rows one scenario with a {self.kept!r} column is needed")
        self.sides = {name: Rollups(s, [c for c in (value, self.kept) if c in s.columns], groupings) for name, s in scenarios.items()}
        self._base = None if base is None else Rollups(base, [value], groupings)

    def _scenario(self, name: str | None) -> Rollups:
        if name is None and len(self.sides) != 1:
            raise ValueError(f"which scenario? one of {list(self.sides)}")
        return self.sides[name] if name is not None else next(iter(self.sides.values()))

    def base(self, by: Sequence[str], clean: bool = False) -> DataFrame:
        if self._base is not None:
            return self._base.table(by, clean)
        own = self._scenario(None).table(by, clean, having=self.kept)
        return own.drop(self.value).withColumnRenamed(self.kept, self.value)

    def scenario(self, by: Sequence[str], name: str | None = None, clean: bool = False) -> DataFrame:
        return self._scenario(name).table(by, clean)

    def _both(self, by: Sequence[str], compare_to: str, name: str | None) -> tuple[DataFrame | None, DataFrame]:
        changed = self.scenario(by, name)
        own = compare_to == "scenario_base" and self.kept in changed.columns
        return (None if own else self.base(by)), changed

    def variance(self, by: Sequence[str], name: str | None = None, compare_to: str = "scenario_base") -> DataFrame:
        base, changed = self._both(by, compare_to, name)
        return compare.variance(base, changed, by, self.value, compare_to)

    def variance_totals(self, name: str | None = None, compare_to: str = "scenario_base") -> DataFrame:
        base, changed = self._both([], compare_to, name)
        return compare.variance_totals(base, changed, self.value, compare_to)

    def waterfall(self, by: str, name: str | None = None, compare_to: str = "scenario_base") -> DataFrame:
        base, changed = self._both([by], compare_to, name)
        return compare.waterfall(base, changed, by, self.value, compare_to)

    def waterfall_screen(self, by: str, name: str | None = None, top: int = compare.SCREEN_BARS) -> DataFrame:
        return compare.waterfall_screen(self.base([by], True), self.scenario([by], name, True), by, self.value, name or "Scenario", top)

    def _all(self, by: Sequence[str]) -> dict[str, DataFrame]:
        return {name: side.table(by, True) for name, side in self.sides.items()}

    def comparison(self, rows: Sequence[str], col: str | None = None) -> DataFrame:
        by = [*rows, *([col] if col else [])]
        return compare.comparison(self.base(by, True), self._all(by), rows, self.value, col)

    def comparison_pivot(self, rows: Sequence[str], col: str, values: Sequence[str] | None = None) -> DataFrame:
        by = [*rows, col]
        return compare.comparison_pivot(self.base(by, True), self._all(by), rows, col, self.value, values)

    def chart_series(self, rows: Sequence[str], top: int = compare.CHART_ROWS) -> DataFrame:
        return compare.chart_series(self.base(rows, True), self._all(rows), rows, self.value, top)

    def pivot_long(self, rows: Sequence[str], col: str | None = None, name: str | None = None) -> DataFrame:
        return pivot.pivot_long(self.scenario([*rows, *([col] if col else [])], name, True), rows, col, self.value)

    def pivot_wide(self, rows: Sequence[str], col: str, name: str | None = None, values: Sequence[str] | None = None, totals: bool = False) -> DataFrame:
        return pivot.pivot_wide(self.scenario([*rows, col], name, True), rows, col, self.value, values, totals)

    def variance_total(self, name: str | None = None) -> DataFrame:
        return scenarios_.variance_total(self.base([], True), self.scenario([], name, True), self.value)

    def period_delta(self, name: str | None = None, first: int = 6) -> DataFrame:
        """Needs a grouping with the period column among the stored ones."""
        finest = max(self._scenario(name).stored, key=lambda r: len(r.by)).table
        period = screen_period(finest) or find_period(finest)
        return scenarios_.period_delta(self.base([period], True), self.scenario([period], name, True), self.value, first)
