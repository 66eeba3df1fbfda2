"""Scans, filters and grouped queries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.values import (
    all_of, column, day_text, dtype_of, equal_to, find_period, is_numeric, is_temporal, member_of, month_of,
    period_between, precise_avg, precise_sum, require_numeric, resolve, text,
)
from ..plans.specs import QuerySpec

TOP_GROUPS = 50  # fixed value: rows of a grouped tool query
TOP_VALUES = 30  # fixed value: rows of a value count


def scan(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    filters: Mapping[str, object] | None = None,
    limit: int | None = None,
    lenient: bool = False,
) -> DataFrame:
    """Chosen columns of the rows that satisfy every equality. Filters and columns reach the file scan."""
    tests = [equal_to(df, name, value) for name, value in _known(df, filters or {}, lenient).items()]
    result = df.filter(all_of(tests)) if tests else df
    if columns:
        result = result.select(*[column(c) for c in _known(df, dict.fromkeys(columns), lenient)])
    return result if limit is None else result.limit(int(limit))


def filter_rows(df: DataFrame, filters: Mapping[str, object], lenient: bool = False) -> DataFrame:
    """Keep rows where every filter holds: a list means IN, a single value means equality."""
    tests = [
        member_of(df, name, wanted) if isinstance(wanted, (list, tuple, set)) else equal_to(df, name, wanted)
        for name, wanted in _known(df, filters, lenient).items()
    ]
    return df.filter(all_of(tests)) if tests else df


def screen_filter(df: DataFrame, filters: Mapping[str, Sequence]) -> DataFrame:
    """As :func:`filter_rows`, but an empty list means no filter and a missing column matches nothing."""
    tests = []
    for name, wanted in filters.items():
        if not wanted:
            continue
        tests.append(member_of(df, name, wanted) if name in df.columns else F.lit(False))
    return df.filter(all_of(tests)) if tests else df


def filter_period_range(
    df: DataFrame, start: str | None = None, end: str | None = None, period: str | None = None, mode: str = "prefix"
) -> DataFrame:
    """Rows whose period lies in ``[start, end]``; unchanged when the table has no period column."""
    name = period or find_period(df)
    if name is None or not (start or end):
        return df
    return df.filter(period_between(df, name, start, end, mode))


def aggregate_of(fn: str, df: DataFrame, name: str) -> Column:
    """One of sum, avg/mean, min, max, count on a column; an unknown name is an error."""
    dtype, c = dtype_of(df, name), column(resolve(df, name))
    if fn == "count":
        return F.count(c)
    if fn in ("min", "max"):
        return (F.min if fn == "min" else F.max)(c)
    if fn not in ("sum", "avg", "mean"):
        raise ValueError(f"unknown aggregation {fn!r}; use sum, avg, mean, min, max or count")
    require_numeric(df, name)
    if fn == "sum":
        exact = isinstance(dtype, (T.IntegralType, T.DecimalType))
        return F.coalesce(F.sum(c), F.lit(0)) if exact else precise_sum(c.cast("double"))
    return precise_avg(c.cast("double"))


def sort_keys(order_by: Sequence[tuple[str, str]]) -> list[Column]:
    """Ascending and descending keys, both with nulls first."""
    return [
        column(name).desc_nulls_first() if direction == "desc" else column(name).asc_nulls_first()
        for name, direction in order_by
    ]


def run_query(df: DataFrame, spec: QuerySpec | Mapping, lenient: bool = False) -> DataFrame:
    """Filter, group and aggregate, order and limit, in that order.

    Without group columns or without aggregations the filtered rows are returned. A column cannot be a
    group key and an aggregate at once. ``lenient=True`` drops unknown columns instead of raising.
    """
    spec = QuerySpec.of(spec)
    base = df
    if spec.columns:
        wanted = _known(df, dict.fromkeys(spec.columns), lenient)
        base = df.select(*[column(c) for c in wanted])
    result = filter_rows(base, spec.filters, lenient)
    keys = list(_known(base, dict.fromkeys(spec.group_by), lenient))
    measures = _known(base, spec.aggregations, lenient)
    if keys and measures:
        both = set(keys) & set(measures)
        if both:
            raise ValueError(f"columns used both as group key and as aggregate: {sorted(both)}")
        result = result.groupBy(*[column(k) for k in keys]).agg(
            *[aggregate_of(fn, base, name).alias(name) for name, fn in measures.items()]
        )
    order = list(_known(result, dict(spec.order_by), lenient).items())
    if order:
        result = result.orderBy(*sort_keys(order))
    return result.limit(spec.limit) if spec.limit else result


def query_grouped(
    df: DataFrame,
    group_by: Sequence[str],
    value: str,
    agg: str = "sum",
    filters: Mapping[str, Sequence] | None = None,
    top: int = TOP_GROUPS,
) -> DataFrame:
    """One measure per group, largest first, top groups only; one total row when there is no group.

    Equal values are ordered by the group columns, so that the cut is repeatable.
    """
    require_numeric(df, value)
    rows = filter_rows(df, {c: v for c, v in (filters or {}).items() if isinstance(v, (list, tuple))}, lenient=True)
    measured = rows.withColumn(value, column(value).cast("double"))
    measure = aggregate_of(agg, measured, value).alias(value)
    keys = [k for k in group_by if k in df.columns]
    if not keys:
        return measured.agg(measure)
    ranked = [column(value).desc_nulls_first()] + [column(k).asc_nulls_first() for k in keys]
    return measured.groupBy(*[column(k) for k in keys]).agg(measure).orderBy(*ranked).limit(top)


def value_counts(df: DataFrame, name: str, top: int = TOP_VALUES) -> DataFrame:
    """Most frequent non-null values: ``value`` (text), ``count``."""
    c = column(resolve(df, name))
    counted = df.filter(c.isNotNull()).groupBy(text(c, dtype_of(df, name)).alias("value"))
    return counted.agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "value").limit(top)


def available_periods(df: DataFrame, period: str | None = None) -> DataFrame:
    """Distinct non-null periods with their year, sorted."""
    name = period or find_period(df)
    if name is None:
        raise ValueError(f"no period column among {df.columns}")
    periods = df.select(day_text(column(name), dtype_of(df, name)).alias("period")).filter("period IS NOT NULL").distinct()
    year = F.when(F.length("period") >= 4, F.substring("period", 1, 4))
    return periods.select("period", year.alias("year")).orderBy("period")


def derive_period(df: DataFrame, out: str = "_period") -> DataFrame:
    """Month of the row: ``month_year`` if filled, else the first text column that starts ``YYYY-MM``."""
    if out in df.columns:
        return df
    found = []
    if "month_year" in df.columns:
        found.append(F.when(F.col("month_year") != "", F.col("month_year")))
    for f in df.schema.fields:
        if f.name == "month_year":
            continue
        if isinstance(f.dataType, T.StringType):
            c = column(f.name)
            found.append(F.when(c.rlike(r"^\d{4}-\d{2}"), month_of(c)))
        elif is_temporal(f.dataType):
            found.append(F.date_format(column(f.name), "yyyy-MM"))
    return df.withColumn(out, F.coalesce(*found) if found else F.lit(None).cast("string"))


def value_column(df: DataFrame, wanted: str = "amount", measures: Sequence[str] = ()) -> str:
    """The wanted measure, else ``amount``, else the first known measure, else the first numeric column."""
    for name in (wanted, "amount", *measures):
        if name in df.columns:
            return name
    for f in df.schema.fields:
        if is_numeric(f.dataType) and f.name != "_row_id":
            return f.name
    raise ValueError(f"column {wanted!r} not found and no numeric column available")


def pivot_fields(df: DataFrame, measures: Sequence[str] = ()) -> tuple[list[str], list[str]]:
    """Columns offered as pivot dimensions and as pivot measures."""
    skip = {"company_id", "_data_source", "_row_id", "amount", "entry_count"}
    dims = sorted(
        f.name for f in df.schema.fields
        if not is_numeric(f.dataType) and f.name not in skip and not f.name.startswith("baseline_")
    )
    named = [c for c in df.columns if c in set(measures) and c not in ("entry_count", "_row_id")]
    numeric = [
        f.name for f in df.schema.fields
        if is_numeric(f.dataType) and f.name not in ("entry_count", "_row_id") and not f.name.endswith("_id")
    ]
    return dims, named or numeric


def _known(df: DataFrame, wanted: Mapping, lenient: bool) -> dict:
    """``wanted`` with its keys checked against the table."""
    missing = [c for c in wanted if c not in df.columns]
    if missing and not lenient:
        raise ValueError(f"unknown columns {missing}; available: {df.columns}")
    return {c: v for c, v in wanted.items() if c not in missing}
