"""Pivot tables: long form, wide form with totals, and sorted rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.values import clean_measure, column, dtype_of, precise_sum, resolve, text
from .ordering import with_running

MISSING_LABEL = "—"  # fixed value: label of a NULL row or column field
TIME_HINTS = ("period", "_year", "_month", "date")  # fixed values: names that sort by time


def label(df: DataFrame, name: str) -> Column:
    actual = resolve(df, name)
    return F.coalesce(text(column(actual), dtype_of(df, actual)), F.lit(MISSING_LABEL)).alias(name)


def pivot_long(df: DataFrame, rows: Sequence[str], col: str | None, value: str) -> DataFrame:
    """Sum per row key and column key, as ``(rows..., col, value)``. The form that scales in both directions."""
    keys = [label(df, name) for name in (*rows, *([col] if col else []))]
    measure = clean_measure(column(resolve(df, value)), dtype_of(df, value))
    return df.groupBy(*keys).agg(precise_sum(measure).alias(value))


def column_keys(df: DataFrame, col: str) -> list[str]:
    """Sorted column keys. Raises above ``spark.sql.pivotMaxValues``; use the long form there."""
    most = int(df.sparkSession.conf.get("spark.sql.pivotMaxValues"))
    found = [r[0] for r in df.select(label(df, col)).distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"{col!r} has more than {most} values; use pivot_long")
    return sorted(found)


def pivot_wide(
    df: DataFrame,
    rows: Sequence[str],
    col: str,
    value: str,
    values: Sequence[str] | None = None,
    totals: bool = False,
) -> DataFrame:
    """One column per column key plus ``_total``; ``totals=True`` adds a last row labelled ``Total``.

    The rows are first summed to the long form, so the work per input row does not grow with the number of
    columns. Column keys outside ``values`` still count in ``_total``.
    """
    keys = list(values) if values is not None else column_keys(df, col)
    long = pivot_long(df, rows, col, value)
    grouped, total = long.groupBy(*[column(r) for r in rows]), F.sum(column(value)).alias("_total")
    # One map per row key instead of an aggregate per column: the plan stays small, however many columns there are.
    cells = F.map_from_entries(F.collect_list(F.when(column(col).isin(*keys), F.struct(column(col), column(value))))).alias("_cells")
    wide = grouped.agg(cells, total).select(
        *[column(r) for r in rows], *[F.col("_cells")[k].alias(k) for k in keys], "_total")
    wide = wide.select(*[column(r) for r in rows], *[F.coalesce(column(k), F.lit(0.0)).alias(k) for k in keys], "_total")
    if not totals:
        return wide
    sums = [F.coalesce(F.sum(column(k)), F.lit(0.0)).alias(k) for k in (*keys, "_total")]
    names = [F.lit("Total" if i == 0 else None).cast("string").alias(r) for i, r in enumerate(rows)]
    grand = wide.agg(*sums).select(*names, *[column(k) for k in (*keys, "_total")])
    return wide.unionByName(grand)


def pivot_order(rows: Sequence[str], total: str, mode: str = "auto") -> list[Column]:
    """Sort keys of a pivot. ``auto`` sorts by time when the first row field looks like one, else by value."""
    first = rows[0]
    if mode == "auto":
        mode = "time_asc" if any(hint in first for hint in TIME_HINTS) else "value_desc"
    rest = [column(r).asc() for r in rows]
    if mode == "time_asc":
        return rest
    if mode == "time_desc":
        return [column(first).desc(), *rest[1:]]
    if mode == "value_desc":
        return [column(total).desc(), *rest]
    raise ValueError(f"unknown sort mode {mode!r}")


def sort_pivot(df: DataFrame, rows: Sequence[str], total: str = "_total", mode: str = "auto") -> DataFrame:
    """Pivot rows with their position ``pos``; mode ``none`` leaves the rows as they are."""
    if mode == "none":
        return df
    return with_running(df, pivot_order(rows, total, mode), position="pos")
