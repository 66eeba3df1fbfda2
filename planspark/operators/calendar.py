"""Calendar dimension and the filter lists built from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.periods import MONTH_NAMES
from ..functions.values import column, day_text, dtype_of, is_temporal, resolve

START, END = "2020-01-01", "2027-12-31"  # fixed values: days of the default calendar


def _described(days: DataFrame) -> DataFrame:
    """Calendar columns, all text, for a column ``day``."""
    year, month = F.date_format("day", "yyyy"), F.date_format("day", "MM")
    names = F.array(*[F.lit(m) for m in MONTH_NAMES])
    return days.select(
        F.date_format("day", "yyyy-MM-dd").alias("date"), F.date_format("day", "yyyy-MM").alias("month_year"),
        year.alias("year"), month.alias("month"), F.element_at(names, F.month("day")).alias("month_name"),
        F.concat(F.lit("Q"), F.quarter("day").cast("string"), F.lit(" "), year).alias("quarter"),
    )


def calendar_dim(spark: SparkSession, start: str = START, end: str = END) -> DataFrame:
    """One row per day: ``date, month_year, year, month, month_name, quarter``."""
    days = F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))
    return _described(spark.range(1).select(F.explode(days).alias("day")))


def calendar_for(df: DataFrame, name: str) -> DataFrame:
    """Calendar of all days of the years that a date column spans."""
    c = column(resolve(df, name)).try_cast("date")
    span = df.agg(F.min(c).alias("lo"), F.max(c).alias("hi")).filter("lo IS NOT NULL")
    last = F.make_date(F.year("hi"), F.lit(12), F.lit(31))
    return _described(span.select(F.explode(F.sequence(F.trunc("lo", "year"), last)).alias("day")))


def filter_values(df: DataFrame, field: str, calendar: DataFrame, calendar_field: str | None = None) -> DataFrame:
    """Sorted values of a filter list: those of the data and, for a calendar field, those of the calendar."""
    name = resolve(df, field)
    found = df.select(day_text(column(name), dtype_of(df, name)).alias("value"))
    known = {"_period": "month_year", "period": "month_year"}.get(field, field)
    source = calendar_field or (known if known in calendar.columns and known != "date" else None)
    if source:
        found = found.unionByName(calendar.select(column(source).alias("value")))
    return found.filter("value IS NOT NULL").distinct().orderBy("value")


def month_period(c: Column) -> Column:
    """``YYYY-MM`` of a native date or timestamp."""
    return F.date_format(c, "yyyy-MM")


def with_period(df: DataFrame, date_column: str, out: str = "period") -> DataFrame:
    """Add the month text of a native date column."""
    name = resolve(df, date_column)
    if not is_temporal(dtype_of(df, name)):
        raise ValueError(f"{date_column!r} is not a date column")
    return df.withColumn(out, month_period(column(name)))
