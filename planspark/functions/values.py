"""Column helpers shared by every operator: sums, casts, membership tests, period comparisons."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Sequence
from decimal import Decimal, InvalidOperation

from pyspark.sql import Column, DataFrame, functions as F, types as T

NUMERIC_TEXT = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"

# Names under which the period column of a table is looked up, in order of preference.
PERIOD_NAMES = (
    "period", "periode", "monat", "month", "date", "datum", "buchungsdatum", "fiscal_period", "year_month",
)
# The same lookup for the screen rules, which prefer the derived month.
SCREEN_PERIOD_NAMES = ("_period", "period", "month_year")

INTERNAL_COLUMNS = ("_row_id", "_data_source")


def precise_sum(value: Column) -> Column:
    """Sum of a double column that does not depend on the order of the rows.

    A plain double sum changes in the last digits with partitioning and task retries, and a decimal sum costs
    an object per row. Whole parts and fractions are summed apart as doubles: sums of whole numbers are exact up to 9e15
    in any order, and fractions (each below one) err far under a cent, though their last bits may differ. Beyond 9e15 the
    result is that of a plain double sum; nothing overflows. An empty or all-null group gives 0.0.
    """
    whole = F.floor(value).cast("double")
    return F.coalesce(F.sum(whole), F.lit(0.0)) + F.coalesce(F.sum(value - whole), F.lit(0.0))


def precise_avg(value: Column) -> Column:
    """Mean of the non-null values, NULL when there are none."""
    return F.try_divide(precise_sum(value), F.count(value))


def distinct_with_null(column: Column) -> Column:
    """Distinct count in which NULL is one value."""
    return F.count_distinct(column) + F.coalesce(F.max(F.isnull(column).cast("int")), F.lit(0))


def dtype_of(df: DataFrame, name: str) -> T.DataType:
    return df.schema[resolve(df, name)].dataType


def resolve(df: DataFrame, name: str) -> str:
    """The schema's own spelling of a column name; raises when the column does not exist."""
    if name in df.columns:
        return name
    for known in df.columns:
        if known.lower() == name.lower():
            return known
    raise ValueError(f"unknown column {name!r}; available: {df.columns}")


def column(name: str) -> Column:
    """Reference by exact name, also when it contains dots or other special characters."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def is_temporal(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric(f.dataType) and f.name != "_row_id"]


def require_numeric(df: DataFrame, name: str) -> None:
    found = dtype_of(df, name)
    if not is_numeric(found):
        raise ValueError(
            f"column {name!r} is not numeric (type: {found.simpleString()}); numeric columns: {numeric_columns(df)}"
        )


def find_period(df: DataFrame, candidates: Sequence[str] = PERIOD_NAMES) -> str | None:
    by_lower = {name.lower(): name for name in reversed(df.columns)}
    return next((by_lower[c] for c in candidates if c in by_lower), None)


def text(c: Column, dtype: T.DataType | None = None) -> Column:
    """Text form used for keys and labels: dates and midnight timestamps are ISO dates, other timestamps keep their time."""
    if dtype is not None and isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        day = c.cast("date")
        return F.when(day.cast(dtype) == c, day.cast("string")).otherwise(c.cast("string"))
    return c.cast("string")


def day_text(c: Column, dtype: T.DataType | None = None) -> Column:
    """Text form of a period: that of :func:`text`, with timestamps cut to their day."""
    if dtype is not None and isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(c, "yyyy-MM-dd")
    return c.cast("string")


def text_to_double(c: Column) -> Column:
    """Non-strict parse: text that is not a plain number becomes NULL instead of failing.

    The pattern also keeps out Java forms that the cast alone would read, such as ``1d``.
    """
    trimmed = F.trim(c)
    return F.when(trimmed.rlike(NUMERIC_TEXT), trimmed).try_cast("double")


def stacked_values(df: DataFrame, names: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """The named columns below each other: ``column_name``, ``value`` as text, nulls included; ``keep`` stays beside them."""
    texts = df.select(*[column(k) for k in keep], *[text(column(n), dtype_of(df, n)).alias(n) for n in names])
    return texts.unpivot([column(k) for k in keep], [column(n) for n in names], "column_name", "value")


def text_to_long(c: Column) -> Column:
    """Non-strict parse of whole numbers; digits are read exactly, forms such as ``1e3`` by way of a double."""
    digits = F.nullif(F.regexp_extract(F.trim(c), r"^([+-]?\d+)(\.0*)?$", 1), F.lit(""))
    number = text_to_double(c)
    return F.coalesce(digits.try_cast("bigint"), F.when(number == F.floor(number), number).try_cast("bigint"))


def to_double(c: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.StringType):
        return text_to_double(c)
    if isinstance(dtype, T.BooleanType):
        return c.cast("int").cast("double")
    if is_numeric(dtype):
        return c.cast("double")
    return F.lit(None).cast("double")


def clean_measure(c: Column, dtype: T.DataType) -> Column:
    """Measure as the screen reads it: unparsable, NULL and NaN all count as 0."""
    return F.nanvl(F.coalesce(to_double(c, dtype), F.lit(0.0)), F.lit(0.0))


def to_cents(c: Column) -> Column:
    """Two decimals for reports. Rounding to six first keeps the noise of binary sums away from half cents."""
    return F.round(F.round(c, 6), 2)


def half_up_cents(c: Column) -> Column:
    """Two decimals with halves rounded towards plus infinity, as the screen rules do."""
    return F.floor(c * 100 + 0.5) / 100


def _as_number(value: object, dtype: T.DataType) -> object | None:
    try:
        number = Decimal(str(value).strip())
    except InvalidOperation:
        return None
    if not number.is_finite():
        return None
    if isinstance(dtype, T.IntegralType):
        return int(number) if number == number.to_integral_value() else None
    if isinstance(dtype, T.DecimalType):
        return number
    return float(number)


def literals_for(values: Iterable[object], dtype: T.DataType) -> list:
    """Filter values as literals of the column's own type, so that the test can be pushed to the scan.

    Values that cannot be read in that type match nothing and are left out.
    """
    present = [v for v in values if v is not None]
    if is_numeric(dtype):
        return [n for n in (_as_number(v, dtype) for v in present) if n is not None]
    if isinstance(dtype, T.BooleanType):
        words = {"true": True, "false": False}
        return [words[str(v).lower()] for v in present if str(v).lower() in words]
    if is_temporal(dtype):
        return [F.lit(str(v)).try_cast(dtype) for v in present]
    return [str(v) for v in present]


def member_of(df: DataFrame, name: str, values: Iterable[object]) -> Column:
    """``name IN values``. An empty list matches nothing."""
    actual = resolve(df, name)
    wanted = literals_for(values, dtype_of(df, actual))
    return column(actual).isin(*wanted) if wanted else F.lit(False)


def equal_to(df: DataFrame, name: str, value: object) -> Column:
    return member_of(df, name, [value])


def _after_prefix(bound: str) -> str:
    """Smallest text that sorts after every text starting with ``bound``."""
    return bound[:-1] + chr(ord(bound[-1]) + 1)


def _first_day(bound: str) -> dt.date:
    parts = [int(p) for p in bound.split("-")]
    return dt.date(parts[0], parts[1] if len(parts) > 1 else 1, parts[2] if len(parts) > 2 else 1)


def _day_after(bound: str) -> dt.date:
    start, parts = _first_day(bound), bound.count("-")
    if parts == 0:
        return dt.date(start.year + 1, 1, 1)
    if parts == 1:
        return dt.date(start.year + start.month // 12, start.month % 12 + 1, 1)
    return start + dt.timedelta(days=1)


def period_at_least(c: Column, dtype: T.DataType, bound: str) -> Column:
    if is_temporal(dtype):
        return c >= F.lit(_first_day(bound)).cast(dtype)
    return c.cast("string") >= F.lit(bound)


def period_at_most(c: Column, dtype: T.DataType, bound: str, mode: str = "prefix") -> Column:
    """Upper bound at the grain of the bound: a monthly bound keeps every day of that month.

    Written as one plain comparison (``period < next prefix``, or a half-open date range for native dates),
    which the Parquet reader can use. ``mode="lexical"`` compares the raw texts.
    """
    if is_temporal(dtype):
        return c < F.lit(_day_after(bound)).cast(dtype)
    if mode == "lexical":
        return c.cast("string") <= F.lit(bound)
    return c.cast("string") < F.lit(_after_prefix(bound))


def period_between(
    df: DataFrame, name: str, start: str | None, end: str | None, mode: str = "prefix"
) -> Column:
    actual, dtype = resolve(df, name), dtype_of(df, name)
    tests = []
    if start:
        tests.append(period_at_least(column(actual), dtype, str(start)))
    if end:
        tests.append(period_at_most(column(actual), dtype, str(end), mode))
    return all_of(tests)


def all_of(conditions: Sequence[Column]) -> Column:
    result = None
    for condition in conditions:
        result = condition if result is None else result & condition
    return F.lit(True) if result is None else result


def month_of(c: Column) -> Column:
    return F.substring(c.cast("string"), 1, 7)
