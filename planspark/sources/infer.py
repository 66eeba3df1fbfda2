"""Types of text columns: decided from one aggregate over all rows, then applied as plain casts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.values import NUMERIC_TEXT, column, dtype_of, stacked_values, text_to_double, text_to_long

# Words read as true and as false.
TRUE_WORDS = ("true", "yes", "1", "y", "x")
FALSE_WORDS = ("false", "no", "0", "n", "")

# Date formats in the order they are tried, each with the texts it can read. A failed parse is far
# slower than a failed match, so only matching texts are parsed.
_DAY, _MONTH = r"(0?[1-9]|[12]\d|3[01])", r"(0?[1-9]|1[0-2])"
DATE_FORMATS = (
    ("yyyy-M-d", rf"^\d{{4}}-{_MONTH}-{_DAY}$"),
    ("d.M.yyyy", rf"^{_DAY}\.{_MONTH}\.\d{{4}}$"),
    ("M/d/yyyy", rf"^{_MONTH}/{_DAY}/\d{{4}}$"),
    ("d/M/yyyy", rf"^{_DAY}/{_MONTH}/\d{{4}}$"),
    ("yyyyMMdd", r"^\d{4}(0[1-9]|1[0-2])(0[1-9]|[12]\d|3[01])$"),
)
ANY_DATE = r"^\d{1,4}[./-]\d{1,2}[./-]\d{1,4}$"

# Classes of a text; a date text has the class DATE plus one bit per format that reads it.
TEXT, WORD, DIGIT, WHOLE, NUMBER, DATE = 0, 1, 2, 3, 4, 16

MAX_WORD = max(map(len, TRUE_WORDS + FALSE_WORDS))
MAX_LOSS = 0.1  # fixed value: share of values that may become NULL

def _plain(c: Column, decimal_style: str) -> Column:
    """Number text in plain notation. ``de`` drops currency signs and thousands dots and reads a decimal comma."""
    if decimal_style == "us":
        return c
    if decimal_style != "de":
        raise ValueError(f"unknown decimal style {decimal_style!r}")
    return F.replace(F.regexp_replace(c, r"[€$£¥\s.]", ""), F.lit(","), F.lit("."))


def _number(c: Column, decimal_style: str) -> Column:
    return text_to_double(_plain(c, decimal_style))


def _date(c: Column, fmt: str, readable: str | None = None) -> Column:
    readable = readable or dict(DATE_FORMATS)[fmt]
    trimmed = F.trim(c)
    return F.try_to_timestamp(F.when(trimmed.rlike(readable), trimmed), F.lit(fmt)).cast("date")


def infer_schema(
    df: DataFrame, infer_bool_digits: bool = True, tolerance: float = MAX_LOSS, decimal_style: str = "us"
) -> dict[str, str]:
    """Target of each text column: boolean, integer, numeric, ``date:<format>`` or text.

    A column of only 0 and 1 (or blanks) is boolean unless ``infer_bool_digits=False``. Numbers are tried before
    dates, so eight digits are a number and only texts that are no number are tried as dates. ``decimal_style="de"`` reads ``1.234,56``.
    """
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not names:
        return {}
    value = F.trim("value")
    kind = _kind(value, _plain(value, decimal_style)).alias("kind")
    counted = stacked_values(df, names).filter("value IS NOT NULL").select("column_name", kind).groupBy("column_name", "kind").count()
    kinds: dict[str, dict[int, int]] = {n: {} for n in names}
    for r in counted.collect():  # a few classes per column
        kinds[r["column_name"]][r["kind"]] = r["count"]
    return {n: _decide(found, infer_bool_digits, tolerance) for n, found in kinds.items()}


def _kind(value: Column, plain: Column) -> Column:
    """Class of a trimmed text, by the first test that holds. Eight digits are a number, never a date."""
    number = plain.try_cast("double")
    fraction = F.when(plain.rlike("[eE]"), F.when(number == F.floor(number), WHOLE).otherwise(NUMBER)).otherwise(NUMBER)
    bits = [
        F.when(_date(value, f).isNotNull(), F.lit(1 << k)).otherwise(F.lit(0)) for k, (f, _) in enumerate(DATE_FORMATS[:4])
    ]
    return (
        F.when(F.length(value) <= MAX_WORD, F.when(value.isin("0", "1"), DIGIT)
               .when(F.lower(value).isin(*TRUE_WORDS, *FALSE_WORDS), WORD)
               .when(plain.rlike(r"^[+-]?\d+(\.0*)?$"), WHOLE).when(plain.rlike(NUMERIC_TEXT), fraction).otherwise(TEXT))
        .when(plain.rlike(r"^[+-]?\d+(\.0*)?$"), WHOLE)
        .when(plain.rlike(NUMERIC_TEXT), fraction)
        .when(value.rlike(ANY_DATE), F.lit(DATE) + bits[0] + bits[1] + bits[2] + bits[3])
        .otherwise(TEXT)
    )


def _decide(kinds: Mapping[int, int], infer_bool_digits: bool, tolerance: float) -> str:
    filled = sum(kinds.values())
    if not filled:
        return "text"
    digits, wholes = kinds.get(DIGIT, 0), kinds.get(DIGIT, 0) + kinds.get(WHOLE, 0)
    if digits + kinds.get(WORD, 0) == filled and (infer_bool_digits or digits < filled):
        return "boolean"
    numbers = wholes + kinds.get(NUMBER, 0)
    if (filled - numbers) / filled < tolerance:
        return "integer" if numbers and wholes == numbers else "numeric"
    for k, (fmt, _) in enumerate(DATE_FORMATS[:4]):
        read = sum(n for kind, n in kinds.items() if kind >= DATE and (kind - DATE) >> k & 1)
        if (filled - read) / filled < tolerance:
            return f"date:{fmt}"
    return "text"


def cast_inferred(df: DataFrame, targets: Mapping[str, str], decimal_style: str = "us") -> DataFrame:
    """Apply inferred targets; values that do not fit become NULL, text is trimmed."""
    casts = []
    for name in df.columns:
        c, target = column(name), targets.get(name)
        if target == "boolean":
            word = F.lower(F.trim(c))
            c = F.when(word.isin(*TRUE_WORDS), F.lit(True)).when(word.isin(*FALSE_WORDS), F.lit(False))
        elif target == "integer":
            c = text_to_long(_plain(c, decimal_style))
        elif target == "numeric":
            c = _number(c, decimal_style)
        elif target == "text":
            c = F.trim(c)
        elif target:
            c = _date(c, target.split(":", 1)[1])
        casts.append(c.alias(name))
    return df.select(*casts)


def infer_types(
    df: DataFrame, infer_bool_digits: bool = True, tolerance: float = MAX_LOSS, decimal_style: str = "us"
) -> DataFrame:
    """The table with its text columns cast to the inferred types; other columns are untouched."""
    return cast_inferred(df, infer_schema(df, infer_bool_digits, tolerance, decimal_style), decimal_style)


def coerce_types(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Cast to declared logical types; what does not fit becomes NULL. Columns without a declared type are text.

    ``_row_id`` is left alone.
    """
    casts = []
    for name in df.columns:
        c, target, dtype = column(name), types.get(name, "text"), dtype_of(df, name)
        is_text = isinstance(dtype, T.StringType)
        if name == "_row_id":
            pass
        elif target == "integer":
            c = text_to_long(c) if is_text else c.try_cast("bigint")
        elif target == "numeric":
            c = text_to_double(c) if is_text else c.try_cast("double")
        elif target == "boolean":
            c = F.when(F.lower(c) == "true", F.lit(True)).when(F.lower(c) == "false", F.lit(False)) if is_text else c.try_cast("boolean")
        elif target == "date":
            if is_text:
                c = F.coalesce(*[_date(c, f) for f, _ in DATE_FORMATS])
            elif isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
                c = c.cast("date")
        else:
            c = c.cast("string")
        casts.append(c.alias(name))
    return df.select(*casts)


# Time formats in the order they are voted on: pattern, parse format (None = already ISO), grain.
TIME_FORMATS = (
    (r"^\d{4}-\d{2}-\d{2}$", None, "day"),
    (r"^\d{4}-\d{2}$", None, "month"),
    (r"^\d{2}\.\d{2}\.\d{4}$", "d.M.yyyy", "day"),
    (r"^\d{1,2}\.\d{1,2}\.\d{4}$", "d.M.yyyy", "day"),
    (r"^\d{1,2}\.\d{4}$", "M.yyyy", "month"),
    (r"^\d{4}/\d{2}/\d{2}$", "yyyy/M/d", "day"),
    (r"^\d{2}/\d{2}/\d{4}$", "d/M/yyyy", "day"),
    (r"^\d{2}-\d{2}-\d{4}$", "d-M-yyyy", "day"),
)
VOTE = 0.7  # fixed value: share of values a time format must match


def time_formats(df: DataFrame, names: Sequence[str]) -> dict[str, tuple[str, str | None, str] | None]:
    """Dominant time format of each text column, by one vote over all non-blank values of all columns."""
    if not names:
        return {}
    trimmed = F.trim("value")
    votes = [F.count_if(trimmed.rlike(pattern)).alias(f"votes_{k}") for k, (pattern, _, _) in enumerate(TIME_FORMATS)]
    counted = stacked_values(df, names).filter(F.length("value") > 0).groupBy("column_name").agg(
        F.count(F.lit(1)).alias("filled"), *votes
    )
    shares = {r["column_name"]: [r[f"votes_{k}"] / r["filled"] for k in range(len(votes))] for r in counted.collect()}
    return {
        n: next((t for t, share in zip(TIME_FORMATS, shares.get(n, ())) if share >= VOTE), None) for n in names
    }


def normalize_periods(df: DataFrame, names: Sequence[str], dayfirst: bool = True) -> DataFrame:
    """Time columns as ISO text: ``YYYY-MM-DD``, or ``YYYY-MM`` for months. What does not parse stays (trimmed).

    ``dayfirst=False`` reads ``02/03/2024`` as 3 February.
    """
    texts = [n for n in names if isinstance(dtype_of(df, n), T.StringType)]
    formats = time_formats(df, texts)
    changed = {}
    for name in names:
        c, found = column(name), formats.get(name)
        if name not in texts:
            changed[name] = F.date_format(c, "yyyy-MM-dd")
        elif found is not None and found[1] == "M.yyyy":
            parts = F.split(F.trim(c), r"\.")
            iso = F.concat(F.get(parts, 1), F.lit("-"), F.lpad(F.get(parts, 0), 2, "0"))
            changed[name] = F.when(F.trim(c).rlike(found[0]), iso).otherwise(c)
        elif found is not None and found[1] is not None:
            fmt = "M/d/yyyy" if found[1] == "d/M/yyyy" and not dayfirst else found[1]
            changed[name] = F.coalesce(F.date_format(_date(c, fmt, found[0]), "yyyy-MM-dd"), F.trim(c))
    return df.withColumns(changed) if changed else df


def normalize_period(df: DataFrame, name: str, dayfirst: bool = True) -> DataFrame:
    return normalize_periods(df, [name], dayfirst)
