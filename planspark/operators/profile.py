"""Column profiles and roles."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.values import column, is_temporal, precise_sum, resolve, stacked_values, text_to_double, to_cents, to_double

SAMPLES = 20  # fixed value: sample values kept per column
SHARE = 0.8  # fixed value: share of texts that must look like a date or number

# Texts read as boolean.
BOOLEAN_WORDS = ("true", "false", "yes", "no", "1", "0", "ja", "nein")

# Texts read as a date or period.
DATE_SHAPES = (
    r"\d{4}-\d{2}-\d{2}", r"\d{4}-\d{2}", r"\d{2}\.\d{2}\.\d{4}", r"\d{2}/\d{2}/\d{4}", r"\d{4}/\d{2}/\d{2}",
    r"\d{1,2}\.\d{1,2}\.\d{2,4}", r"\d{1,2}\.\d{4}", r"\d{2}-\d{2}-\d{4}",
)

# Words that decide the role of a column.
TIME_WORDS = r"period|date|monat|month|year|jahr|datum|periode|quartal|quarter|woche|week"
KEY_ENDINGS = r"(_id|_code|_nr|_number|_num|konto|account|kostenstelle|cost.?center)$"
MEASURE_WORDS = (
    r"amount|betrag|wert|value|quantity|menge|total|summe|sum|umsatz|revenue|cost|kosten|aufwand|expense|gewinn|"
    r"profit|verlust|loss|saldo|balance"
)
IGNORED_WORDS = r"row.?count|entry.?count|zeilen.?anzahl|leer|empty"


@dataclass(frozen=True)
class ColumnProfile:
    column_name: str
    display_name: str
    data_type: str
    unique_count: int
    null_count: int
    sample_values: list[str] = field(default_factory=list)
    role: str = "attribute"
    calendar: str | None = None  # calendar column that the values match, judged by all of them

    def as_text(self) -> ColumnProfile:
        return replace(self, data_type="text")


def detect_role(
    name: str, data_type: str, unique: int, nulls: int, rows: int, samples: Sequence[str] = (), accounts: int | None = None
) -> str:
    """Role of a column from its name and profile; the first rule that holds decides.

    ``accounts`` is the number of rows whose value looks like an account number; without it the samples are judged.
    """
    def says(words: str) -> bool:
        return re.search(words, name, re.IGNORECASE) is not None

    account_like = (
        data_type == "integer" and 2 <= unique <= 500
        and (0 < accounts == rows - nulls if accounts is not None else len(samples) > 0 and all(re.fullmatch(r"\d{3,6}", str(s)) for s in samples))
    )
    rules = (
        ("ignore", (rows > 0 and nulls / rows > 0.5) or unique == 1 or says(IGNORED_WORDS)),
        ("time", data_type == "date" or (says(TIME_WORDS) and data_type in ("text", "integer"))),
        ("key", says(KEY_ENDINGS) or account_like),
        ("measure", data_type == "numeric" or (data_type == "integer" and says(MEASURE_WORDS))),
    )
    return next((role for role, holds in rules if holds), "attribute")


def detect_roles(profile: Sequence[ColumnProfile], rows: int) -> dict[str, str]:
    return {
        p.column_name: detect_role(p.display_name, p.data_type, p.unique_count, p.null_count, rows, p.sample_values)
        for p in profile
    }


def _looked_at(values: DataFrame) -> DataFrame:
    """Adds the trimmed text and the number in it: currency signs dropped, decimal comma and thousands dots read.

    Built in steps, so that each form of the text is computed once.
    """
    bare = F.replace(F.translate("value", "€$£¥ \t\u00a0", ""), F.lit(","), F.lit("."))
    stripped = values.select("*", F.trim("value").alias("_text"), bare.alias("_bare"))
    no_dots = F.replace("_bare", F.lit("."), F.lit(""))
    plain = stripped.select("*", F.when(F.col("_bare").rlike(r"\..*\."), no_dots).otherwise(F.col("_bare")).alias("_plain"))
    return plain.select(*values.columns, "_text", text_to_double(F.col("_plain")).alias("_number"))


def _text_facts(rows: Column) -> list[Column]:
    """What the texts of a column look like, each value weighted by its rows."""
    def rows_where(test: Column) -> Column:
        return F.coalesce(F.sum(F.when(test, rows)), F.lit(0))

    number, text_form = F.col("_number"), F.col("_text")
    short = F.length(text_form) <= max(map(len, BOOLEAN_WORDS))
    return [
        rows_where(F.col("value").isNotNull()).alias("filled"),
        rows_where(F.isnull("value")).alias("null_count"),
        rows_where(short & F.lower(text_form).isin(*BOOLEAN_WORDS)).alias("booleans"),
        rows_where((F.length(text_form) <= 10) & text_form.rlike("^(" + "|".join(DATE_SHAPES) + ")$")).alias("dates"),
        rows_where(number.isNotNull()).alias("numbers"),
        rows_where(number == F.floor(number)).alias("wholes"),
        rows_where(text_form.rlike(r"^\d{3,6}$")).alias("accounts"),
        rows_where(text_form.rlike(r"^\d{4}-\d{2}-\d{2}$")).alias("days"),
        rows_where(text_form.rlike(r"^\d{4}-\d{2}$")).alias("months"),
    ]


def _data_type(dtype: T.DataType, facts) -> str:
    if isinstance(dtype, T.IntegralType):
        return "integer"
    if isinstance(dtype, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "integer" if facts["numbers"] and facts["wholes"] == facts["numbers"] else "numeric"
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if is_temporal(dtype):
        return "date"
    if not isinstance(dtype, T.StringType) or not facts["filled"]:
        return "text"
    if facts["booleans"] == facts["filled"]:
        return "boolean"
    if facts["dates"] / facts["filled"] > SHARE:
        return "date"
    if facts["numbers"] / facts["filled"] > SHARE:
        return "integer" if facts["wholes"] == facts["numbers"] else "numeric"
    return "text"


def column_facts(df: DataFrame, samples: int = SAMPLES, approx: bool = False) -> DataFrame:
    """One row per column: ``unique_count`` (NULL is a value), ``null_count``, ``samples`` and counts of text shapes.

    Exact counts come from one shuffle of the distinct (column, value) pairs, combined before the shuffle, so a
    frequent value costs one row per task and is looked at once; ``samples`` are the smallest values in text order.
    ``approx=True`` sketches the distinct counts without shuffling values; its samples are the two extremes. What roles and
    calendar links ask of the texts (``accounts``, ``days``, ``months``) is counted over all values either way.
    """
    names = [c for c in df.columns if c != "_row_id"]
    values = stacked_values(df, names)
    if approx:
        ends = F.filter(F.array(F.min("value"), F.max("value")), lambda x: x.isNotNull())
        # this sketch also makes Spark aggregate by hash; text extremes alone would have every value sorted first
        unique = F.hll_sketch_estimate(F.hll_sketch_agg("value")) + F.max(F.isnull("value").cast("int"))
        return _looked_at(values).groupBy("column_name").agg(unique.alias("unique_count"), ends.alias("samples"), *_text_facts(F.lit(1)))
    pairs = values.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("rows"))
    counts = _looked_at(pairs).groupBy("column_name").agg(F.count(F.lit(1)).alias("unique_count"), *_text_facts(F.col("rows")))
    # Spark keeps the first rows of each task before it brings a column together
    ranked = Window.partitionBy("column_name").orderBy("value")
    first = pairs.filter("value IS NOT NULL").withColumn("_rank", F.row_number().over(ranked)).filter(F.col("_rank") <= samples)
    listed = first.groupBy("column_name").agg(F.sort_array(F.collect_list("value")).alias("samples"))
    return counts.join(listed, "column_name", "left")


def profile_columns(
    df: DataFrame,
    display_names: Mapping[str, str] | None = None,
    samples: int = SAMPLES,
    approx: bool = False,
) -> tuple[list[ColumnProfile], int]:
    """Profile and role of every column, and the row count, from one job with one result row per column."""
    return profiles_of(df.schema, column_facts(df, samples, approx), display_names)


def profiles_of(
    schema: T.StructType, facts: DataFrame, display_names: Mapping[str, str] | None = None
) -> tuple[list[ColumnProfile], int]:
    """Profiles and roles from the facts of :func:`column_facts`, and the row count."""
    shown = dict(display_names or {})
    facts = {r["column_name"]: r for r in facts.collect()}
    rows = max((f["filled"] + f["null_count"] for f in facts.values()), default=0)
    profiles = []
    for f in schema.fields:
        if f.name == "_row_id":
            continue
        display, found = shown.get(f.name, f.name), facts.get(f.name)
        if found is None:
            profiles.append(ColumnProfile(f.name, display, "text", 0, 0))
            continue
        kind, sample = _data_type(f.dataType, found), list(found["samples"] or [])
        unique, nulls = found["unique_count"], found["null_count"]
        role = detect_role(display, kind, unique, nulls, rows, sample, found["accounts"])
        calendar = "date" if found["days"] else "month_year" if found["months"] else None
        profiles.append(ColumnProfile(f.name, display, kind, unique, nulls, sample, role, calendar))
    return profiles, rows


def measure_stats(df: DataFrame, measures: Sequence[str]) -> DataFrame:
    """``column_name, min, max, sum`` per measure, rounded to cents; a measure without values is left out."""
    facts, lines = [], []
    for i, name in enumerate(measures):
        v = to_double(column(resolve(df, name)), df.schema[resolve(df, name)].dataType)
        facts += [F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}"), precise_sum(v).alias(f"s{i}"), F.count(v).alias(f"n{i}")]
        lines.append(F.struct(
            F.lit(name).alias("column_name"), to_cents(F.col(f"lo{i}")).alias("min"),
            to_cents(F.col(f"hi{i}")).alias("max"), to_cents(F.col(f"s{i}")).alias("sum"), F.col(f"n{i}").alias("_n"),
        ))
    return df.agg(*facts).select(F.inline(F.array(*lines))).filter("_n > 0").drop("_n")


def is_fact(profile: Sequence[ColumnProfile]) -> bool:
    """A fact table has at least one measure."""
    return any(p.role == "measure" for p in profile)


def default_fact(profiles: Mapping[str, Sequence[ColumnProfile]], calendar: str = "_calendar") -> str | None:
    """First fact table that is not the calendar."""
    return next((name for name, profile in profiles.items() if name != calendar and is_fact(profile)), None)
