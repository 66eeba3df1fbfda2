"""Delimited files in, typed Parquet tables in and out."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.values import column, is_temporal, resolve
from ..operators.profile import ColumnProfile, profile_columns
from .infer import coerce_types, infer_types, normalize_periods
from .naming import sanitize_columns
from .quoted import read_quoted
from .versions import FileLog

SEPARATORS = (",", ";", "\t", "|")  # fixed values, in order of preference
NULL_TOKENS = ("NA", "N/A", "#N/A", "null", "NULL", "-")  # fixed values
DELIMITED_SUFFIXES = (".csv", ".tsv", ".txt")  # fixed values

RANGE_BITS = 45  # a load that appends takes 2**45 row ids ...
TASK_BITS = 27   # ... of which each task has 2**27

# Stored type of each logical type.
STORED_TYPES = {"text": "string", "numeric": "decimal(18,4)", "integer": "bigint", "boolean": "boolean", "date": "date"}


def sniff_separator(header: str) -> str:
    """Separator that occurs most often in the header line, a comma when none does."""
    return max(SEPARATORS, key=header.count)


def read_delimited(
    spark: SparkSession,
    path: str,
    sep: str | None = None,
    null_tokens: Sequence[str] = NULL_TOKENS,
    multi_line: bool = False,
) -> DataFrame:
    """Delimited text with a header line, every column as text; null tokens and empty fields become NULL.

    ``path`` may be a file, a folder or a pattern. A byte order mark is dropped; broken UTF-8 is replaced.
    ``multi_line=True`` allows line breaks inside quotes; a large file is still read by many tasks, see :func:`read_quoted`.
    """
    if sep is None:
        first = None if path.lower().endswith(".tsv") else spark.read.text(path).first()
        sep = "\t" if path.lower().endswith(".tsv") else sniff_separator(first[0] if first else "")
    raw = read_quoted(spark, path, sep) if multi_line else spark.read.csv(path, sep=sep, header=True, inferSchema=False, escape='"')
    names = [c.lstrip("﻿") for c in raw.columns]
    raw = raw.toDF(*names)
    return raw.select(*[F.when(~column(c).isin(*null_tokens), column(c)).alias(c) for c in names])


@dataclass(frozen=True)
class IngestResult:
    df: DataFrame
    profile: list[ColumnProfile] = field(default_factory=list)
    row_count: int = 0


def ingest_table(
    spark: SparkSession,
    path: str,
    sep: str | None = None,
    infer_bool_digits: bool = True,
    decimal_style: str = "us",
    dayfirst: bool = True,
    approx: bool = False,
) -> IngestResult:
    """Read a delimited file into a typed table with safe names, a column profile and ISO time columns."""
    safe, display = read_typed(spark, path, sep, infer_bool_digits, decimal_style)
    return profiled(safe, display, dayfirst, approx)


def read_typed(
    spark: SparkSession, path: str, sep: str | None = None, infer_bool_digits: bool = True, decimal_style: str = "us"
) -> tuple[DataFrame, dict[str, str]]:
    """A delimited file with inferred types and safe names, and the names as they were."""
    if not re.search(r"\.(csv|tsv|txt)/?$", path.lower()):
        raise ValueError(f"unsupported file type: {path}; use one of {', '.join(DELIMITED_SUFFIXES)}")
    typed = infer_types(read_delimited(spark, path, sep), infer_bool_digits, decimal_style=decimal_style)
    return sanitize_columns(typed)


def profiled(safe: DataFrame, display: Mapping[str, str], dayfirst: bool = True, approx: bool = False) -> IngestResult:
    """Profile of a typed table; its time columns become ISO text."""
    profile, rows = profile_columns(safe, display_names=display, approx=approx)
    times = [p.column_name for p in profile if p.role == "time"]
    iso = normalize_periods(safe, [n for n in times if _is_time_like(safe, n)], dayfirst)
    # Time columns are text, also those of whole numbers, and the profile shows them as they are now.
    iso = iso.withColumns({n: column(n).cast("string") for n in times if not isinstance(iso.schema[n].dataType, T.StringType)}) if times else iso
    if times:
        fresh = {p.column_name: p for p in profile_columns(iso.select(*[column(n) for n in times]), display_names=display, approx=approx)[0]}
        profile = [replace(p.as_text(), sample_values=fresh[p.column_name].sample_values, unique_count=fresh[p.column_name].unique_count,
                           calendar=fresh[p.column_name].calendar)
                   if p.column_name in fresh else p for p in profile]
    return IngestResult(iso, profile, rows)


def _is_time_like(df: DataFrame, name: str) -> bool:
    dtype = df.schema[name].dataType
    return isinstance(dtype, T.StringType) or is_temporal(dtype)


def write_table(df: DataFrame, path: str, partition_by: str | None = None, mode: str = "overwrite") -> int:
    """Write Parquet and return the rows written.

    The rows are counted from the footers of the written files, since a metric observed while writing counts
    rows twice when a lost executor's tasks run again. With ``partition_by`` the rows are first rebalanced on
    that column, which cuts a period holding much of the data into several files instead of one task.
    """
    if mode not in ("overwrite", "append"):
        raise ValueError(f"mode must be overwrite or append, got {mode!r}")
    before = stored_rows(df.sparkSession, path) if mode == "append" else 0
    if partition_by:
        df.hint("rebalance", resolve(df, partition_by)).write.mode(mode).partitionBy(partition_by).parquet(path)
    else:
        df.write.mode(mode).parquet(path)
    return stored_rows(df.sparkSession, path) - before


def stored_rows(spark: SparkSession, path: str) -> int:
    """Rows of a stored table, 0 when there is none yet."""
    try:
        return spark.read.parquet(path).count()
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0


def write_typed(
    df: DataFrame, types: Mapping[str, str], path: str, partition_by: str | None = None, mode: str = "overwrite"
) -> int:
    """Coerce to the declared types, add ``_row_id`` and write with :func:`write_table`.

    Rows appended to a stored table get ids from a range of their own, reserved before they are written, so ids
    stay unique when several loads run at the same time.
    """
    typed = coerce_types(df, types)
    stored = [column(n).try_cast(STORED_TYPES[types.get(n, "text")]).alias(n) for n in typed.columns if n != "_row_id"]
    row_id = F.monotonically_increasing_id()
    if mode == "append":
        row_id = _in_range(row_id, reserve_row_ids(df.sparkSession, path))
    return write_table(typed.select(*stored).withColumn("_row_id", row_id), path, partition_by, mode)


def _in_range(row_id: Column, start: int) -> Column:
    """Ids of one reserved range: so many for each task, in the order of its rows."""
    task, row = F.shiftright(row_id, 33), row_id.bitwiseAND(F.lit((1 << 33) - 1))
    fits = (task < 1 << (RANGE_BITS - TASK_BITS)) & (row < 1 << TASK_BITS)
    return F.when(fits, F.lit(start) + F.shiftleft(task, TASK_BITS) + row).otherwise(F.raise_error(F.lit("more rows than one range of row ids holds")).cast("long"))


def reserve_row_ids(spark: SparkSession, path: str) -> int:
    """First id of a range that no other load of the table at ``path`` uses.

    A range is taken by creating a file with its number beside the table's own files (readers pass over names that begin
    with an underscore); where another load was first, the next number is tried. Ranges begin above the ids stored.
    """
    files = FileLog(spark, path)
    number = (_last_row_id(spark, path) >> RANGE_BITS) + 1
    while True:
        number = max([number, *(int(n) + 1 for n in files.names("_ids") if n.isdigit())])
        if files.publish("", "_ids", f"{number:010d}"):
            return number << RANGE_BITS


def _last_row_id(spark: SparkSession, path: str) -> int:
    """Largest ``_row_id`` of a stored table, -1 when there is none; the maximum comes from the files' footers."""
    try:
        stored = spark.read.parquet(path)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return -1
    if "_row_id" not in stored.columns:
        return -1
    last = stored.agg(F.max("_row_id")).first()[0]
    return -1 if last is None else last


def export_rows(df: DataFrame) -> DataFrame:
    """Columns fit for JSON: dates as ISO text, decimals as doubles, NaN as NULL."""
    safe = []
    for f in df.schema.fields:
        c = column(f.name)
        if isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif is_temporal(f.dataType):
            whole = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
            c = F.when(F.date_format(c, "SSSSSS") == "000000", whole).otherwise(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
        elif isinstance(f.dataType, (T.DecimalType, T.FloatType, T.DoubleType)):
            c = F.nanvl(c.cast("double"), F.lit(None).cast("double"))
        safe.append(c.alias(f.name))
    return df.select(*safe)
