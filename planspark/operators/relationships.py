"""Join discovery: which columns of which tables share their values."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.values import column, dtype_of, resolve, text
from ..plans.specs import Relationship
from .profile import ColumnProfile

MIN_COVERAGE = 50  # fixed value: percent of source values that must exist in the target
CALENDAR = "_calendar"  # fixed value: name of the calendar table
WORD_BITS = 62  # tables per word of a bit set


def _key_text(df: DataFrame, name: str) -> Column:
    """Text under which equal keys of different numeric types are equal: whole numbers have no decimal places."""
    c, dtype = column(name), dtype_of(df, name)
    if isinstance(dtype, T.DecimalType):
        return F.when(c == F.floor(c), F.floor(c).cast("string")).otherwise(F.rtrim(c.cast("string"), F.lit("0")))
    if isinstance(dtype, T.FractionalType):
        exact = (c == F.floor(c)) & (F.abs(c) < 1e18)
        return F.when(exact, F.floor(c).cast("string")).otherwise(c.cast("string"))
    return text(c, dtype)


def relationship_coverage(src: DataFrame, src_col: str, tgt: DataFrame, tgt_col: str) -> DataFrame:
    """One row: ``coverage`` (whole percent of distinct source values found in the target) and ``overlap``.

    The values of both sides are stacked and reduced to one row per value, so no join is needed and a value
    repeated in a third of the rows is combined before the shuffle.
    """
    src_col, tgt_col = resolve(src, src_col), resolve(tgt, tgt_col)
    sides = src.select(_key_text(src, src_col).alias("v"), F.lit(1).alias("side")).unionByName(
        tgt.select(_key_text(tgt, tgt_col).alias("v"), F.lit(2).alias("side"))
    )
    per_value = sides.filter("v IS NOT NULL").groupBy("v").agg(F.bit_or("side").alias("sides"))
    counts = per_value.agg(
        F.count_if(F.col("sides").bitwiseAND(1) == 1).alias("known"), F.count_if(F.col("sides") == 3).alias("overlap")
    )
    percent = F.when(F.col("known") > 0, F.floor(F.col("overlap") * 100 / F.col("known"))).otherwise(F.lit(0))
    return counts.select(percent.cast("bigint").alias("coverage"), F.col("overlap").cast("bigint").alias("overlap"))


def relationship_scores(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Coverage of every pair of tables (in the given order) on each column name they share.

    Columns: ``source, target, column_name, coverage, overlap``. All tables go through one shuffle that leaves
    one row per (column, value) with a bit per table; the pairs are formed on the counts of those bit sets, by joins of
    small frames, so the plan does not grow with the number of pairs.
    """
    names = list(tables)
    owners: dict[str, list[int]] = {}
    for i, name in enumerate(names):
        for c in tables[name].columns:
            if c != "_row_id":
                owners.setdefault(c, []).append(i)
    shared = {c: found for c, found in owners.items() if len(found) > 1}
    words = [f"_o{w}" for w in range(-(-len(names) // WORD_BITS))]
    parts = []
    for i, name in enumerate(names):
        mine = [c for c, found in shared.items() if i in found]
        if mine:
            keys = tables[name].select(*[_key_text(tables[name], c).alias(c) for c in mine])
            bits = {w: F.lit(1 << i % WORD_BITS if k == i // WORD_BITS else 0).cast("bigint") for k, w in enumerate(words)}
            parts.append(keys.unpivot([], [column(c) for c in mine], "column_name", "value").withColumns(bits))
    spark = tables[names[0]].sparkSession
    if not parts:
        return spark.createDataFrame([], "source string, target string, column_name string, coverage bigint, overlap bigint")
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part)
    per_value = stacked.filter("value IS NOT NULL").groupBy("column_name", "value").agg(*[F.bit_or(w).alias(w) for w in words])
    per_set = per_value.groupBy("column_name", *words).agg(F.count(F.lit(1)).alias("n"))
    # From here on: a row per column and set of tables, then per column and pair of tables.
    held = F.flatten(F.array(*[_members(w, k * WORD_BITS) for k, w in enumerate(words)]))
    sets = per_set.select("column_name", "n", held.alias("held"))
    known = sets.select("column_name", "n", F.explode("held").alias("i")).groupBy("column_name", "i").agg(F.sum("n").alias("known"))
    both = (sets.select("column_name", "n", "held", F.explode("held").alias("i")).select("column_name", "n", "i", F.explode("held").alias("j"))
            .filter("i < j").groupBy("column_name", "i", "j").agg(F.sum("n").alias("overlap")))
    ids = spark.createDataFrame(list(enumerate(names)), "i int, name string")
    pairs = (known.join(known.select("column_name", F.col("i").alias("j")), "column_name").filter("i < j")
             .join(both, ["column_name", "i", "j"], "left").withColumn("overlap", F.coalesce("overlap", F.lit(0)).cast("bigint"))
             .join(ids.withColumnRenamed("name", "source"), "i")
             .join(ids.select(F.col("i").alias("j"), F.col("name").alias("target")), "j"))
    return pairs.select(
        "source", "target", "column_name", F.floor(F.col("overlap") * 100 / F.col("known")).cast("bigint").alias("coverage"), "overlap")


def _members(word: str, first: int) -> Column:
    """Numbers of the tables whose bit is set in a word."""
    bits = F.filter(F.sequence(F.lit(0), F.lit(WORD_BITS - 1)), lambda b: F.getbit(F.col(word), b) == 1)
    return F.transform(bits, lambda b: b + first)


def detect_relationships(
    tables: Mapping[str, DataFrame], min_coverage: int = MIN_COVERAGE, profiles: Mapping[str, Sequence[ColumnProfile]] | None = None
) -> DataFrame:
    """Pairs whose coverage reaches the minimum. With ``profiles``, measures and ignored columns are not compared."""
    if profiles is not None:
        tables = {
            name: df.select(*[column(p.column_name) for p in profiles[name] if p.role not in ("measure", "ignore")]) if name in profiles else df
            for name, df in tables.items()}
    return relationship_scores(tables).filter(F.col("coverage") >= min_coverage)


def as_relationships(detected: DataFrame) -> list[Relationship]:
    """Detected pairs as join relationships: at most one per pair of tables and shared column."""
    rows = detected.orderBy("source", "target", "column_name").collect()
    return [Relationship(r["source"], r["column_name"], r["target"], r["column_name"]) for r in rows]


def calendar_column(samples: Sequence[object]) -> str | None:
    """Calendar column that a time column with these values joins to."""
    shown = [str(s) for s in samples if s is not None]
    if any(re.fullmatch(r"\d{4}-\d{2}-\d{2}", s) for s in shown):
        return "date"
    return "month_year" if any(re.fullmatch(r"\d{4}-\d{2}", s) for s in shown) else None


def calendar_links(
    table: str, profile: Sequence[ColumnProfile], existing: Sequence[Relationship] = ()
) -> list[Relationship]:
    """A relationship from each time column to the calendar, unless there is one already."""
    linked = {r.source_column for r in existing if r.source == table and r.target == CALENDAR}
    links = []
    for p in profile:
        target = (p.calendar or calendar_column(p.sample_values)) if p.role == "time" and p.column_name not in linked else None
        if target:
            links.append(Relationship(table, p.column_name, CALENDAR, target))
    return links
