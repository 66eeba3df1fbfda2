"""Future rows made from past ones."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.periods import MONTH_NAMES, next_months
from ..functions.values import INTERNAL_COLUMNS, column, day_text, dtype_of, find_period, is_temporal, month_of, precise_avg
from ..plans.specs import ProjectionSpec, Rule
from .rules import apply_rules, screen_period

# Columns that describe the period or the origin of a row and so are not dimensions.
PERIOD_PARTS = (
    "_period", "period", "month_year", "_data_source", "_row_id", "_baseline_period", "_is_comparison_base",
    "_year", "_month", "year", "month", "month_name", "quarter",
)
AVERAGED = "_averaged"  # fixed value: template name of a month without base rows


def _period_text(df: DataFrame, period: str) -> Column:
    return day_text(column(period), dtype_of(df, period))


def with_text_period(df: DataFrame, period: str) -> DataFrame:
    """Native dates as ISO text, the form in which projected months are written."""
    return df.withColumn(period, _period_text(df, period)) if is_temporal(dtype_of(df, period)) else df


def _one_per_target(df: DataFrame, targets: Sequence[str], out: str) -> DataFrame:
    return df.withColumn(out, F.explode(F.array(*[F.lit(t) for t in targets])))


def last_period_and_missing(
    df: DataFrame, targets: Sequence[str], period: str
) -> tuple[str | None, list[str]]:
    """Last month of the table and the target months it has no rows for: one aggregate, one result row.

    Neither a maximum nor a set changes when rows repeat, so Spark leaves out the dimension joins of ``df``.
    """
    month = month_of(_period_text(df, period))
    present = F.collect_set(F.when(month.isin(*targets), month)) if targets else F.array().cast("array<string>")
    last, found = df.agg(F.max(month), present).first()
    return last, sorted(set(targets) - set(found or ()))


def project_future(df: DataFrame, targets: Sequence[str], period: str | None = None) -> DataFrame:
    """``df`` plus a copy of its last month for each target month it lacks, tagged in ``_data_source``.

    The rows are read once: a row of the last month becomes several, its own and one per target. Copies have no ``_row_id``
    and keep other native dates of their row.
    """
    name = period or find_period(df)
    if name is None or not targets:
        return df.withColumn("_data_source", F.lit("actual"))
    df = with_text_period(df, name)
    last, missing = last_period_and_missing(df, targets, name)
    if last is None or not missing:
        return df.withColumn("_data_source", F.lit("actual"))
    own = F.struct(column(name).alias("period"), F.lit("actual").alias("source"))
    copies = [F.struct(F.lit(t).alias("period"), F.lit("projected").alias("source")) for t in missing]
    return _repeated(df, month_of(column(name)) == last, own, copies, {name: "period", "_data_source": "source"})


def _repeated(df: DataFrame, template: Column, own: Column, copies: Sequence[Column], names: Mapping[str, str]) -> DataFrame:
    """Every row once as ``own``, template rows also as each of ``copies``; ``names`` maps columns to fields of the structs.

    Copies have a NULL ``_row_id``.
    """
    rows = df.select(
        "*", F.posexplode(F.when(template, F.array(own, *copies)).otherwise(F.array(own))).alias("_copy", "_as"))
    changed = {c: F.col("_as")[f] for c, f in names.items()}
    if "_row_id" in df.columns:
        changed["_row_id"] = F.when(F.col("_copy") == 0, F.col("_row_id"))
    return rows.withColumns(changed).drop("_copy", "_as")


def project(df: DataFrame, spec: ProjectionSpec | Mapping, value: str = "amount") -> DataFrame | None:
    """Projected rows only; ``None`` when the method or the table gives none by definition."""
    spec = ProjectionSpec.of(spec)
    period = find_period(df)
    if spec.method == "none":
        return None
    if spec.method == "copy_year":
        if not spec.source_year or period is None:
            return None
        return _copy_year(df, spec, value, period)
    if spec.method in ("average", "last_n_months"):
        return _average(df, spec, value, period)
    raise ValueError(f"unknown projection method {spec.method!r}")


def _copy_year(df: DataFrame, spec: ProjectionSpec, value: str, period: str) -> DataFrame:
    when = _period_text(df, period)
    moved = F.concat(F.lit(spec.target_year), F.substring(when, len(spec.source_year) + 1, 32))
    source = df.filter(when.startswith(spec.source_year)).drop("_row_id")
    return source.withColumns({
        period: moved,
        value: column(value).cast("double") * spec.growth,
        "_data_source": F.lit("projected"),
    })


def _with_copied_year(df: DataFrame, spec: ProjectionSpec, value: str, period: str) -> DataFrame:
    """The rows and the copies of the source year, from one read."""
    when, amount = _period_text(df, period), column(value).cast("double")
    moved = F.concat(F.lit(spec.target_year), F.substring(when, len(spec.source_year) + 1, 32))
    fields = lambda p, v, s: F.struct(p.alias("period"), v.alias("value"), F.lit(s).alias("source"))
    return _repeated(
        df, F.coalesce(when.startswith(spec.source_year), F.lit(False)), fields(when, amount, "actual"),
        [fields(moved, amount * spec.growth, "projected")], {period: "period", value: "value", "_data_source": "source"})


def _average(df: DataFrame, spec: ProjectionSpec, value: str, period: str | None) -> DataFrame | None:
    targets, source = list(spec.target_periods), df
    if period is not None:
        when = _period_text(df, period)
        if not targets:
            last = df.agg(F.max(when)).first()[0]
            targets = next_months(last, 12) if last else []
        if spec.method == "last_n_months":
            found = df.select(when.alias("p")).filter("p IS NOT NULL").distinct().orderBy(F.desc("p"))
            recent = [r["p"] for r in found.limit(int(spec.last_n)).collect()]
            source = df.filter(when.isin(*recent)) if recent else df.limit(0)
    if not targets:
        return None
    dims = [c for c in df.columns if c not in (value, period, *INTERNAL_COLUMNS)]
    mean = (precise_avg(column(value).cast("double")) * spec.growth).alias(value)
    if dims:
        averaged = source.groupBy(*[column(c) for c in dims]).agg(mean)
    else:
        averaged = source.agg(F.coalesce(mean, F.lit(0.0)).alias(value), F.count(F.lit(1)).alias("_n")).filter("_n > 0").drop("_n")
    rows = _one_per_target(averaged, targets, period or "_target")
    return (rows if period else rows.drop("_target")).withColumn("_data_source", F.lit("projected"))


def project_then_rules(
    df: DataFrame,
    spec: ProjectionSpec | Mapping | None,
    rules: Sequence[Rule | Mapping],
    value: str = "amount",
) -> DataFrame:
    """Actual rows plus projected rows, with the rules applied to both."""
    period = find_period(df)
    df = with_text_period(df, period) if period else df
    spec = ProjectionSpec.of(spec)
    if spec.method == "copy_year" and spec.source_year and period is not None:
        return apply_rules(_with_copied_year(df, spec, value, period), rules, value)
    combined = df.withColumn("_data_source", F.lit("actual"))
    projected = project(df, spec, value)
    if projected is not None:
        combined = combined.unionByName(projected, allowMissingColumns=True)
    return apply_rules(combined, rules, value)


def period_parts(df: DataFrame, target: Column) -> dict[str, Column]:
    """The period columns that ``df`` has, written for a target month."""
    month, year = F.substring(target, 6, 2), F.substring(target, 1, 4)
    number = month.cast("int")
    parts = {
        "_period": target, "period": target, "month_year": target,
        "year": year, "_year": year, "month": month, "_month": month,
        "month_name": F.element_at(F.array(*[F.lit(m) for m in MONTH_NAMES]), number),
        "quarter": F.concat(F.lit("Q"), F.ceil(number / 3).cast("string"), F.lit(" "), year),
    }
    return {name: c.try_cast(dtype_of(df, name)) for name, c in parts.items() if name in df.columns}


def _zero_rows(base: DataFrame, months: Sequence[str], value: str, dims: Sequence[str] | None) -> DataFrame:
    """A zero row per month and combination of the dimension columns: by default all but periods, native dates and the measure."""
    if dims is None:
        dims = [f.name for f in base.schema.fields if f.name not in PERIOD_PARTS and f.name not in (value, f"baseline_{value}")
                and not is_temporal(f.dataType)]
    empty = base.select(*[column(c) for c in dims]).distinct().withColumn(value, F.lit(0.0))
    return _one_per_target(empty, months, "_target").withColumn("_template", F.lit(AVERAGED))


def _with_templates(
    df: DataFrame, targets: Mapping[str, str | None], value: str, period: str, marks: Mapping[str, tuple[Column, str]],
    dims: Sequence[str] | None,
) -> DataFrame:
    """The rows plus, for each target month, the rows of its template month under the target, from one read.

    ``targets`` maps a month to its template month, or to ``None``: such months get zero rows, from an aggregate over the
    dimension columns. ``marks`` maps columns to their value on added rows and its type (NULL, or as it was, on others).
    """
    by_template: dict[str, list[str]] = {}
    for month, template in targets.items():
        if template is not None:
            by_template.setdefault(template, []).append(month)
    result = df.withColumns({c: F.lit(None).cast(kind) for c, (_, kind) in marks.items() if c not in df.columns})
    rows = result
    if by_template:
        month = month_of(_period_text(df, period))
        own = F.array(F.lit(None).cast("string"))
        wanted = None
        for template, months in by_template.items():
            branch = (month == template, F.concat(own, F.array(*[F.lit(m) for m in months])))
            wanted = F.when(*branch) if wanted is None else wanted.when(*branch)
        copied = result.select("*", month.alias("_template"), F.explode(wanted.otherwise(own)).alias("_target"))
        added = F.col("_target").isNotNull()
        under = {**period_parts(df, F.col("_target")), period: F.col("_target"), **{c: v for c, (v, _) in marks.items()}}
        changed = {c: F.when(added, v).otherwise(column(c)) for c, v in under.items()}
        if "_row_id" in df.columns:
            changed["_row_id"] = F.when(~added, F.col("_row_id"))
        rows = copied.withColumns(changed).drop("_template", "_target")
    unmatched = [m for m, t in targets.items() if t is None]
    if unmatched:
        zero = _zero_rows(df, unmatched, value, dims)
        zero = zero.withColumns({**period_parts(df, F.col("_target")), period: F.col("_target"), **{c: v for c, (v, _) in marks.items()}})
        rows = rows.unionByName(zero.drop("_target", "_template"), allowMissingColumns=True)
    return rows


def plan_seasonal(df: DataFrame, targets: Sequence[str], base_year: str | None, period: str) -> dict[str, str | None]:
    """Template month of each missing target month: the same month of the base year, if it has rows."""
    same = {t: f"{base_year}-{t[5:7]}" if base_year else None for t in targets}
    wanted = sorted({*targets, *[t for t in same.values() if t]})
    month = month_of(_period_text(df, period))
    if not wanted:
        return {}
    any_row, found = df.agg(F.max(F.lit(1)), F.collect_set(F.when(month.isin(*wanted), month))).first()
    if any_row is None:
        return {}
    return {t: same[t] if same[t] in found else None for t in sorted(targets) if t not in found}


def project_seasonal(
    df: DataFrame, targets: Sequence[str], base_year: str | None, value: str = "amount", period: str | None = None,
    dims: Sequence[str] | None = None,
) -> DataFrame:
    """``df`` plus rows for each target month it lacks: the same month of ``base_year``, or zero rows.

    Projected rows carry the target month in every period column, ``_data_source = 'projected'`` and the
    template month (or ``_averaged``) in ``_baseline_period``. Zero rows come for each combination of ``dims``.
    """
    name = period or screen_period(df)
    if name is None:
        return df
    return seasonal_rows(df, plan_seasonal(df, targets, base_year, name), value, name, dims)


def seasonal_rows(
    df: DataFrame, plan: Mapping[str, str | None], value: str, period: str, dims: Sequence[str] | None = None
) -> DataFrame:
    if not plan:
        return df
    marks = {"_data_source": (F.lit("projected"), "string"), "_baseline_period": (F.col("_template"), "string")}
    return _with_templates(with_text_period(df, period), plan, value, period, marks, dims)


def comparison_base(
    df: DataFrame, plan: Mapping[str, str | None], value: str = "amount", period: str | None = None, dims: Sequence[str] | None = None
) -> DataFrame:
    """Base rows plus, for each projected month of ``plan``, its template rows under the projected month."""
    name = period or screen_period(df)
    if name is None or not plan:
        return df
    return _with_templates(with_text_period(df, name), plan, value, name, {"_is_comparison_base": (F.lit(True), "boolean")}, dims)
