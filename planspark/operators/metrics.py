"""Stored formula shapes run as aggregates: metrics, aggregate rules, ratios of two tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.values import (
    all_of, column, dtype_of, equal_to, literals_for, member_of, precise_avg, precise_sum, require_numeric, resolve,
)
from ..plans.specs import QuerySpec
from .query import run_query


def condition(df: DataFrame, test: Mapping) -> Column:
    """One filter of a formula: eq, neq, gt, lt, gte, lte, in, not_in, contains or between."""
    name, op, value = resolve(df, test["column"]), test.get("operator", "eq"), test.get("value")
    c, dtype = column(name), dtype_of(df, name)

    def one(v) -> Column:
        found = literals_for([v], dtype)
        if not found:
            raise ValueError(f"{v!r} cannot be compared with column {name!r} ({dtype.simpleString()})")
        return found[0] if isinstance(found[0], Column) else F.lit(found[0])

    tests = {
        "eq": lambda: equal_to(df, name, value),
        "neq": lambda: ~equal_to(df, name, value),
        "gt": lambda: c > one(value),
        "lt": lambda: c < one(value),
        "gte": lambda: c >= one(value),
        "lte": lambda: c <= one(value),
        "in": lambda: member_of(df, name, value),
        "not_in": lambda: ~member_of(df, name, value),
        "contains": lambda: c.cast("string").contains(str(value)),
        "between": lambda: c.between(one(value[0]), one(value[1])),
    }
    if op not in tests:
        raise ValueError(f"unknown operator {op!r}; use one of {', '.join(tests)}")
    return tests[op]()


def _figure(df: DataFrame, component: Mapping) -> Column:
    """A component's aggregate over the rows that pass its filters."""
    fn, filters = component.get("aggregation", "sum"), component.get("filters") or ()
    tests = [condition(df, t) for t in filters if t.get("column")]
    name = resolve(df, component["value_column"])
    if fn == "count":
        return F.count(F.when(all_of(tests), column(name))).cast("double")
    require_numeric(df, name)
    kept = F.when(all_of(tests), column(name).cast("double"))
    figures = {"sum": precise_sum, "avg": precise_avg, "mean": precise_avg, "min": F.min, "max": F.max}
    if fn not in figures:
        raise ValueError(f"unknown aggregation {fn!r}")
    return figures[fn](kept)


def eval_metric(
    tables: Mapping[str, DataFrame], components: Sequence[Mapping], by: Sequence[str] = (), out: str = "metric"
) -> DataFrame:
    """Signed sum of components, in total or per group.

    The components of a table share one aggregate over it. The figures of several tables are stacked and
    added up per group, so tables are never joined row by row; a group missing from a table adds 0.
    """
    used = dict.fromkeys(c["source_table"] for c in components)
    sides = []
    for table in used:
        df = tables[table]
        total, parts = None, [c for c in components if c["source_table"] == table]
        tests = [[condition(df, t) for t in part.get("filters") or () if t.get("column")] for part in parts]
        if not by and all(tests):
            # Rows that no component counts are left out at the scan; in groups they decide which groups there are.
            some = all_of(tests[0])
            for other in tests[1:]:
                some = some | all_of(other)
            df = df.filter(some)
        for part in parts:
            figure = F.coalesce(_figure(df, part), F.lit(0.0))
            signed = -figure if str(part.get("sign", "+")) in ("-", "-1") else figure
            total = signed if total is None else total + signed
        sides.append(df.groupBy(*[column(c) for c in by]).agg(total.alias(out)))
    stacked = sides[0]
    for side in sides[1:]:
        stacked = stacked.unionByName(side)
    return stacked if len(sides) == 1 else stacked.groupBy(*[column(c) for c in by]).agg(precise_sum(column(out)).alias(out))


def aggregate_rule(tables: Mapping[str, DataFrame], rule: Mapping) -> DataFrame:
    """``{source_table, operation_config: {group_by, aggregations, filters}}`` as one grouped query.

    Aggregations are a mapping, or a list of ``{column, function}``; filters are conditions.
    """
    df, config = tables[rule["source_table"]], rule.get("operation_config", rule)
    tests = [condition(df, t) for t in config.get("filters") or ()]
    chosen = config.get("aggregations") or {}
    if not isinstance(chosen, Mapping):
        chosen = {a["column"]: a.get("function", "sum") for a in chosen}
    spec = QuerySpec(group_by=tuple(config.get("group_by") or ()), aggregations=chosen, limit=0)
    return run_query(df.filter(all_of(tests)) if tests else df, spec)


def metric_ratio(
    numerator: DataFrame,
    numerator_value: str,
    denominator: DataFrame,
    denominator_value: str,
    by: Sequence[str],
    out: str = "ratio",
) -> DataFrame:
    """Sum of one table over the sum of another per shared group: each is aggregated first, then they meet.

    Groups of either table appear; the ratio is NULL where the denominator is 0 or missing.
    """
    def summed(df: DataFrame, value: str, name: str) -> DataFrame:
        require_numeric(df, value)
        other = "denominator" if name == "numerator" else "numerator"
        return df.groupBy(*[column(c) for c in by]).agg(
            precise_sum(column(resolve(df, value)).cast("double")).alias(name)
        ).withColumn(other, F.lit(None).cast("double"))

    stacked = summed(numerator, numerator_value, "numerator").unionByName(
        summed(denominator, denominator_value, "denominator")
    )
    both = stacked.groupBy(*[column(c) for c in by]).agg(
        F.coalesce(F.max("numerator"), F.lit(0.0)).alias("numerator"), F.max("denominator").alias("denominator")
    )
    return both.withColumn(out, F.try_divide("numerator", "denominator"))
