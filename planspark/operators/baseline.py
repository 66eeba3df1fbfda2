"""Fact table joined with its dimensions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.values import column, dtype_of, is_numeric, resolve, text
from ..plans.joins import plan_joins, prune_joins
from ..plans.specs import Relationship, TableModel

_KEY = "__join_key"


def first_per_key(dim: DataFrame, key: str) -> DataFrame:
    """One row per non-null key: the lowest ``_row_id``, or the smallest row when the table has no row id.

    A grouped minimum rather than a numbered window: each task keeps one row per key before the shuffle, so
    a key with a third of all rows costs nothing extra.
    """
    rest = [c for c in dim.columns if c != key]
    if not rest:
        return dim.filter(column(key).isNotNull()).distinct()
    order = sorted(rest, key=lambda c: c != "_row_id")
    best = F.min(F.struct(*[column(c) for c in order])).alias("_first")
    rows = dim.filter(column(key).isNotNull()).groupBy(column(key)).agg(best)
    return rows.select(*[column(c) if c == key else F.col("_first")[c].alias(c) for c in dim.columns])


def join_dimension(
    fact: DataFrame, dim: DataFrame, left: str, key: str, names: Mapping[str, str] | None = None, unique: bool = False
) -> DataFrame:
    """Left join that never multiplies fact rows. The dimension's key column is not repeated in the output.

    Keys of the same kind are compared as they are, others as text. ``names`` selects and renames the
    dimension's columns. No size hint is given: Spark broadcasts the dimension when its measured size is
    under the broadcast limit and otherwise sorts and merges, splitting partitions made large by a hot key.
    """
    left, key = resolve(fact, left), resolve(dim, key)
    names = dict(names) if names is not None else {c: c for c in dim.columns if c not in (key, "_row_id")}
    order = ["_row_id"] if "_row_id" in dim.columns and not unique else []
    side = dim.select(*[column(c) for c in dict.fromkeys([key, *order, *names])])
    side = side if unique else first_per_key(side, key)
    left_type, right_type = dtype_of(fact, left), dtype_of(dim, key)
    left_key, right_key = column(left), column(key)
    if left_type != right_type and not (is_numeric(left_type) and is_numeric(right_type)):
        left_key, right_key = text(left_key, left_type), text(right_key, right_type)
    side = side.select(right_key.alias(_KEY), *[column(c).alias(out) for c, out in names.items()])
    on = left_key == F.col(_KEY)
    if not unique:
        # The hash is implied by the key. As a second join key it makes Spark shuffle the grouped dimension
        # again instead of reusing its grouping, and only freshly shuffled sides can be split on a hot key.
        on = on & (F.xxhash64(left_key.cast(_wider(left_type, right_type))) == F.xxhash64(
            F.col(_KEY).cast(_wider(left_type, right_type))))
    return fact.join(side, on, "left").drop(_KEY)


def _wider(a: T.DataType, b: T.DataType) -> T.DataType:
    """Type in which both key forms hash alike."""
    if a == b:
        return a
    if isinstance(a, T.IntegralType) and isinstance(b, T.IntegralType):
        return T.LongType()
    return T.DoubleType() if is_numeric(a) and is_numeric(b) else T.StringType()


def build_baseline(
    model: TableModel,
    fact: str,
    relationships: Sequence[Relationship] | None = None,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """The fact table widened by every dimension that the relationships reach, one row per fact row.

    ``columns`` names the output columns wanted; joins that supply none of them are left out altogether.
    """
    chosen = model.relationships if relationships is None else relationships
    layout = {name: df.columns for name, df in model.tables.items()}
    steps = plan_joins(fact, layout, chosen)
    if columns is not None:
        steps = prune_joins(steps, columns)
    wide = model.tables[fact]
    for step in steps:
        is_unique = (step.table, step.key) in model.unique
        wide = join_dimension(wide, model.tables[step.table], step.left, step.key, step.names, is_unique)
    return wide if columns is None else wide.select(*[column(c) for c in columns])


def verify_unique(model: TableModel) -> DataFrame:
    """``table_name, column_name, repeated`` for every column that ``model.unique`` declares: rows beyond the first of a key.

    A wrong declaration multiplies fact rows, so check a model once before it is used; NULL keys don't count.
    """
    parts = []
    for name, key in sorted(model.unique):
        df = model.tables[name]
        per_key = df.filter(column(resolve(df, key)).isNotNull()).groupBy(column(resolve(df, key)).alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
        parts.append(per_key.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("repeated")).select(
            F.lit(name).alias("table_name"), F.lit(key).alias("column_name"), "repeated"))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found


def build_all_baselines(model: TableModel) -> dict[str, DataFrame]:
    """One lazy baseline for each table that takes part in a relationship."""
    linked = [n for r in model.relationships for n in (r.source, r.target)]
    return {name: build_baseline(model, name) for name in dict.fromkeys(linked) if name in model.tables}
