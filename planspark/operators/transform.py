"""Declarative column steps: reclassification, calculated column, concatenation, rename."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.errors import AnalysisException

from ..functions.values import column, dtype_of, resolve, to_double
from ..sources.versions import VersionedTable
from .query import value_counts

PREVIEW_ROWS = 200  # fixed value: rows of a preview
DEFAULT_CLASS = "Other"  # fixed value: class of a row that no rule matches

# Stored type of a step's output column.
OUTPUT_TYPES = {"text": "string", "numeric": "decimal(18,4)", "integer": "bigint", "boolean": "boolean"}


def _matches(source: Column, test: Mapping) -> Column | None:
    """Condition on the text form of the source column; ``None`` for an operator that does not exist."""
    op, values, value = test["op"], test.get("values", ()), str(test.get("value"))
    if op == "between":
        return source.between(str(values[0]), str(values[1]))
    if op == "in":
        return source.isin(*[str(v) for v in values]) if values else F.lit(False)
    simple = {
        "equals": lambda: source == value,
        "not_equals": lambda: source != value,
        "contains": lambda: source.contains(value),
        "starts_with": lambda: source.startswith(value),
    }
    return simple[op]() if op in simple else None


def reclassify(df: DataFrame, source: str, output: str, rules: Sequence[Mapping]) -> DataFrame:
    """First matching rule gives the class. A ``{"default": x}`` entry may stand anywhere; the last one counts."""
    text_form = column(resolve(df, source)).cast("string")
    default, branches = DEFAULT_CLASS, None
    for rule in rules:
        if "default" in rule:
            default = DEFAULT_CLASS if rule["default"] is None else rule["default"]
            continue
        test = _matches(text_form, rule["condition"])
        if test is not None:
            branches = (F if branches is None else branches).when(test, F.lit(rule["result"]))
    return df.withColumn(output, F.lit(default) if branches is None else branches.otherwise(F.lit(default)))


def arithmetic(df: DataFrame, node: Mapping, null_as_zero: bool = False) -> Column:
    """Column for an expression tree of ``{column}``, ``{literal}`` and ``{op, left, right}`` nodes."""
    if "column" in node:
        name = resolve(df, node["column"])
        number = to_double(column(name), dtype_of(df, name))
        return F.coalesce(number, F.lit(0.0)) if null_as_zero else number
    if "literal" in node:
        return F.lit(float(node["literal"]))
    op = node["op"]
    unary = {
        "abs": F.abs,
        "negate": F.negative,
        "round": lambda c: F.round(c, int(node.get("decimals", 2))),
    }
    binary = {
        "add": lambda a, b: a + b,
        "subtract": lambda a, b: a - b,
        "multiply": lambda a, b: a * b,
        "divide": F.try_divide,
    }
    if op in unary:
        return unary[op](arithmetic(df, node["left"], null_as_zero))
    if op in binary:
        return binary[op](arithmetic(df, node["left"], null_as_zero), arithmetic(df, node["right"], null_as_zero))
    raise ValueError(f"unknown arithmetic op: {op!r}")


def calculate(df: DataFrame, output: str, expression: Mapping) -> DataFrame:
    """Calculated column. ``null_handling`` is read from the root of the expression only."""
    zero = expression.get("null_handling", "null") == "zero"
    return df.withColumn(output, arithmetic(df, expression, zero))


def concat_columns(df: DataFrame, columns: Sequence[str], output: str, separator: str = " ") -> DataFrame:
    """Text forms joined by the separator; a NULL counts as empty text and keeps its separator."""
    parts = []
    for name in columns:
        if parts:
            parts.append(F.lit(separator))
        parts.append(F.coalesce(column(resolve(df, name)).cast("string"), F.lit("")))
    return df.withColumn(output, F.concat(*parts) if parts else F.lit(""))


def apply_step(df: DataFrame, step: Mapping) -> DataFrame:
    kind = step["step_type"]
    if kind == "reclassification":
        return reclassify(df, step["source_column"], step["output_column"], step["rules"])
    if kind == "calculated_column":
        return calculate(df, step["output_column"], step["expression"])
    if kind == "concat":
        return concat_columns(df, step["columns"], step["output_column"], step.get("separator", " "))
    if kind == "rename":
        return df.withColumnRenamed(resolve(df, step["from_column"]), step["to_column"])
    raise ValueError(f"unknown step type: {kind!r}")


def apply_steps(df: DataFrame, steps: Sequence[Mapping]) -> DataFrame:
    """Pending and approved steps in ``step_order``, each output stored in its declared type.

    All steps fold into the same scan. :func:`materialize_steps` stores the result as a new version of a table.
    """
    todo = [s for s in steps if s.get("status", "pending") in ("pending", "approved")]
    for step in sorted(todo, key=lambda s: s.get("step_order", 0)):
        df = apply_step(df, step)
        output, stored = step.get("output_column"), OUTPUT_TYPES.get(step.get("output_type"))
        if output and stored:
            df = df.withColumn(output, column(output).try_cast(stored))
    return df


@dataclass(frozen=True)
class Materialized:
    """What storing steps did: the steps with their new status, rows covered by column steps (renames cover none), rows whose values moved,
    partitions written and the version they led to."""

    steps: list[dict]
    rows: int
    moved: int
    partitions: list[str]
    version: int


def materialize_steps(table: VersionedTable, steps: Sequence[Mapping]) -> Materialized:
    """Apply pending and approved steps to a stored table, in ``step_order``.

    Column steps that follow each other are folded into one update, which writes only the partitions in which a value differs; a rename
    is an entry in the table's log. A step that fails leaves the table at the version before its update, and steps not reached
    keep their status. Steps already applied or rejected are passed over.
    """
    done, rows, moved, partitions = [dict(s) for s in steps], 0, 0, set()
    todo = sorted((s for s in done if s.get("status", "pending") in ("pending", "approved")), key=lambda s: s.get("step_order", 0))
    while todo:
        if todo[0]["step_type"] == "rename":
            table.rename(todo[0]["from_column"], todo[0]["to_column"])
            batch, todo = todo[:1], todo[1:]
        else:
            until = next((i for i, s in enumerate(todo) if s["step_type"] == "rename"), len(todo))
            batch, todo = todo[:until], todo[until:]
            outputs = list(dict.fromkeys(s["output_column"] for s in batch))
            found = table.update(lambda df, b=batch: apply_steps(df, b), outputs)
            rows, moved = rows + found.rows * len(batch), moved + found.moved
            partitions |= set(found.partitions)
        for step in batch:
            step["status"] = "applied"
    return Materialized(done, rows, moved, sorted(partitions), table.version().number)


def mark_applied(steps: Sequence[Mapping]) -> list[dict]:
    """The steps with the ones that :func:`apply_steps` runs set to applied."""
    return [{**s, "status": "applied"} if s.get("status", "pending") in ("pending", "approved") else dict(s) for s in steps]


def reject(step: Mapping) -> dict:
    """The step set to rejected; an applied step has already changed the table and cannot be."""
    if step.get("status") == "applied":
        raise ValueError("an applied step cannot be rejected")
    return {**step, "status": "rejected"}


def output_role(step: Mapping) -> str:
    """Role of a step's output column."""
    return "attribute" if step.get("output_type", "text") == "text" else "measure"


@dataclass(frozen=True)
class Preview:
    columns_before: list[str] = field(default_factory=list)
    columns_after: list[str] = field(default_factory=list)
    new_columns: list[str] = field(default_factory=list)
    removed_columns: list[str] = field(default_factory=list)
    new_column_stats: dict[str, DataFrame] = field(default_factory=dict)
    affected_rows: int = 0
    sample: DataFrame | None = None
    error: str | None = None


def preview_step(
    df: DataFrame, step: Mapping, n: int = PREVIEW_ROWS, order_by: Sequence[str] = ()
) -> Preview:
    """Effect of one step on the first ``n`` rows; an invalid step gives ``error`` instead of raising.

    ``order_by`` fixes which rows come first. Without it any ``n`` rows are read, which stops the scan early.
    """
    head = (df.orderBy(*[column(c) for c in order_by]) if order_by else df).limit(n)
    try:
        result = apply_step(head, step)
        result.schema
    except (ValueError, KeyError, AnalysisException) as problem:
        return Preview(columns_before=df.columns, error=str(problem))
    new = [c for c in result.columns if c not in df.columns]
    return Preview(
        columns_before=df.columns,
        columns_after=result.columns,
        new_columns=new,
        removed_columns=[c for c in df.columns if c not in result.columns],
        new_column_stats={c: value_counts(result, c) for c in new},
        affected_rows=head.count(),
        sample=result,
    )
