"""Ordered what-if rules over one measure.

A rule that spreads an amount needs totals of the rows it matches, at the values left by the rules before it.
Asking Spark for those totals rule by rule would read the table once per rule. Instead the rows are reduced
once to *cells*: which rules match, the sign of the value and, where a rule needs it, the period. All rows
of a cell are scaled alike, so the totals of later rules follow from the cells on the driver. Too many cells for the
driver stay a stored table, on which each rule is folded by a grouped aggregate. Where cells cannot say what becomes of the
rows (an even spread that crosses zero, rounding of every row), the rows are reduced to distinct values with their
number instead, which is exact for any rule. Either way the rules of a chain end as column expressions on the input rows,
with the shares of periods joined once.
"""

from __future__ import annotations

import logging
import math
from collections import defaultdict
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.periods import month_range
from ..functions.values import (
    PERIOD_NAMES, SCREEN_PERIOD_NAMES, all_of, column, day_text, dtype_of, find_period, half_up_cents, member_of,
    period_at_least, period_at_most, period_between, precise_sum, require_numeric, to_cents,
)
from ..plans.specs import Rule
from ..sources.shared import settle

log = logging.getLogger(__name__)

MAX_CELLS = 50_000  # cells brought to the driver per pass; more of them stay a stored table
MAX_FLAGS = 60  # rules per pass, one bit each


def screen_period(df: DataFrame) -> str | None:
    return find_period(df, SCREEN_PERIOD_NAMES) or find_period(df, PERIOD_NAMES)


def rule_mask(df: DataFrame, rule: Rule | Mapping, period_mode: str = "prefix", mode: str = "server") -> Column:
    """Rows the rule applies to: every filter and the period range hold; never NULL.

    A filter on a missing column is skipped with a warning. In ``screen`` mode an empty value list is no filter
    and a row without a period is inside every range.
    """
    rule, tests = Rule.of(rule), []
    for name, wanted in rule.filters.items():
        values = list(wanted) if isinstance(wanted, (list, tuple, set)) else [wanted]
        if mode == "screen" and not values:
            continue
        if name in df.columns:
            tests.append(member_of(df, name, values))
        elif mode == "screen":
            tests.append(F.lit(False))
        else:
            log.warning("filter column %r not found, skipped", name)
    period = screen_period(df) if mode == "screen" else find_period(df)
    if rule.period_from or rule.period_to:
        if period is None:
            if mode == "server":
                log.warning("rule %r has a period range but the table has no period column", rule.name)
        elif mode == "screen":
            dtype = dtype_of(df, period)
            if rule.period_from:
                tests.append(F.coalesce(period_at_least(column(period), dtype, rule.period_from), F.lit(True)))
            if rule.period_to:
                upto = period_at_most(column(period), dtype, rule.period_to, "lexical")
                tests.append(F.coalesce(upto, F.lit(True)))
        else:
            tests.append(period_between(df, period, rule.period_from, rule.period_to, period_mode))
    return F.coalesce(all_of(tests), F.lit(False)) if tests else F.lit(True)


@dataclass
class _Cell:
    """Rows that every rule treats alike. ``sign`` is ``None`` where the value is NULL: such rows count, but stay NULL."""

    flags: int
    sign: int | None
    period: str | None
    rows: int
    total_abs: float
    known: bool = True

    def scale(self, factor: float) -> None:
        self.total_abs *= abs(factor)
        if self.sign is not None:
            self.sign *= (factor > 0) - (factor < 0)

    def shift(self, amount: float) -> None:
        direction = (amount > 0) - (amount < 0)
        if self.sign is None or direction == 0:
            return
        if self.sign in (0, direction):
            self.sign, self.total_abs = direction, self.total_abs + abs(amount) * self.rows
        else:
            self.known = False  # some rows may have crossed zero


class _NeedsNewPass(Exception):
    pass


@dataclass(frozen=True)
class _Step:
    """How one rule changes a matched value: ``v * factor + |v| * share + shift (+ shift of its period)``."""

    rule: Rule
    factor: float = 1.0
    share: float = 0.0
    shift: float = 0.0
    by_period: Mapping[str | None, float] | None = None
    shares: DataFrame | None = None  # the same as a stored table ``_p, share``, where periods are too many


def _spreads(rule: Rule) -> bool:
    """Whether the rule needs totals of its matched rows."""
    if rule.type == "multiplier":
        return rule.distribution == "equal"
    return rule.offset != 0.0


def _needs_abs(rule: Rule) -> bool:
    return rule.type == "multiplier" or rule.distribution != "equal"


def _per_period(rule: Rule, mode: str, period: str | None) -> bool:
    """Whether an even spread is first divided by period. On screen a table without periods is one period."""
    if rule.distribution != "equal":
        return False
    return mode == "screen" or (rule.type == "offset" and period is not None)


def apply_rules(
    df: DataFrame,
    rules: Sequence[Rule | Mapping],
    value: str = "amount",
    mode: str = "server",
    period_mode: str = "prefix",
    max_cells: int = MAX_CELLS,
) -> DataFrame:
    """Apply rules in order; later rules see the values left by earlier ones.

    Adds ``baseline_<value>`` once (kept if present) in server mode. A table without the value column is
    returned unchanged. ``mode="screen"`` rounds each touched value to cents per rule, reads NULL as 0 and
    counts the months of the rule's own range in even spreads. Chains of plain multipliers run no job; other
    chains read the needed columns of ``df`` once before the result is built, and once more if there are more than
    ``max_cells`` cells or an even spread may cross zero, however many rules there are. A filter on the value itself, and every 60 rules, start anew from the values left so far.
    """
    if mode not in ("server", "screen"):
        raise ValueError(f"unknown mode {mode!r}")
    if value not in df.columns:
        log.warning("value column %r not found", value)
        return df
    require_numeric(df, value)
    original = column(value).cast("double")
    kept = f"baseline_{value}"
    if mode == "server" and kept not in df.columns:
        df = df.withColumn(kept, original)
    current = df.withColumn(value, original)

    todo = []
    for spec in rules:
        rule = Rule.of(spec)
        if rule.type not in ("multiplier", "offset"):
            log.warning("unknown rule type %r, skipped", rule.type)
        elif rule.type == "multiplier" or rule.offset != 0.0 or mode == "screen":
            todo.append(rule)

    # masks name columns only, so those built on the first table hold on all later ones
    masks = [rule_mask(current, rule, period_mode, mode) for rule in todo]
    period = _period_column(current, mode)
    key = _period_text(current, period)
    while todo:
        steps, current, solved = _next_steps(current, todo, masks, value, mode, period, key, max_cells)
        current = _apply_all(current, steps, masks, value, mode, key)
        todo, masks = todo[solved:], masks[solved:]
    return current


def _period_column(df: DataFrame, mode: str) -> str | None:
    return screen_period(df) if mode == "screen" else find_period(df)


def _period_text(df: DataFrame, period: str | None) -> Column:
    return F.lit(None).cast("string") if period is None else day_text(column(period), dtype_of(df, period))


def _next_steps(df, todo, masks, value, mode, period, key, max_cells):
    """Steps still to apply, the table, and how many rules they solve: as many as one pass can, at least one."""
    batch = []
    for rule in todo[:MAX_FLAGS]:
        if batch and value in rule.filters:
            break  # its filter must see the values left by the rules before it
        batch.append(rule)
    if not any(_spreads(r) for r in batch):
        steps = [_Step(r, factor=r.factor if r.type == "multiplier" else 1.0) for r in batch]
        return steps, df, len(steps)

    flagged = _flagged(df, batch, masks, value, mode, period, key)
    rounds = mode == "screen" and sum(_spreads(r) and _needs_abs(r) for r in batch) > 1
    try:
        return (_stored_steps(_Values(flagged, mode), batch, mode, period) if rounds else
                _cell_steps(flagged, batch, mode, period, max_cells)), df, len(batch)
    except _NeedsNewPass:
        return _stored_steps(_Values(flagged, mode), batch, mode, period), df, len(batch)


def _flagged(df, batch, masks, value, mode, period, key) -> DataFrame:
    """``flags, period, v`` of the rows that any rule matches: one bit a rule, the period only where a rule asks for it."""
    flags = F.lit(0).cast("bigint")
    for position, mask in enumerate(masks[:len(batch)]):
        flags = flags + F.when(mask, F.lit(1 << position)).otherwise(F.lit(0))
    by_period = any(_per_period(r, mode, period) for r in batch)
    return df.select(flags.alias("flags"), (key if by_period else F.lit(None).cast("string")).alias("period"),
                     column(value).alias("v")).filter("flags > 0")


def _cell_steps(flagged, batch, mode, period, max_cells) -> list[_Step]:
    """Steps from one aggregate over the rows, solved on the driver or, with too many cells for it, on a stored table."""
    grouped = flagged.groupBy("flags", "period", F.signum("v").alias("sign")).agg(
        F.count(F.lit(1)).alias("rows"), precise_sum(F.abs("v")).alias("total_abs"))
    found = grouped.limit(max_cells + 1).collect()
    if len(found) > max_cells:
        # The rare case pays one more reading of the rows; storing the cells of every chain would cost each of them more.
        return _stored_steps(_Cells(settle(grouped), mode), batch, mode, period)
    signs = [None if r["sign"] is None else (r["sign"] > 0) - (r["sign"] < 0) for r in found]
    cells = [_Cell(r["flags"], s, r["period"], r["rows"], r["total_abs"]) for r, s in zip(found, signs)]
    return [_solve(rule, [c for c in cells if c.flags >> position & 1], mode, period) for position, rule in enumerate(batch)]


def _hit(position: int) -> Column:
    return F.col("flags").bitwiseAND(F.lit(1 << position)) != 0


class _Values:
    """Distinct values of the rows that the rules treat alike, with their number, as a stored table ``flags, period, v, n``.

    A row's fate depends on nothing else, so totals are those of the rows under any rule, rounding included. The table is never
    longer than the rows, and far shorter where amounts repeat.
    """

    def __init__(self, flagged: DataFrame, mode: str):
        self.mode = mode
        self.table = settle(flagged.groupBy("flags", "period", "v").agg(F.count(F.lit(1)).alias("n")))

    def measures(self) -> list[Column]:
        size = F.abs("v")
        whole = F.floor(size).cast("double")
        total = F.coalesce(F.sum(whole * F.col("n")), F.lit(0.0)) + F.coalesce(F.sum((size - whole) * F.col("n")), F.lit(0.0))
        return [F.sum("n").alias("n"), total.alias("t"), F.lit(True).alias("known")]

    def change(self, step: _Step, position: int, shift: Column) -> list[Column]:
        return [F.col("flags"), F.col("period"), _changed(step, _hit(position), shift, F.col("v"), self.mode).alias("v"), F.col("n")]


class _Cells:
    """Too many cells for the driver, as a stored table ``flags, period, sign, rows, total, known``; see ``_Cell``."""

    def __init__(self, grouped: DataFrame, mode: str):
        self.mode = mode
        self.table = grouped.select("flags", "period", F.col("sign").cast("int").alias("sign"), "rows", F.col("total_abs").alias("total"),
                                    F.lit(True).alias("known"))

    def measures(self) -> list[Column]:
        return [F.sum("rows").alias("n"), precise_sum(F.col("total")).alias("t"), F.coalesce(F.bool_and("known"), F.lit(True)).alias("known")]

    def change(self, step: _Step, position: int, shift: Column) -> list[Column]:
        sign, total, known, hit = F.col("sign"), F.col("total"), F.col("known"), _hit(position)
        if self.mode == "screen":
            new = (sign, total, F.lit(False))
        elif step.by_period is not None or step.shift:
            way = F.signum(shift).cast("int")
            along = (way != 0) & sign.isNotNull() & ((sign == 0) | (sign == way))
            new = (F.when(along, way).otherwise(sign), F.when(along, total + F.abs(shift) * F.col("rows")).otherwise(total),
                   known & (along | sign.isNull() | (way == 0)))
        else:
            factor = F.lit(step.factor) + F.coalesce(sign, F.lit(0)) * F.lit(step.share)
            new = (sign * F.signum(factor).cast("int"), total * F.abs(factor), known)
        return [F.col("flags"), F.col("period"), F.when(hit, new[0]).otherwise(sign).alias("sign"), F.col("rows"),
                F.when(hit, new[1]).otherwise(total).alias("total"), F.when(hit, new[2]).otherwise(known).alias("known")]


def _stored_steps(state: _Values | _Cells, batch, mode, period) -> list[_Step]:
    """The rules in order, each solved by an aggregate over the stored table and then folded into it."""
    steps = []
    for position, rule in enumerate(batch):
        step = _solve_stored(rule, position, state, mode, period)
        steps.append(step)
        if any(_spreads(r) for r in batch[position + 1:]):
            table, shift = state.table, F.lit(step.shift)
            if step.shares is not None:
                table, shift = _joined(table, F.col("period"), step.shares), F.coalesce("share", F.lit(0.0))
            table = table.select(state.change(step, position, shift))
            # Stored after every rule that spreads: the next one's totals must not work out all rules before it again.
            state.table = settle(table) if _spreads(rule) else table
    return steps


def _solve_stored(rule: Rule, position: int, state: _Values | _Cells, mode: str, period: str | None) -> _Step:
    """What ``_solve`` does, with totals from the stored table; shares of periods stay a table."""
    if not _spreads(rule):
        return _Step(rule, factor=rule.factor if rule.type == "multiplier" else 1.0)
    matched = state.table.filter(_hit(position))
    if not _per_period(rule, mode, period):
        found, counts = matched.agg(*state.measures()).first(), None
        rows = found["n"] or 0
    else:
        counts = settle(matched.groupBy(F.col("period").alias("_p")).agg(*state.measures()))
        found = counts.agg(F.count(F.lit(1)).alias("n"), precise_sum(F.col("t")).alias("t"), F.coalesce(F.bool_and("known"), F.lit(True)).alias("known")).first()
        rows = found["n"]
    if _needs_abs(rule) and not found["known"]:
        raise _NeedsNewPass
    total = found["t"]
    if not rows:
        return _Step(rule)
    if counts is not None:
        amount = total * (rule.factor - 1.0) if rule.type == "multiplier" else rule.offset
        share = amount / _period_count(rule, mode, rows)
        return _Step(rule, by_period={}, shares=counts.select("_p", (F.lit(share) / F.col("n")).alias("share")))
    if rule.type == "multiplier":
        return _Step(rule, shift=total * (rule.factor - 1.0) / rows)
    if rule.distribution == "equal" or total == 0:
        return _Step(rule, shift=rule.offset / rows)
    return _Step(rule, share=rule.offset / total)


def _joined(df: DataFrame, key: Column, shares: DataFrame) -> DataFrame:
    return df.join(shares, key.eqNullSafe(F.col("_p")), "left").drop("_p")


def _solve(rule: Rule, matched: list[_Cell], mode: str, period: str | None) -> _Step:
    """Literal form of one rule, and its effect on the cells."""
    rows, total = sum(c.rows for c in matched), 0.0
    if _spreads(rule) and _needs_abs(rule):
        if not all(c.known for c in matched):
            raise _NeedsNewPass
        total = math.fsum(c.total_abs for c in matched)
    step = _Step(rule)
    if not _spreads(rule):
        step = _Step(rule, factor=rule.factor if rule.type == "multiplier" else 1.0)
    elif rows and _per_period(rule, mode, period):
        amount = total * (rule.factor - 1.0) if rule.type == "multiplier" else rule.offset
        step = _Step(rule, by_period=_period_shares(rule, matched, mode, amount))
    elif rows and rule.type == "multiplier":
        step = _Step(rule, shift=total * (rule.factor - 1.0) / rows)
    elif rows and (rule.distribution == "equal" or total == 0):
        step = _Step(rule, shift=rule.offset / rows)
    elif rows:
        step = _Step(rule, share=rule.offset / total)

    for cell in matched:
        if mode == "screen":
            cell.known = False  # rounding per row is not a common factor
        elif step.by_period is not None:
            cell.shift(step.by_period[cell.period])
        elif step.shift:
            cell.shift(step.shift)
        else:
            cell.scale(step.factor + (cell.sign or 0) * step.share)
    return step


def _period_shares(rule: Rule, matched: list[_Cell], mode: str, amount: float) -> dict[str | None, float]:
    rows = defaultdict(int)
    for cell in matched:
        rows[cell.period] += cell.rows
    return {p: amount / _period_count(rule, mode, len(rows)) / n for p, n in rows.items()}


def _period_count(rule: Rule, mode: str, found: int) -> int:
    """Number of periods an even spread is divided by."""
    if mode == "screen" and rule.period_from and rule.period_to:
        return len(month_range(rule.period_from, rule.period_to)) or found
    return max(found, 1)


def _apply_all(df, steps, masks, value, mode, key) -> DataFrame:
    """All steps in order. Steps that read the value once are nested into one expression."""
    df, shares = _with_period_shares(df, steps, key)
    plain = column(value)
    pending = plain
    for i, (step, mask) in enumerate(zip(steps, masks)):
        if pending is not plain and (mode == "screen" or step.share):
            df, pending = df.withColumn(value, pending), plain
        shift = F.coalesce(F.col(shares[i]), F.lit(0.0)) if i in shares else F.lit(step.shift)
        pending = _changed(step, mask, shift, pending, mode)
    df = df if pending is plain else df.withColumn(value, pending)
    return df.drop("_p", *shares.values())


def _with_period_shares(df, steps, key) -> tuple[DataFrame, dict[int, str]]:
    """The rows with the even shares of all steps for their period, by one join; names of the share columns."""
    spread = {i: step.by_period for i, step in enumerate(steps) if step.by_period is not None}
    if not spread:
        return df, {}
    tables = {i: step.shares for i, step in enumerate(steps) if step.shares is not None}
    if tables:
        each = [t.select("_p", F.lit(i).alias("i"), "share") for i, t in tables.items()]
        every = reduce(DataFrame.unionByName, each).groupBy("_p").agg(
            *[F.max(F.when(F.col("i") == i, F.col("share"))).alias(f"_s{i}") for i in tables])
        return df.join(settle(every), key.eqNullSafe(F.col("_p")), "left"), {i: f"_s{i}" for i in tables}
    names = {i: f"_s{i}" for i in spread}
    periods = dict.fromkeys(p for shares in spread.values() for p in shares)
    rows = [(p, *[shares.get(p, 0.0) for shares in spread.values()]) for p in periods]
    shape = ", ".join(["_p string", *[f"{n} double" for n in names.values()]])
    table = df.sparkSession.createDataFrame(rows, shape)
    # at most MAX_CELLS short rows, so the broadcast is bounded
    return df.join(F.broadcast(table), key.eqNullSafe(F.col("_p")), "left"), names


def _changed(step: _Step, mask: Column, shift: Column, v: Column, mode: str) -> Column:
    shifts = step.by_period is not None or step.shift != 0.0
    if mode == "screen":
        filled = F.coalesce(v, F.lit(0.0))
        if shifts:
            new = filled + shift
        elif step.share:
            new = filled + F.abs(filled) * step.share
        else:
            new = filled * step.factor
        return F.when(mask, half_up_cents(new)).otherwise(v)
    if shifts:
        return v + F.when(mask, shift).otherwise(F.lit(0.0))
    if step.share:
        return v + F.abs(v) * F.when(mask, F.lit(step.share)).otherwise(F.lit(0.0))
    return v if step.factor == 1.0 else v * F.when(mask, F.lit(step.factor)).otherwise(F.lit(1.0))


def preview_rules(
    df: DataFrame,
    rules: Sequence[Rule | Mapping],
    value: str = "amount",
    legacy: bool = False,
    period_mode: str = "prefix",
) -> DataFrame:
    """Matched rows and estimated delta of each rule on the unchanged data, from one aggregate for all rules.

    Columns: ``rule_no, name, type, affected_rows, total_rows, estimated_delta, warning``. ``legacy=True``
    ignores period ranges and uses the first numeric column.
    """
    specs = [Rule.of(r) for r in rules]
    if legacy:
        value = next(f.name for f in df.schema.fields if f.name != "_row_id" and f.dataType.typeName() in (
            "float", "double", "integer", "long"))
        specs = [Rule(r.name, r.type, r.factor, r.offset, r.distribution, r.filters) for r in specs]
    require_numeric(df, value)
    v = column(value).cast("double")
    measures = [F.count(F.lit(1)).alias("n")]
    for i, rule in enumerate(specs):
        mask = rule_mask(df, rule, period_mode)
        measures += [F.count_if(mask).alias(f"n{i}"), precise_sum(F.when(mask, v)).alias(f"s{i}")]
    totals = df.agg(*measures)
    lines = []
    for i, rule in enumerate(specs):
        hit, every = F.col(f"n{i}"), F.col("n")
        delta = F.col(f"s{i}") * (rule.factor - 1.0) if rule.type == "multiplier" else F.lit(rule.offset)
        whole_table = "filter matched all rows" if rule.filters else "no filter: rule applies to all rows"
        warning = F.when((every > 0) & (hit == every), F.lit(whole_table)).when(hit == 0, F.lit("no rows matched"))
        lines.append(F.struct(
            F.lit(i + 1).alias("rule_no"), F.lit(rule.name).alias("name"), F.lit(rule.type).alias("type"),
            hit.alias("affected_rows"), every.alias("total_rows"), to_cents(delta).alias("estimated_delta"),
            warning.alias("warning"),
        ))
    return totals.select(F.inline(F.array(*lines)))
