"""Order of the joins that widen a fact table with its dimensions. Works on names only, never on rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from .specs import Relationship


@dataclass(frozen=True)
class JoinStep:
    """Join ``table`` on ``left`` (a column of the wide table) = ``key``; ``names`` maps its columns to output names."""

    table: str
    left: str
    key: str
    names: Mapping[str, str]


def plan_joins(
    fact: str,
    columns: Mapping[str, Sequence[str]],
    relationships: Sequence[Relationship],
) -> list[JoinStep]:
    """Left joins that reach every table connected to ``fact``.

    Relationships are tried in order, in either direction, pass after pass until no more table is reached. A table is
    joined once; a relationship between two joined tables is skipped. The wide table remembers which output column
    carries each ``(table, column)``, so a chained join cannot pick a same-named column of another table. A
    column whose name is taken becomes ``<table>__<column>``.
    """
    carried = {(fact, c): c for c in columns[fact]}
    taken, joined = set(columns[fact]), {fact}
    open_ones, steps = list(relationships), []
    while True:
        waiting = []
        for rel in open_ones:
            here, there = (rel.source, rel.source_column), (rel.target, rel.target_column)
            if (here[0] in joined) == (there[0] in joined):
                if here[0] not in joined:
                    waiting.append(rel)
                continue
            if there[0] in joined:
                here, there = there, here
            table, key = there
            if here not in carried or table not in columns or key not in columns[table]:
                continue
            names = {c: f"{table}__{c}" if c in taken else c for c in columns[table] if c not in (key, "_row_id")}
            steps.append(JoinStep(table, carried[here], key, names))
            carried[there] = carried[here]
            carried.update({(table, c): out for c, out in names.items()})
            taken.update(names.values())
            joined.add(table)
        if len(waiting) == len(open_ones):
            break
        open_ones = waiting
    return steps


def prune_joins(steps: Sequence[JoinStep], wanted: Sequence[str]) -> list[JoinStep]:
    """Keep only the joins that supply a wanted column, directly or as the way to one, and only those columns."""
    needed, kept = set(wanted), []
    for step in reversed(steps):
        names = {c: out for c, out in step.names.items() if out in needed}
        if names:
            kept.append(JoinStep(step.table, step.left, step.key, names))
            needed.add(step.left)
    return kept[::-1]
