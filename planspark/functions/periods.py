"""Month arithmetic on ``YYYY-MM`` texts (specification data, never table rows)."""

from __future__ import annotations

import re

_MONTH = re.compile(r"^(\d{4})-(\d{2})")

# English month names in calendar order.
MONTH_NAMES = (
    "January", "February", "March", "April", "May", "June",
    "July", "August", "September", "October", "November", "December",
)


def _index(period: str) -> int | None:
    found = _MONTH.match(str(period))
    return int(found[1]) * 12 + int(found[2]) - 1 if found else None


def _label(index: int) -> str:
    return f"{index // 12:04d}-{index % 12 + 1:02d}"


def month_range(start: str, end: str) -> list[str]:
    """Months from ``start`` to ``end`` inclusive; empty when a bound is not a month."""
    first, last = _index(start), _index(end)
    if first is None or last is None:
        return []
    return [_label(i) for i in range(first, last + 1)]


def next_months(period: str, n: int) -> list[str]:
    start = _index(period)
    return [] if start is None else [_label(start + k) for k in range(1, n + 1)]


def month_name(period: str) -> str:
    return MONTH_NAMES[int(period[5:7]) - 1]


def quarter_label(period: str) -> str:
    return f"Q{(int(period[5:7]) + 2) // 3} {period[:4]}"
