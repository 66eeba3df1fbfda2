"""Column names that are safe in any table store."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence

from pyspark.sql import DataFrame

MAX_NAME = 63  # fixed value: longest column name

# German letters that are spelled out rather than stripped of their marks.
SPELLED_OUT = {"ä": "ae", "ö": "oe", "ü": "ue", "Ä": "Ae", "Ö": "Oe", "Ü": "Ue", "ß": "ss"}


def sanitize_name(name: str) -> str:
    """Lower case, ``[a-z0-9_]`` only, no leading digit, at most 63 characters, never empty."""
    spelled = "".join(SPELLED_OUT.get(ch, ch) for ch in name)
    plain = "".join(ch for ch in unicodedata.normalize("NFKD", spelled) if not unicodedata.combining(ch))
    words = re.findall(r"[a-z0-9]+", plain.lower())
    safe = "_".join(words) or "col"
    return (f"col_{safe}" if safe[0].isdigit() else safe)[:MAX_NAME]


def unique_names(names: Sequence[str]) -> list[str]:
    """Repeated names get ``_2``, ``_3`` and so on, skipping names already given out."""
    given: list[str] = []
    for name in names:
        candidate, number = name, 1
        while candidate in given:
            number += 1
            candidate = f"{name}_{number}"
        given.append(candidate)
    return given


def sanitize_columns(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The table under safe unique names, and the original name of each."""
    safe = unique_names([sanitize_name(c) for c in df.columns])
    return df.toDF(*safe), dict(zip(safe, df.columns))
