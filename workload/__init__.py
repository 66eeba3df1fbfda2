"""Queries over the given tables, one per operator, each with the SQL that must give the same rows."""

from . import compare, ingest, model, pivots, query, reports, rules, scenario, semantic, times, transform  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
