"""Plain specification objects: what to compute, no data. Each can be built from its JSON dictionary."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ..functions.periods import month_range

MAX_ROWS = 10_000  # fixed value: largest row limit a query may ask for
DEFAULT_ROWS = 1_000  # fixed value: row limit of a query that names none


@dataclass(frozen=True)
class Relationship:
    """``source.source_column`` refers to ``target.target_column``; joins may use it in either direction."""

    source: str
    source_column: str
    target: str
    target_column: str


@dataclass
class TableModel:
    """Named tables with their join relationships.

    ``unique`` lists ``(table, column)`` pairs known to be unique; such a dimension needs no de-duplication.
    """

    tables: dict[str, DataFrame]
    relationships: list[Relationship] = field(default_factory=list)
    unique: frozenset[tuple[str, str]] = frozenset()


@dataclass(frozen=True)
class Rule:
    """One what-if rule: scale matching rows by ``factor`` or spread ``offset`` over them."""

    name: str = ""
    type: str = "multiplier"
    factor: float = 1.0
    offset: float = 0.0
    distribution: str = "use_base"
    filters: Mapping[str, Sequence] = field(default_factory=dict)
    period_from: str | None = None
    period_to: str | None = None

    @classmethod
    def of(cls, spec: Rule | Mapping) -> Rule:
        if isinstance(spec, Rule):
            return spec
        return cls(
            name=spec.get("name", ""),
            type=spec.get("type", "multiplier"),
            factor=float(spec.get("factor", 1.0)),
            offset=float(spec.get("offset", 0.0)),
            distribution=spec.get("distribution") or "use_base",
            filters=dict(spec.get("filters") or {}),
            period_from=spec.get("periodFrom") or spec.get("period_from") or None,
            period_to=spec.get("periodTo") or spec.get("period_to") or None,
        )

    def target_months(self, single_end: bool = True) -> list[str]:
        """Months the rule names. ``single_end=False`` ignores a rule that has only an end (screen rules)."""
        if self.period_from and self.period_to:
            return month_range(self.period_from, self.period_to)
        if self.period_from:
            return [self.period_from[:7]]
        if self.period_to and single_end:
            return [self.period_to[:7]]
        return []


@dataclass(frozen=True)
class BaseConfig:
    """Which rows a scenario starts from.

    ``date_column`` optionally names a native date column that carries the same dates as the period text;
    the year or range is then also applied to it, which lets the scan skip files and row groups.
    """

    source: str = "actuals"
    source_scenario_id: str | None = None
    base_year: str | None = None
    period_from: str | None = None
    period_to: str | None = None
    date_column: str | None = None

    @classmethod
    def of(cls, spec: BaseConfig | Mapping | None) -> BaseConfig:
        if isinstance(spec, BaseConfig):
            return spec
        known = {k: v for k, v in (spec or {}).items() if k in cls.__dataclass_fields__ and v is not None}
        if "base_year" in known:
            known["base_year"] = str(known["base_year"])
        return cls(**known)

    def bounds(self) -> tuple[str | None, str | None]:
        if self.base_year:
            return f"{self.base_year}-01", f"{self.base_year}-12"
        return self.period_from, self.period_to


@dataclass(frozen=True)
class Scenario:
    id: str
    name: str = ""
    rules: Sequence[Rule] = ()
    base: BaseConfig = BaseConfig()

    @classmethod
    def of(cls, spec: Scenario | Mapping) -> Scenario:
        if isinstance(spec, Scenario):
            return spec
        return cls(
            id=str(spec["id"]),
            name=spec.get("name", str(spec["id"])),
            rules=tuple(Rule.of(r) for r in spec.get("rules", ())),
            base=BaseConfig.of(spec.get("base_config")),
        )


@dataclass(frozen=True)
class ProjectionSpec:
    """How future rows are made from past ones: copy_year, average, last_n_months or none."""

    method: str = "none"
    source_year: str = ""
    target_year: str = ""
    growth_pct: float = 0.0
    target_periods: Sequence[str] = ()
    last_n: int = 3

    @classmethod
    def of(cls, spec: ProjectionSpec | Mapping | None) -> ProjectionSpec:
        if isinstance(spec, ProjectionSpec):
            return spec
        known = {k: v for k, v in (spec or {}).items() if k in cls.__dataclass_fields__ and v is not None}
        for year in ("source_year", "target_year"):
            if year in known:
                known[year] = str(known[year])
        return cls(**known)

    @property
    def growth(self) -> float:
        return 1.0 + float(self.growth_pct) / 100.0


@dataclass(frozen=True)
class QuerySpec:
    """Filter, group, aggregate, order, limit. ``limit=0``, the default, returns everything.

    ``QuerySpec.of`` can give requests without a limit one of their own (``DEFAULT_ROWS``) and refuse more than
    ``MAX_ROWS``: a limit of the request, not of the engine.
    """

    columns: Sequence[str] | None = None
    filters: Mapping[str, object] = field(default_factory=dict)
    group_by: Sequence[str] = ()
    aggregations: Mapping[str, str] = field(default_factory=dict)
    order_by: Sequence[tuple[str, str]] = ()
    limit: int = 0

    def __post_init__(self):
        if self.limit < 0:
            raise ValueError(f"limit must not be negative, got {self.limit}")

    @classmethod
    def of(cls, spec: QuerySpec | Mapping, default_limit: int = 0, max_limit: int | None = None) -> QuerySpec:
        if isinstance(spec, QuerySpec):
            return spec
        known = {k: v for k, v in spec.items() if k in cls.__dataclass_fields__ and v is not None}
        known["order_by"] = tuple(
            (o["column"], o.get("direction", "asc")) if isinstance(o, Mapping) else tuple(o)
            for o in known.get("order_by", ())
        )
        known.setdefault("limit", default_limit)
        if max_limit is not None and known["limit"] > max_limit:
            raise ValueError(f"limit must be at most {max_limit}, got {known['limit']}")
        return cls(**known)
