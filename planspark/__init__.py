"""Planning and variance analysis on Spark DataFrames."""

from .operators.baseline import build_all_baselines, build_baseline, first_per_key, join_dimension
from .operators.calendar import calendar_dim, calendar_for, filter_values, with_period
from .operators.compare import (
    chart_series, comparison, comparison_pivot, comparison_totals, variance, variance_totals, waterfall, waterfall_screen,
)
from .operators.labels import LabelStore, auto_labels, auto_labels_for, dimension_size, dimension_values, glossary, grouping_values, upsert_labels
from .operators.metrics import aggregate_rule, eval_metric, metric_ratio
from .operators.ordering import with_running
from .operators.pivot import pivot_long, pivot_wide, sort_pivot
from .operators.profile import detect_role, detect_roles, measure_stats, profile_columns
from .operators.profile_store import ProfileStore
from .operators.projection import comparison_base, project, project_future, project_seasonal, project_then_rules
from .operators.query import (
    available_periods, derive_period, filter_period_range, filter_rows, query_grouped, run_query, scan, screen_filter,
    value_column, value_counts,
)
from .operators.relationships import calendar_links, detect_relationships, relationship_coverage
from .operators.reports import ReportSet, Rollups
from .operators.rules import apply_rules, preview_rules, rule_mask
from .operators.scenario import (
    compute_scenario, compute_scenarios, period_delta, scenario_periods, scenario_with_projection, screen_base, screen_scenarios,
    select_base, variance_total,
)
from .operators.upload import UploadedModel, ingest_tables
from .operators.transform import apply_step, apply_steps, mark_applied, materialize_steps, output_role, preview_step, reject
from .plans.specs import BaseConfig, ProjectionSpec, QuerySpec, Relationship, Rule, Scenario, TableModel
from .sources.infer import coerce_types, infer_types, normalize_period
from .sources.naming import sanitize_columns
from .sources.tables import IngestResult, export_rows, ingest_table, read_delimited, write_table, write_typed
from .sources.versions import Update, Version, VersionConflict, VersionedTable
