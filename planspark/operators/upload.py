"""Several delimited files to one linked model: typed tables, profiles, relationships, labels, calendar, baseline."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..plans.specs import Relationship, TableModel
from ..sources.shared import new_path
from ..sources.tables import profiled, read_typed, write_table
from .baseline import build_baseline
from .calendar import calendar_dim, calendar_for
from .labels import auto_labels_for
from .profile import ColumnProfile, default_fact
from .relationships import CALENDAR, as_relationships, calendar_links, detect_relationships


@dataclass
class UploadedModel:
    """The tables as stored, with what was found out about them. ``fact`` is the first table with measures."""

    model: TableModel
    profiles: dict[str, list[ColumnProfile]]
    labels: DataFrame | None
    fact: str | None
    paths: dict[str, str] = field(default_factory=dict)

    def baseline(self, columns=None) -> DataFrame:
        if self.fact is None:
            raise ValueError("no table has a measure")
        return build_baseline(self.model, self.fact, columns=columns)


def ingest_tables(spark: SparkSession, files: Mapping[str, str], dayfirst: bool = True, decimal_style: str = "us") -> UploadedModel:
    """Tables by name from delimited files, linked where columns of the same name share their values.

    Each file is parsed twice, once to judge its types and once to store it as typed Parquet; profiles, relationships and
    labels read the stored table. Time columns are ISO text and link to a calendar of their own. Labels come from
    the describing column of each dimension.
    """
    tables, profiles, paths = {}, {}, {}
    for name, path in files.items():
        safe, display = read_typed(spark, path, decimal_style=decimal_style)
        paths[name] = new_path(spark, f"table-{name}")
        write_table(safe, paths[name])
        stored = profiled(spark.read.parquet(paths[name]), display, dayfirst)
        tables[name], profiles[name] = stored.df, stored.profile
    links: list[Relationship] = as_relationships(detect_relationships(tables, profiles=profiles)) if len(tables) > 1 else []
    labels = None
    for link in links:
        found = auto_labels_for(tables, profiles, link, labels)
        if found is not None:
            labels = found if labels is None else labels.unionByName(found)
    for name in files:
        links += calendar_links(name, profiles[name], links)
    dated = [r for r in links if r.target == CALENDAR]
    if dated:
        # The days of the default calendar and of all years that the linked date columns span.
        days = calendar_dim(spark)
        for r in dated:
            if r.target_column == "date":
                days = days.unionByName(calendar_for(tables[r.source], r.source_column))
        tables[CALENDAR] = days.distinct()
    return UploadedModel(TableModel(tables, links), profiles, labels, default_fact(profiles), paths)
