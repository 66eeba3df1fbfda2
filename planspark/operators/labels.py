"""Semantic layer: value labels, grouping columns, dimension values and glossary.

Labels are a table ``(column_name, raw_value, display_label, category)``, optionally with ``dataset``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.values import column, distinct_with_null, dtype_of, resolve, stacked_values, text
from ..plans.specs import Relationship
from ..sources.shared import settle
from ..sources.versions import VersionConflict, VersionedTable
from .profile import ColumnProfile

TOP_VALUES = 100  # fixed value: values listed per dimension
PREVIEW_VALUES = 10  # fixed value: values shown for a grouping column
GLOSSARY_VALUES = 5  # fixed value: values shown for a category
GLOSSARY_TERMS = 30  # fixed value: entries considered for the glossary

# Words of a describing column, best first.
DESCRIBING_WORDS = ("name", "bezeichnung", "description", "label", "text", "desc", "title")

LABEL_COLUMNS = ("column_name", "raw_value", "display_label", "category")


def fact_and_dimension(
    rel: Relationship, profiles: Mapping[str, Sequence[ColumnProfile]]
) -> tuple[str, str, str, str] | None:
    """``(fact, fact column, dimension, key)``: the fact is the only side with measures; else ``None``."""
    source, target = ([p.role == "measure" for p in profiles[t]] for t in (rel.source, rel.target))
    if any(source) == any(target):
        return None
    if any(source):
        return rel.source, rel.source_column, rel.target, rel.target_column
    return rel.target, rel.target_column, rel.source, rel.source_column


def text_attributes(profile: Sequence[ColumnProfile], key: str) -> list[str]:
    return [p.column_name for p in profile if p.role == "attribute" and p.data_type == "text" and p.column_name != key]


def describing_column(profile: Sequence[ColumnProfile], key: str) -> str | None:
    """Text attribute whose name best matches the describing words; the first of equals."""
    def rank(name: str) -> int:
        return next((i for i, word in enumerate(DESCRIBING_WORDS) if word in name.lower()), len(DESCRIBING_WORDS))

    return min(text_attributes(profile, key), key=rank, default=None)


def auto_labels(
    dim: DataFrame, key: str, described_by: str, fact_column: str, existing: DataFrame | None = None
) -> DataFrame:
    """New labels from a dimension: key text to description, one per key, for keys not labelled yet."""
    key, described_by = resolve(dim, key), resolve(dim, described_by)
    pairs = dim.select(
        text(column(key), dtype_of(dim, key)).alias("raw_value"),
        text(column(described_by), dtype_of(dim, described_by)).alias("display_label"),
    ).filter("raw_value IS NOT NULL AND display_label IS NOT NULL")
    found = pairs.groupBy("raw_value").agg(F.min("display_label").alias("display_label")).select(
        F.lit(fact_column).alias("column_name"), "raw_value", "display_label", F.lit(None).cast("string").alias("category")
    )
    if existing is None:
        return found
    return found.join(existing.select("column_name", "raw_value"), ["column_name", "raw_value"], "left_anti")


def auto_labels_for(
    tables: Mapping[str, DataFrame],
    profiles: Mapping[str, Sequence[ColumnProfile]],
    rel: Relationship,
    existing: DataFrame | None = None,
) -> DataFrame | None:
    """Labels for a relationship, or ``None`` when no side is clearly the dimension or nothing describes it."""
    sides = fact_and_dimension(rel, profiles)
    described_by = describing_column(profiles[sides[2]], sides[3]) if sides else None
    if described_by is None:
        return None
    return auto_labels(tables[sides[2]], sides[3], described_by, sides[1], existing)


def grouping_values(dim: DataFrame, key: str, attributes: Sequence[str] | None = None, n: int = PREVIEW_VALUES) -> DataFrame:
    """``column_name, value_preview`` per text attribute of a dimension: its first ``n`` sorted values."""
    if attributes is None:
        attributes = [f.name for f in dim.schema.fields if f.dataType.typeName() == "string" and f.name != key]
    values = stacked_values(dim, attributes).filter("value IS NOT NULL").distinct()
    ranked = values.withColumn("_rank", F.row_number().over(Window.partitionBy("column_name").orderBy("value")))
    # one row more than shown tells whether the list goes on; Spark keeps only these rows before the shuffle
    return _listed(ranked.filter(F.col("_rank") <= n + 1), ["column_name"], n, F.col("value"), "value_preview")


def _listed(ranked: DataFrame, keys: Sequence[str], n: int, item: Column, out: str) -> DataFrame:
    shown = F.sort_array(F.collect_list(F.when(F.col("_rank") <= n, F.struct("_rank", item.alias("_item")))))
    more = F.when(F.max("_rank") > n, F.lit("...")).otherwise(F.lit(""))
    joined = F.array_join(F.transform(shown, lambda s: s["_item"]), ", ")
    return ranked.groupBy(*keys).agg(F.concat(joined, more).alias(out))


def upsert_labels(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Labels after a bulk update, one row per (column, raw value).

    Incoming rows replace the display label (the raw value when none is given) and, if given, the category; a
    blank raw value is skipped. Of several incoming rows for a value the one with the highest ``seq`` counts
    (column optional). Grouped aggregates do it in one shuffle.
    """
    seq = column("seq") if "seq" in incoming.columns else F.lit(0)
    columns = [c for c in ("dataset", *LABEL_COLUMNS) if c in existing.columns]
    keys = [c for c in columns if c not in ("display_label", "category")]
    old = existing.select(*columns, F.lit(-1).cast("bigint").alias("_seq"))
    fresh = incoming.filter(F.coalesce(F.col("raw_value"), F.lit("")) != "")
    given = {**{c: column(c) for c in columns if c in fresh.columns},
             "display_label": F.coalesce(column("display_label"), column("raw_value"))}
    new = fresh.select(*[given.get(c, F.lit(None).cast("string")).alias(c) for c in columns], seq.cast("bigint").alias("_seq"))
    latest = F.max_by("display_label", F.struct("_seq", "display_label")).alias("display_label")
    category = F.max(F.when(F.col("category").isNotNull(), F.struct("_seq", "category")))["category"].alias("category")
    merged = old.unionByName(new).groupBy(*keys).agg(latest, category)
    return merged.select(*columns)


def _labels_of(labels: DataFrame, name: str, dataset: str | None, values: DataFrame) -> DataFrame:
    """One label per listed value."""
    mine = labels.filter(F.col("column_name") == name)
    if dataset is not None and "dataset" in labels.columns:
        mine = mine.filter(F.col("dataset") == dataset)
    listed = values.select(F.col("value").alias("raw_value"))
    mine = mine.join(F.broadcast(listed), "raw_value", "left_semi")
    return mine.groupBy("raw_value").agg(F.max(F.struct("display_label", "category")).alias("_l"))


def dimension_values(
    df: DataFrame,
    name: str,
    labels: DataFrame | None = None,
    search: str | None = None,
    top: int = TOP_VALUES,
    dataset: str | None = None,
) -> DataFrame:
    """First distinct values in order: ``value`` and, when labels are given, ``label`` and ``category``.

    ``search`` keeps values that contain the text, ignoring case; the text is taken literally.
    """
    name = resolve(df, name)
    c, dtype = column(name), dtype_of(df, name)
    values = df.select(c.alias("_v"), text(c, dtype).alias("value")).filter("_v IS NOT NULL")
    if search:
        values = values.filter(F.lower("value").contains(search.lower()))
    first = values.distinct().orderBy("_v").limit(top)
    if labels is None:
        return first.orderBy("_v").select("value")
    # at most `top` values on either side: the labels are first cut down to those values
    mine = _labels_of(labels, name, dataset, first)
    joined = first.join(F.broadcast(mine), F.col("value") == F.col("raw_value"), "left")
    category = F.when(F.col("_l.category") != "", F.col("_l.category"))
    return joined.orderBy("_v").select("value", F.col("_l.display_label").alias("label"), category.alias("category"))


def dimension_size(df: DataFrame, name: str) -> DataFrame:
    """``total_unique``: distinct values, NULL counted as one."""
    return df.agg(distinct_with_null(column(resolve(df, name))).alias("total_unique"))


def glossary(
    labels: DataFrame,
    synonyms: DataFrame | None = None,
    definitions: DataFrame | None = None,
    groupings: DataFrame | None = None,
    top: int = GLOSSARY_TERMS,
) -> DataFrame:
    """``pos, phrase, maps_to`` from definitions, grouping terms, label categories and synonyms, in that order.

    ``definitions`` and ``groupings`` are ``(seq, column_name, value, term)``, ``synonyms`` are ``(seq, column_name,
    synonym)``. The first ``top`` entries count; of equal phrases the first one stays.
    """
    def terms(df: DataFrame, part: int) -> DataFrame:
        maps_to = F.concat(F.col("column_name"), F.lit(' = "'), F.col("value"), F.lit('"'))
        return df.filter("term != '' AND value != ''").select(
            F.lit(part).alias("_part"), F.col("seq").cast("string").alias("_key"), F.lower("term").alias("phrase"), maps_to.alias("maps_to")
        )

    named = labels.filter(F.coalesce(F.col("category"), F.lit("")) != "")
    in_order = Window.partitionBy("column_name", "category").orderBy("raw_value")
    ranked = named.withColumn("_rank", F.row_number().over(in_order)).filter(F.col("_rank") <= GLOSSARY_VALUES + 1)
    quoted = F.concat(F.lit("'"), F.col("raw_value"), F.lit("'"))
    listed = _listed(ranked, ["column_name", "category"], GLOSSARY_VALUES, quoted, "_values")
    parts = [listed.select(
        F.lit(3).alias("_part"), F.concat_ws("\t", "column_name", F.lit("0"), "category").alias("_key"),
        F.lower("category").alias("phrase"),
        F.concat(F.col("column_name"), F.lit(" IN ["), F.col("_values"), F.lit("]")).alias("maps_to"),
    )]
    if synonyms is not None:
        parts.append(synonyms.select(
            F.lit(3).alias("_part"),
            F.concat_ws("\t", "column_name", F.lit("1"), F.format_string("%012d", F.col("seq").cast("bigint"))).alias("_key"),
            F.lower("synonym").alias("phrase"), F.concat(F.lit("column: "), F.col("column_name")).alias("maps_to"),
        ))
    for part, table in ((1, definitions), (2, groupings)):
        if table is not None:
            parts.append(terms(table.withColumn("seq", F.format_string("%012d", F.col("seq").cast("bigint"))), part))
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part)
    first = stacked.orderBy("_part", "_key", "phrase").limit(top)
    numbered = first.withColumn("pos", F.row_number().over(Window.orderBy("_part", "_key", "phrase")))  # at most `top` rows
    kept = numbered.groupBy("phrase").agg(F.min(F.struct("pos", "maps_to")).alias("_first"))
    return kept.select(F.col("_first.pos").cast("bigint").alias("pos"), "phrase", F.col("_first.maps_to").alias("maps_to")).orderBy("pos")


class LabelStore:
    """Labels kept in buckets by (dataset, column) and, within them, by value: an upsert rewrites the buckets of its own values only.

    Every upsert is one new version of the table, so readers see all of it or nothing; where another writer was first the upsert is
    worked out again on that writer's labels.
    """

    SHAPE = "dataset string, column_name string, raw_value string, display_label string, category string"

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, parts: int = 16):
        """A store is opened with the numbers of buckets, and of parts by value in each, that it was made with."""
        self.spark, self.buckets, self.parts = spark, buckets, parts
        self.table = VersionedTable(spark, path)
        if not self.table.numbers():
            empty = spark.createDataFrame([], self.SHAPE).withColumn("bucket", F.lit(0))
            self.table = VersionedTable.create(empty, path, "bucket")

    def _bucket(self) -> Column:
        name = F.pmod(F.xxhash64(F.coalesce("dataset", F.lit("")), "column_name"), F.lit(self.buckets))
        return (name * self.parts + F.pmod(F.xxhash64("raw_value"), F.lit(self.parts))).cast("int")

    def labels(self) -> DataFrame:
        return self.table.read().drop("bucket")

    def upsert(self, incoming: DataFrame, dataset: str | None = None) -> int:
        """Merge incoming labels as :func:`upsert_labels` does; returns the number of buckets written."""
        rows = incoming if "dataset" in incoming.columns else incoming.withColumn("dataset", F.lit(dataset).cast("string"))
        given = settle(rows.filter(F.coalesce(F.col("raw_value"), F.lit("")) != "").withColumn("bucket", self._bucket()))
        touched = sorted(r["bucket"] for r in given.select("bucket").distinct().collect())  # at most buckets x parts numbers
        while touched:
            version = self.table.version()
            stored = version.columns["bucket"]
            names = {f"{stored}={b}": b for b in touched}
            old = self.table.read(version.number, [n for n in names if n in version.folders])
            merged = upsert_labels(old.drop("bucket"), given.drop("bucket"))
            try:
                self.table.replace(version, list(names), merged.withColumn("bucket", self._bucket()))
                break
            except VersionConflict:
                continue
        return len(touched)
