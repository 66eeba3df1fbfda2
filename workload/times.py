"""Timestamps with a time of day, profiles of texts, and checks of the model."""

from __future__ import annotations

from pyspark.sql import functions as F

from planspark import (
    apply_rules, build_all_baselines, dimension_values, pivot_long, relationship_coverage, value_column, value_counts, with_period,
)
from planspark.functions import to_cents
from planspark.operators.baseline import verify_unique
from planspark.operators.profile import column_facts, profile_columns
from planspark.operators.query import pivot_fields

from .registry import PRIMARY_KEYS, cents, exact, query, rounded, sales_model, table

# A timestamp as the engine shows it: the day alone at midnight.
TS = "CASE WHEN ts = date_trunc('day', ts) THEN strftime(ts, '%Y-%m-%d') ELSE CAST(ts AS VARCHAR) END"


@query("profile_timestamps", f"""
    SELECT 'ts' AS column_name, count(DISTINCT ts) + max(CASE WHEN ts IS NULL THEN 1 ELSE 0 END) AS unique_count,
           count(*) - count(ts) AS null_count,
           (SELECT string_agg(t, '|' ORDER BY t) FROM (SELECT DISTINCT {TS} AS t FROM events WHERE ts IS NOT NULL ORDER BY t LIMIT 20)) AS samples
    FROM events""")
def profile_timestamps(spark, sf):
    facts = column_facts(table(spark, sf, "events").select("ts"))
    return facts.select("column_name", "unique_count", "null_count", F.array_join("samples", "|").alias("samples"))


@query("coverage_timestamps", """
    WITH a AS (SELECT DISTINCT ts FROM events WHERE event_type IN ('click', 'view')), b AS (SELECT DISTINCT ts FROM events WHERE event_type NOT IN ('click', 'view'))
    SELECT CAST(coalesce(floor(count(b.ts) * 100.0 / nullif(count(*), 0)), 0) AS BIGINT) AS coverage, count(b.ts) AS overlap
    FROM a LEFT JOIN b ON a.ts = b.ts WHERE a.ts IS NOT NULL""")
def coverage_timestamps(spark, sf):
    events = table(spark, sf, "events")
    some = F.col("event_type").isin("click", "view")
    return relationship_coverage(events.filter(some), "ts", events.filter(~some), "ts")


@query("value_counts_timestamps", f"""
    SELECT {TS} AS value, count(*) AS count FROM events WHERE ts IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 30""")
def value_counts_timestamps(spark, sf):
    return value_counts(table(spark, sf, "events"), "ts")


@query("dimension_values_timestamps", f"""
    SELECT {TS} AS value FROM (SELECT DISTINCT ts FROM events WHERE ts IS NOT NULL ORDER BY ts LIMIT 100)""")
def dimension_values_timestamps(spark, sf):
    return dimension_values(table(spark, sf, "events"), "ts")


@query("pivot_timestamps", f"""
    SELECT coalesce({TS}, '—') AS ts, event_type, {rounded(exact('value'))} AS value FROM events GROUP BY 1, 2""")
def pivot_timestamps(spark, sf):
    return cents(pivot_long(table(spark, sf, "events"), ["ts"], "event_type", "value"), "value")


def _as_texts(spark, sf):
    return table(spark, sf, "orders").select(*[F.col(c).cast("string").alias(c) for c in (
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")], F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"))


TEXT_TYPES = {"o_orderkey": "integer", "o_custkey": "integer", "o_orderstatus": "text", "o_totalprice": "numeric", "o_orderpriority": "text",
              "o_orderdate": "date"}


@query("profile_text_types", " UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, '{kind}' AS data_type, count(DISTINCT v) AS unique_count,
        (SELECT string_agg(t, '|' ORDER BY t) FROM (SELECT DISTINCT {x} AS t FROM orders ORDER BY t LIMIT 20)) AS samples
        FROM (SELECT {x} AS v FROM orders)"""
    for c, kind in TEXT_TYPES.items() if c != "o_totalprice"
    for x in ["strftime(o_orderdate, '%Y-%m-%d')" if c == "o_orderdate" else f"CAST({c} AS VARCHAR)"]))
def profile_text_types(spark, sf):
    profile, _ = profile_columns(_as_texts(spark, sf).drop("o_totalprice"))
    return spark.createDataFrame(
        [(p.column_name, p.data_type, p.unique_count, "|".join(p.sample_values)) for p in profile],
        "column_name string, data_type string, unique_count long, samples string")


@query("value_column_total", f"SELECT 'o_totalprice' AS name, {rounded(exact('o_totalprice'))} AS total FROM orders")
def value_column_total(spark, sf):
    orders = table(spark, sf, "orders")
    name = value_column(orders, "revenue", ["o_totalprice"])
    return orders.agg(to_cents(F.sum(F.col(name).cast("decimal(28,10)")).cast("double")).alias("total")).select(F.lit(name).alias("name"), "total")


@query("pivot_field_values", """
    SELECT 'event_type' AS field, 'dimension' AS kind, count(DISTINCT event_type) AS n FROM events
    UNION ALL SELECT 'props', 'dimension', count(DISTINCT props) FROM events
    UNION ALL SELECT 'ts', 'dimension', count(DISTINCT ts) FROM events
    UNION ALL SELECT 'value', 'measure', count(DISTINCT value) FROM events""")
def pivot_field_values(spark, sf):
    events = table(spark, sf, "events")
    dims, measures = pivot_fields(events)
    counted = column_facts(events.select(*dims, *measures))
    kind = F.when(F.col("column_name").isin(*measures), "measure").otherwise("dimension")
    return counted.select(F.col("column_name").alias("field"), kind.alias("kind"), "unique_count").withColumnRenamed("unique_count", "n")


@query("all_baselines", " UNION ALL ".join(
    f"SELECT '{t}' AS baseline, count(*) AS n FROM {t}" for t in ("lineitem", "orders", "customer", "nation", "region", "part", "supplier")))
def all_baselines(spark, sf):
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("baseline"), "n")
             for name, df in build_all_baselines(sales_model(spark, sf)).items()]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found


@query("verify_unique", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{c}' AS column_name, count({c}) - count(DISTINCT {c}) AS repeated FROM {t}" for t, c in sorted(PRIMARY_KEYS)))
def verify_unique_(spark, sf):
    return verify_unique(sales_model(spark, sf))


HALF_UP = "floor(({}) * 100 + 0.5) / 100"


@query("ui_rule_offset", f"""
    WITH e AS (SELECT event_type, value, strftime(ts, '%Y-%m') AS period FROM events),
    t AS (SELECT sum(abs(value)) AS t FROM e WHERE event_type = 'click'),
    z AS (SELECT event_type, CASE WHEN event_type = 'click' THEN {HALF_UP.format('coalesce(value, 0) + abs(coalesce(value, 0)) * 5000.0 / (SELECT t FROM t)')} ELSE value END AS v FROM e)
    SELECT event_type, count(*) AS n, {rounded(exact('v'))} AS value FROM z GROUP BY 1""")
def ui_rule_offset(spark, sf):
    events = with_period(table(spark, sf, "events"), "ts")
    got = apply_rules(events, [{"type": "offset", "offset": 5000, "filters": {"event_type": ["click"]}}], "value", mode="screen")
    return cents(got.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(28,10)")).cast("double").alias("value")), "value")


@query("ui_rule_offset_zero_base", f"""
    WITH n AS (SELECT count(*) AS n FROM events WHERE event_type = 'click'),
    z AS (SELECT event_type, CASE WHEN event_type = 'click' THEN {HALF_UP.format('5000.0 / (SELECT n FROM n)')} ELSE 0.0 END AS v FROM events)
    SELECT event_type, count(*) AS n, {rounded(exact('v'))} AS value FROM z GROUP BY 1""")
def ui_rule_offset_zero_base(spark, sf):
    events = with_period(table(spark, sf, "events"), "ts").withColumn("value", F.lit(0.0))
    got = apply_rules(events, [{"type": "offset", "offset": 5000, "filters": {"event_type": ["click"]}}], "value", mode="screen")
    return cents(got.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(28,10)")).cast("double").alias("value")), "value")
