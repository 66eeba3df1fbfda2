from __future__ import annotations

from pyspark.sql import functions as F

from planspark import (
    LabelStore, Relationship, aggregate_rule, auto_labels_for, dimension_values, eval_metric, glossary, grouping_values, metric_ratio,
    profile_columns, upsert_labels,
)
from planspark.sources.shared import new_path
from .registry import SALES, cents, exact, money, query, rounded, sales, table


@query("auto_labels", """
    SELECT 'l_partkey' AS column_name, CAST(p_partkey AS VARCHAR) AS raw_value, p_name AS display_label, CAST(NULL AS VARCHAR) AS category
    FROM part WHERE p_size <> 1 AND p_name IS NOT NULL""")
def auto_labels_(spark, sf):
    fact = table(spark, sf, "lineitem").select("l_partkey", "l_quantity", F.col("l_extendedprice").alias("amount"))
    dim = table(spark, sf, "part").select("p_partkey", "p_brand", "p_name", "p_size")
    profiles = {"lineitem": profile_columns(fact, approx=True)[0], "part": profile_columns(dim, approx=True)[0]}
    known = dim.filter("p_size = 1").select(
        F.lit("l_partkey").alias("column_name"), F.col("p_partkey").cast("string").alias("raw_value"))
    link = Relationship("lineitem", "l_partkey", "part", "p_partkey")
    return auto_labels_for({"lineitem": fact, "part": dim}, profiles, link, known)


@query("grouping_values", """
    WITH v AS (SELECT DISTINCT 'p_brand' AS column_name, p_brand AS value FROM part
               UNION SELECT DISTINCT 'p_type', p_type FROM part),
         r AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY value) AS i FROM v)
    SELECT column_name, string_agg(CASE WHEN i <= 10 THEN value END, ', ' ORDER BY value)
           || CASE WHEN COUNT(*) > 10 THEN '...' ELSE '' END AS value_preview
    FROM r GROUP BY 1""")
def grouping_values_(spark, sf):
    return grouping_values(table(spark, sf, "part"), "p_partkey", ["p_brand", "p_type"])


LABELS_SQL = """labels_ AS (
    SELECT 'c_nationkey' AS column_name, CAST(n_nationkey AS VARCHAR) AS raw_value, n_name AS display_label, r_name AS category
    FROM nation JOIN region ON n_regionkey = r_regionkey)"""


def _labels(spark, sf):
    nations = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return nations.select(F.lit("c_nationkey").alias("column_name"), F.col("n_nationkey").cast("string").alias("raw_value"),
                          F.col("n_name").alias("display_label"), F.col("r_name").alias("category"))


@query("upsert_labels", """WITH c AS (
        SELECT CAST(o_custkey AS VARCHAR) AS raw_value, arg_max('Order ' || o_orderkey, o_orderkey) AS label,
               arg_max('closed by ' || o_orderpriority, o_orderkey) FILTER (o_orderstatus = 'F') AS cat FROM orders GROUP BY 1)
    SELECT 'c_custkey' AS column_name, COALESCE(raw_value, CAST(c_custkey AS VARCHAR)) AS raw_value,
           COALESCE(label, c_name) AS display_label, COALESCE(cat, c_mktsegment) AS category
    FROM customer FULL JOIN c ON raw_value = CAST(c_custkey AS VARCHAR)""")
def upsert_labels_(spark, sf):
    column = F.lit("c_custkey").alias("column_name")
    known = table(spark, sf, "customer").select(
        column, F.col("c_custkey").cast("string").alias("raw_value"), F.col("c_name").alias("display_label"),
        F.col("c_mktsegment").alias("category"))
    closed = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("closed by "), F.col("o_orderpriority")))
    incoming = table(spark, sf, "orders").select(
        column, F.col("o_custkey").cast("string").alias("raw_value"),
        F.concat(F.lit("Order "), F.col("o_orderkey")).alias("display_label"), closed.alias("category"), F.col("o_orderkey").alias("seq"))
    return upsert_labels(known, incoming.unionByName(incoming.withColumn("raw_value", F.lit(""))))


@query("upsert_label_store", """WITH c AS (
        SELECT CAST(o_custkey AS VARCHAR) AS raw_value, arg_max('Order ' || o_orderkey, o_orderkey) AS label FROM orders GROUP BY 1)
    SELECT 'shop' AS dataset, 'c_custkey' AS column_name, COALESCE(raw_value, CAST(c_custkey AS VARCHAR)) AS raw_value,
           COALESCE(label, c_name) AS display_label, c_mktsegment AS category
    FROM customer FULL JOIN c ON raw_value = CAST(c_custkey AS VARCHAR)
    UNION ALL SELECT 'shop', 'n_nationkey', CAST(n_nationkey AS VARCHAR), n_name, NULL FROM nation""")
def upsert_label_store(spark, sf):
    store = LabelStore(spark, new_path(spark, "labels"), buckets=4, parts=4)
    column = F.lit("c_custkey").alias("column_name")
    store.upsert(table(spark, sf, "nation").select(
        F.lit("n_nationkey").alias("column_name"), F.col("n_nationkey").cast("string").alias("raw_value"), F.col("n_name").alias("display_label"),
        F.lit(None).cast("string").alias("category")), "shop")
    store.upsert(table(spark, sf, "customer").select(
        column, F.col("c_custkey").cast("string").alias("raw_value"), F.col("c_name").alias("display_label"), F.col("c_mktsegment").alias("category")), "shop")
    store.upsert(table(spark, sf, "orders").select(
        column, F.col("o_custkey").cast("string").alias("raw_value"), F.concat(F.lit("Order "), F.col("o_orderkey")).alias("display_label"),
        F.lit(None).cast("string").alias("category"), F.col("o_orderkey").alias("seq")), "shop")
    return store.labels()


@query("glossary", f"""WITH {LABELS_SQL},
    r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY raw_value) AS i FROM labels_),
    cats AS (SELECT lower(category) AS phrase, 'c_nationkey IN [' || string_agg(CASE WHEN i <= 5 THEN '''' || raw_value || '''' END, ', ' ORDER BY i)
             || CASE WHEN COUNT(*) > 5 THEN '...' ELSE '' END || ']' AS maps_to, category FROM r GROUP BY category),
    allp AS (SELECT 1 AS part, 0 AS sub, CAST(r_regionkey AS VARCHAR) AS k, lower(r_name) AS phrase, 'r_name = "' || r_name || '"' AS maps_to
             FROM region WHERE r_name <> 'ASIA'
             UNION ALL SELECT 3, 0, category, phrase, maps_to FROM cats
             UNION ALL SELECT 3, 1, printf('%04d', n_nationkey), 'country ' || lower(n_name), 'column: c_nationkey' FROM nation),
    numbered AS (SELECT *, row_number() OVER (ORDER BY part, sub, k) AS pos FROM allp)
    SELECT pos, phrase, maps_to FROM (SELECT *, row_number() OVER (PARTITION BY phrase ORDER BY pos) AS d FROM numbered WHERE pos <= 30)
    WHERE d = 1""")
def glossary_(spark, sf):
    # one category is defined nowhere else, the others are outranked by a definition
    definitions = table(spark, sf, "region").filter("r_name <> 'ASIA'").select(
        F.col("r_regionkey").alias("seq"), F.lit("r_name").alias("column_name"), F.col("r_name").alias("value"), F.col("r_name").alias("term"))
    synonyms = table(spark, sf, "nation").select(
        F.col("n_nationkey").alias("seq"), F.lit("c_nationkey").alias("column_name"),
        F.concat(F.lit("Country "), F.col("n_name")).alias("synonym"))
    return glossary(_labels(spark, sf), synonyms, definitions)


@query("dimension_values_labeled", f"""WITH {LABELS_SQL}
    SELECT CAST(k AS VARCHAR) AS value, display_label AS label, category
    FROM (SELECT DISTINCT c_nationkey AS k FROM customer ORDER BY 1 LIMIT 100) LEFT JOIN labels_ ON CAST(k AS VARCHAR) = raw_value""")
def dimension_values_labeled(spark, sf):
    return dimension_values(table(spark, sf, "customer"), "c_nationkey", _labels(spark, sf))


COMPONENTS = [
    {"source_table": "sales", "value_column": "l_extendedprice", "sign": "+", "aggregation": "sum",
     "filters": [{"column": "l_returnflag", "operator": "neq", "value": "R"}, {"column": "period", "operator": "between", "value": ["1996-01", "1999-12"]}]},
    {"source_table": "sales", "value_column": "l_extendedprice", "sign": "-", "aggregation": "sum",
     "filters": [{"column": "l_returnflag", "operator": "in", "value": ["R"]}, {"column": "l_quantity", "operator": "gte", "value": 25}]},
    {"source_table": "orders", "value_column": "o_totalprice", "sign": "-", "aggregation": "max",
     "filters": [{"column": "o_orderpriority", "operator": "contains", "value": "URGENT"}]},
]


@query("metric_eval", f"""WITH {SALES}, s AS (
        SELECT o_orderpriority, {exact("CASE WHEN l_returnflag <> 'R' AND period BETWEEN '1996-01' AND '1999-12' THEN l_extendedprice END")}
               - {exact("CASE WHEN l_returnflag = 'R' AND l_quantity >= 25 THEN l_extendedprice END")} AS m FROM sales GROUP BY 1),
    o AS (SELECT o_orderpriority, COALESCE(MAX(CASE WHEN contains(o_orderpriority, 'URGENT') THEN o_totalprice END), 0) AS x FROM orders GROUP BY 1)
    SELECT o_orderpriority, {rounded('m - CAST(x AS DECIMAL(18,4))')} AS metric FROM s JOIN o USING (o_orderpriority)""")
def metric_eval(spark, sf):
    tables = {"sales": sales(spark, sf, "o_orderpriority", "period", "l_returnflag", "l_quantity", "l_extendedprice"),
              "orders": table(spark, sf, "orders")}
    return cents(eval_metric(tables, COMPONENTS, ["o_orderpriority"]), "metric")


@query("aggregate_rule", f"""
    SELECT l_returnflag, l_linestatus, {money('l_extendedprice')} AS l_extendedprice, MAX(l_quantity) AS l_quantity
    FROM lineitem WHERE l_discount <= 0.05 AND l_linenumber NOT IN (1, 2) GROUP BY 1, 2""")
def aggregate_rule_(spark, sf):
    rule = {"source_table": "lineitem", "operation": "aggregate", "operation_config": {
        "group_by": ["l_returnflag", "l_linestatus"],
        "aggregations": [{"column": "l_extendedprice", "function": "sum"}, {"column": "l_quantity", "function": "max"}],
        "filters": [{"column": "l_discount", "operator": "lte", "value": 0.05}, {"column": "l_linenumber", "operator": "not_in", "value": [1, 2]}]}}
    return cents(aggregate_rule({"lineitem": table(spark, sf, "lineitem")}, rule), "l_extendedprice")


@query("metric_ratio", f"""
    WITH n AS (SELECT l_orderkey AS k, {exact('l_extendedprice')} AS a FROM lineitem GROUP BY 1),
         d AS (SELECT o_orderkey AS k, {exact('o_totalprice')} AS b FROM orders GROUP BY 1)
    SELECT COALESCE(n.k, d.k) AS orderkey, {rounded('COALESCE(a, 0)')} AS numerator, {rounded('b')} AS denominator,
           ROUND(CAST(COALESCE(a, 0) AS DOUBLE) / CAST(b AS DOUBLE), 6) AS ratio
    FROM n FULL JOIN d ON n.k = d.k""")
def metric_ratio_(spark, sf):
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("orderkey"), "l_extendedprice")
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("orderkey"), "o_totalprice")
    got = metric_ratio(lines, "l_extendedprice", orders, "o_totalprice", ["orderkey"])
    return cents(got, "numerator", "denominator").withColumn("ratio", F.round("ratio", 6))
