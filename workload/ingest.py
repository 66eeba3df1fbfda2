from __future__ import annotations

from pyspark.sql import functions as F

from planspark import (
    ProfileStore, coerce_types, export_rows, infer_types, ingest_table, ingest_tables, measure_stats, normalize_period, profile_columns, read_delimited,
    sanitize_columns, write_typed,
)
from planspark.operators.profile import column_facts
from planspark.sources.shared import new_path
from .registry import cents, exact, money, query, rounded, table


def _delimited(spark, sf):
    """Orders written as delimited text to shared storage."""
    path = new_path(spark, "orders") + ".csv"
    priority = F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("N/A")).when(
        F.col("o_orderpriority") == "5-LOW", F.lit("-")).otherwise(F.col("o_orderpriority"))
    table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("Order Nr"), F.date_format("o_orderdate", "dd.MM.yyyy").alias("Order Date"),
        F.col("o_orderstatus").alias("Größe (€)"), F.col("o_totalprice").alias("Total"), priority.alias("priority"),
    ).write.csv(path, sep=";", header=True)
    return path


PRIORITY = "CASE WHEN o_orderpriority NOT IN ('1-URGENT', '5-LOW') THEN o_orderpriority END"


@query("read_delimited", f"""
    SELECT CAST(o_orderkey AS VARCHAR) AS "Order Nr", strftime(o_orderdate, '%d.%m.%Y') AS "Order Date",
           o_orderstatus AS "Größe (€)", CAST(o_totalprice AS VARCHAR) AS "Total", {PRIORITY} AS priority FROM orders""")
def read_delimited_(spark, sf):
    return read_delimited(spark, _delimited(spark, sf))


@query("ingest_table", f"""
    SELECT o_orderkey AS order_nr, strftime(o_orderdate, '%Y-%m-%d') AS order_date, o_orderstatus AS groesse,
           o_totalprice AS total, {PRIORITY} AS priority FROM orders""")
def ingest_table_(spark, sf):
    return ingest_table(spark, _delimited(spark, sf), approx=True).df


@query("write_typed", f"""
    SELECT strftime(o_orderdate, '%Y-%m') AS period, COUNT(*) AS n, {rounded(exact('o_totalprice'))} AS total,
           (SELECT COUNT(*) FROM orders) AS written
    FROM orders GROUP BY 1""")
def write_typed_(spark, sf):
    orders = table(spark, sf, "orders").select(
        "o_orderkey", "o_totalprice", F.date_format("o_orderdate", "yyyy-MM").alias("period"))
    path = new_path(spark, "typed")
    written = write_typed(orders, {"o_orderkey": "integer", "o_totalprice": "numeric", "period": "text"}, path, "period")
    stored = spark.read.schema("o_orderkey bigint, o_totalprice decimal(18,4), _row_id bigint, period string").parquet(path)
    got = stored.groupBy("period").agg(F.count_distinct("_row_id").alias("n"), F.sum("o_totalprice").cast("double").alias("total"))
    return cents(got, "total").withColumn("written", F.lit(written).cast("bigint"))


@query("coerce_types", """
    SELECT o_orderkey, try_cast(CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS DOUBLE) AS total,
           try_cast(substr(o_orderpriority, 1, 1) AS BIGINT) AS level, NULL::BIGINT AS bad,
           o_orderstatus = 'F' AS done, strftime(o_orderdate, '%Y-%m-%d') AS day
    FROM orders""")
def coerce_types_(spark, sf):
    raw = table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("o_orderkey"),
        F.when(F.col("o_orderstatus") == "P", F.lit("n.a.")).otherwise(F.col("o_totalprice").cast("string")).alias("total"),
        F.substring("o_orderpriority", 1, 1).alias("level"), F.col("o_orderpriority").alias("bad"),
        (F.col("o_orderstatus") == "F").cast("string").alias("done"), F.date_format("o_orderdate", "dd.MM.yyyy").alias("day"))
    got = coerce_types(raw, {"o_orderkey": "integer", "total": "numeric", "level": "integer", "bad": "integer",
                             "done": "boolean", "day": "date"})
    return got.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("read_delimited_quoted", """
    SELECT CAST(o_orderkey AS VARCHAR) AS key, o_orderstatus || chr(10) || '"' || o_orderpriority || '",' || chr(10) AS note,
           CASE WHEN o_orderkey % 3 > 0 THEN 'line' || chr(10) || o_custkey END AS more FROM orders""")
def read_delimited_quoted(spark, sf):
    path, key = new_path(spark, "quoted") + ".csv", F.col("o_orderkey")
    table(spark, sf, "orders").select(
        key.cast("string").alias("key"), F.concat("o_orderstatus", F.lit('\n"'), "o_orderpriority", F.lit('",\n')).alias("note"),
        F.when(key % 3 > 0, F.concat(F.lit("line\n"), F.col("o_custkey").cast("string"))).alias("more"),
    ).write.csv(path, header=True, quoteAll=True, escape='"', nullValue="-", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return read_delimited(spark, path, sep=",", multi_line=True)


@query("export_rows", """
    SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS total,
           strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS at, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders""")
def export_rows_(spark, sf):
    return export_rows(table(spark, sf, "orders").select(
        "o_orderkey", F.when(F.col("o_orderstatus") == "P", F.lit(float("nan"))).otherwise(F.col("o_totalprice")).alias("total"),
        F.col("o_orderdate").alias("at"), F.col("o_orderdate").cast("date").alias("day")))


@query("infer_types", """
    SELECT o_orderkey, CASE WHEN month(o_orderdate) <> 2 THEN o_totalprice END AS total, o_orderstatus = 'F' AS done,
           strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderpriority AS priority
    FROM orders""")
def infer_types_(spark, sf):
    key = F.col("o_orderkey")
    raw = table(spark, sf, "orders").select(
        F.concat(F.lit(" "), key.cast("string")).alias("o_orderkey"),
        F.when(F.month("o_orderdate") == 2, F.lit("n.a.")).otherwise(F.col("o_totalprice").cast("string")).alias("total"),
        F.when(F.col("o_orderstatus") == "F", F.lit("Yes")).otherwise(F.lit("no")).alias("done"),
        F.date_format("o_orderdate", "dd.MM.yyyy").alias("day"), F.col("o_orderpriority").alias("priority"))
    got = infer_types(raw)
    return got.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


def _facts_sql(t, columns):
    return " UNION ALL ".join(f"""
    SELECT '{c}' AS column_name, COUNT(DISTINCT {x}) + CAST(max(CASE WHEN {x} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS unique_count,
           COUNT(*) FILTER ({x} IS NULL) AS null_count, min({x}) AS first_sample FROM {t}""" for c, x in columns)


_ORDER_TEXTS = [("o_orderkey", "CAST(o_orderkey AS VARCHAR)"), ("o_custkey", "CAST(o_custkey AS VARCHAR)"),
                ("o_orderstatus", "o_orderstatus"), ("o_totalprice", "CAST(o_totalprice AS VARCHAR)"),
                ("o_orderdate", "strftime(o_orderdate, '%Y-%m-%d')"), ("o_orderpriority", PRIORITY)]


@query("profile_columns", _facts_sql("orders", _ORDER_TEXTS))
def profile_columns_(spark, sf):
    orders = table(spark, sf, "orders").withColumn(
        "o_orderpriority", F.when(~F.col("o_orderpriority").isin("1-URGENT", "5-LOW"), F.col("o_orderpriority")))
    return column_facts(orders).select("column_name", "unique_count", "null_count", F.get("samples", 0).alias("first_sample"))


@query("profile_increments", f"""
    SELECT p.*, m.min, m.max, m.sum FROM (SELECT column_name, unique_count, null_count, samples FROM ({" UNION ALL ".join(f"""
        SELECT '{c}' AS column_name, COUNT(DISTINCT {x}) + CAST(max(CASE WHEN {x} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS unique_count,
               COUNT(*) FILTER ({x} IS NULL) AS null_count, array_to_string(list_sort(list(DISTINCT {x}) FILTER ({x} IS NOT NULL))[1:20], '|') AS samples
        FROM orders""" for c, x in _ORDER_TEXTS)})) p
    LEFT JOIN (SELECT 'o_totalprice' AS column_name, ROUND(min(o_totalprice), 2) AS min, ROUND(max(o_totalprice), 2) AS max, {money('o_totalprice')} AS sum
               FROM orders) m USING (column_name)""")
def profile_increments(spark, sf):
    """Orders arrive in two loads; the profile of the whole comes from the states of its files."""
    orders = table(spark, sf, "orders").withColumn(
        "o_orderpriority", F.when(~F.col("o_orderpriority").isin("1-URGENT", "5-LOW"), F.col("o_orderpriority")))
    folder, store = new_path(spark, "orders"), ProfileStore(spark, new_path(spark, "profile"))
    for load in ("o_orderdate < '1995-01-01'", "NOT coalesce(o_orderdate < '1995-01-01', false)"):
        orders.filter(load).write.mode("append").parquet(folder)
        store.update(folder)
    stats = store.measure_stats(folder, ["o_totalprice"])
    shown = store.facts(folder).select("column_name", "unique_count", "null_count", F.array_join("samples", "|").alias("samples"))
    return shown.join(stats, "column_name", "left")


_ROLE_COLUMNS = {
    "l_orderkey": "integer", "l_linenumber": "integer", "l_extendedprice": "numeric", "l_discount": "numeric",
    "l_returnflag": "text", "l_shipdate": "date", "account_nr": "integer", "constant": "integer", "sum_quantity": "integer",
    "code": "integer",
}
_ROLE_SOURCE = """(SELECT l_orderkey, l_linenumber, l_extendedprice, l_discount, l_returnflag, l_shipdate,
    l_partkey AS account_nr, 1 AS constant, CAST(l_quantity AS BIGINT) AS sum_quantity, 400 + l_linenumber AS code FROM lineitem)"""


@query("detect_roles", "SELECT column_name, CASE WHEN u = 1 THEN 'ignore' WHEN dt = 'date' THEN 'time' "
       "WHEN regexp_matches(column_name, '_nr$') THEN 'key' "
       "WHEN dt = 'integer' AND u BETWEEN 2 AND 500 AND regexp_matches(sample, '^[0-9]{3,6}$') THEN 'key' "
       "WHEN dt = 'numeric' OR (dt = 'integer' AND contains(column_name, 'quantity')) THEN 'measure' ELSE 'attribute' END AS role, "
       "dt AS data_type FROM (" + " UNION ALL ".join(
           f"SELECT '{c}' AS column_name, '{t}' AS dt, COUNT(DISTINCT {c}) AS u, min(CAST({c} AS VARCHAR)) AS sample FROM {_ROLE_SOURCE}"
           for c, t in _ROLE_COLUMNS.items()) + ")")
def detect_roles_(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_extendedprice", "l_discount", "l_returnflag", "l_shipdate",
        F.col("l_partkey").alias("account_nr"), F.lit(1).alias("constant"),
        F.col("l_quantity").cast("bigint").alias("sum_quantity"), (F.col("l_linenumber") + 400).alias("code"))
    profile, _ = profile_columns(rows)
    return spark.createDataFrame([(p.column_name, p.role, p.data_type) for p in profile], "column_name string, role string, data_type string")


@query("sanitize_columns", """
    SELECT c_custkey AS groesse, c_acctbal AS col_2024_wert, c_name AS konto_nr, c_mktsegment AS konto_nr_2, c_nationkey AS col FROM customer""")
def sanitize_columns_(spark, sf):
    odd = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("Größe (€)"), F.col("c_acctbal").alias("2024 Wert"), F.col("c_name").alias("Konto-Nr."),
        F.col("c_mktsegment").alias("Kontó Nr"), F.col("c_nationkey").alias("§"))
    return sanitize_columns(odd)[0]


@query("normalize_period", """
    SELECT CASE WHEN o_orderpriority = '5-LOW' THEN 'open' ELSE strftime(o_orderdate, '%Y-%m') END AS period, COUNT(*) AS n
    FROM orders GROUP BY 1""")
def normalize_period_(spark, sf):
    german = F.concat(F.month("o_orderdate").cast("string"), F.lit("."), F.year("o_orderdate").cast("string"))
    raw = table(spark, sf, "orders").select(
        F.when(F.col("o_orderpriority") == "5-LOW", F.lit("open")).otherwise(german).alias("period"))
    return normalize_period(raw, "period").groupBy("period").agg(F.count(F.lit(1)).alias("n"))


@query("measure_stats", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, ROUND(MIN({c}), 2) AS min, ROUND(MAX({c}), 2) AS max, {rounded(exact(c))} AS sum FROM lineitem"
    for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")))
def measure_stats_(spark, sf):
    return measure_stats(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])


def _uploads(spark, sf):
    """Orders, customers and nations as text files whose key columns share their names."""
    shapes = {
        "orders": [F.col("o_orderkey").alias("Order Nr"), F.col("o_custkey").alias("Cust Nr"), F.date_format("o_orderdate", "dd-MM-yyyy").alias("Order Date"),
                   F.year("o_orderdate").alias("Year"), F.col("o_totalprice").alias("Total Amount")],
        "customer": [F.col("c_custkey").alias("Cust Nr"), F.col("c_name").alias("Cust Name"), F.col("c_nationkey").alias("Nation Nr"), F.col("c_mktsegment").alias("Segment")],
        "nation": [F.col("n_nationkey").alias("Nation Nr"), F.col("n_name").alias("Nation Name")],
    }
    paths = {}
    for name, columns in shapes.items():
        paths[name] = new_path(spark, name) + ".csv"
        table(spark, sf, name).select(*columns).write.csv(paths[name], sep=";", header=True)
    return paths


@query("ingest_model", f"""
    SELECT n.n_name AS nation_name, strftime(o.o_orderdate, '%Y-%m') AS month_year, strftime(o.o_orderdate, '%Y') AS year_text,
           count(*) AS n, {rounded(exact('o_totalprice'))} AS total
    FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY 1, 2, 3""")
def ingest_model(spark, sf):
    uploaded = ingest_tables(spark, _uploads(spark, sf))
    wide = uploaded.baseline(["nation_name", "month_year", "year", "total_amount"])
    got = wide.groupBy("nation_name", "month_year", F.col("year").alias("year_text")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("total_amount").cast("decimal(28,10)")).cast("double").alias("total"))
    return cents(got, "total")


@query("ingest_model_labels", """
    SELECT column_name, count(*) AS n, min(display_label) AS first_label FROM (
        SELECT 'cust_nr' AS column_name, c_name AS display_label FROM customer) GROUP BY 1""")
def ingest_model_labels(spark, sf):
    labels = ingest_tables(spark, _uploads(spark, sf)).labels
    return labels.groupBy("column_name").agg(F.count(F.lit(1)).alias("n"), F.min("display_label").alias("first_label"))
