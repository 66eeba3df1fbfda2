"""Query register and the frames that queries start from."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession, functions as F

from planspark import Relationship, TableModel, build_baseline, with_period
from planspark.functions import to_cents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under ``name`` with its SQL counterpart."""
    def register(build):
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build
    return register


@lru_cache(maxsize=None)
def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A given table. The frame is kept, so its files are listed and their schema read only once."""
    return spark.read.parquet(f"{sf}/{name}.parquet")


LINKS = [
    Relationship("lineitem", "l_orderkey", "orders", "o_orderkey"),
    Relationship("orders", "o_custkey", "customer", "c_custkey"),
    Relationship("customer", "c_nationkey", "nation", "n_nationkey"),
    Relationship("nation", "n_regionkey", "region", "r_regionkey"),
    Relationship("lineitem", "l_partkey", "part", "p_partkey"),
    Relationship("lineitem", "l_suppkey", "supplier", "s_suppkey"),
    Relationship("supplier", "s_nationkey", "nation", "n_nationkey"),
]

PRIMARY_KEYS = frozenset({
    ("orders", "o_orderkey"), ("customer", "c_custkey"), ("nation", "n_nationkey"), ("region", "r_regionkey"),
    ("part", "p_partkey"), ("supplier", "s_suppkey"),
})


def sales_model(spark: SparkSession, sf: str, unique=PRIMARY_KEYS) -> TableModel:
    names = ("lineitem", "orders", "customer", "nation", "region", "part", "supplier")
    tables = {n: table(spark, sf, n) for n in names}
    tables["lineitem"] = with_period(tables["lineitem"], "l_shipdate")
    return TableModel(tables, LINKS, unique)


def sales(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """Fact rows with the columns asked for; only the dimensions that supply them are joined."""
    return build_baseline(sales_model(spark, sf), "lineitem", columns=list(columns))


def cents(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: to_cents(F.col(c)) for c in columns})


# --- SQL fragments -----------------------------------------------------------------------------------------

def exact(x: str) -> str:
    """Exact sum, as a decimal."""
    return f"COALESCE(SUM(CAST({x} AS DECIMAL(28,10))), 0)"


def rounded(x: str, digits: int = 2) -> str:
    return f"CAST(ROUND(ROUND({x}, 6), {digits}) AS DOUBLE)"


def money(x: str, digits: int = 2) -> str:
    return rounded(exact(x), digits)


SALES = """sales AS (
    SELECT l.*, strftime(l_shipdate, '%Y-%m') AS period, o.o_orderpriority, o.o_custkey, c.c_mktsegment, c.c_nationkey,
           n.n_name, r.r_name, p.p_brand, p.p_type, s.s_name
    FROM lineitem l
    LEFT JOIN orders o ON l.l_orderkey = o.o_orderkey
    LEFT JOIN customer c ON o.o_custkey = c.c_custkey
    LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
    LEFT JOIN region r ON n.n_regionkey = r.r_regionkey
    LEFT JOIN part p ON l.l_partkey = p.p_partkey
    LEFT JOIN supplier s ON l.l_suppkey = s.s_suppkey)"""
