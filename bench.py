"""Headline queries on the tables in ``$BENCH_SF_DIR``; prints one JSON line.

Each query runs once to warm up, then at least twice and for up to five seconds; its best time counts. Results are consumed in full by the noop
sink. ``rows_rules_per_sec`` relates the rule chains to the reference target of 100,000 rows x 5 rules.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession, functions as F

from planspark import apply_rules, infer_types, pivot_long, run_query, variance
from workload import QUERIES
from workload.registry import sales

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
V = "l_extendedprice"
BUDGET = 5.0  # seconds per query

SEGMENTS = ["BUILDING", "AUTOMOBILE", "MACHINERY", "HOUSEHOLD", "FURNITURE"]
MULTIPLIERS = [{"type": "multiplier", "factor": 1 + i / 100, "filters": {"c_mktsegment": [s]}} for i, s in enumerate(SEGMENTS)]
OFFSETS = [{"type": "offset", "offset": 1000.0 * (i + 1), "filters": {"c_mktsegment": SEGMENTS[i:]}} for i in range(5)]
EVEN = [{"type": "offset", "offset": 1000.0, "distribution": "equal", "filters": {"c_mktsegment": [s]},
         "periodFrom": "1996-01", "periodTo": "1999-12"} for s in SEGMENTS]


def _wide(spark):
    return sales(spark, FOLDER, "period", "c_mktsegment", "n_name", "l_returnflag", V)


def _texts(spark):
    lines = spark.read.parquet(f"{FOLDER}/lineitem.parquet")
    return lines.select(*[
        F.date_format(c, "yyyy-MM-dd").alias(c) if c == "l_shipdate" else F.col(c).cast("string").alias(c) for c in lines.columns])


def _chain(rules):
    return lambda spark: apply_rules(_wide(spark), rules, V)


HEADLINES = {
    "baseline_build": _wide,
    "group_query": lambda spark: run_query(_wide(spark), {
        "group_by": ["period", "c_mktsegment"], "aggregations": {V: "sum"}, "order_by": [["period", "asc"]], "limit": 0}),
    "rules_5_multipliers": _chain(MULTIPLIERS),
    "rules_5_offsets": _chain(OFFSETS),
    "rules_5_even_offsets": _chain(EVEN),
    "variance": lambda spark: variance(None, apply_rules(_wide(spark), MULTIPLIERS, V), ["period"], V),
    "pivot": lambda spark: pivot_long(_wide(spark), ["n_name"], "l_returnflag", V),
}
for _name in ("scenario_output", "scenario_chained", "waterfall_server", "comparison", "project_seasonal",
              "detect_relationships", "relationship_coverage", "profile_columns", "pivot_sorted", "metric_ratio", "join_dedup_dim"):
    HEADLINES[_name] = lambda spark, q=QUERIES[_name]: q(spark, FOLDER)


def _timed(spark, build) -> float:
    start = time.perf_counter()
    build(spark).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def _best(spark, build) -> float:
    _timed(spark, build)
    times = []
    while len(times) < 2 or sum(times) < BUDGET and len(times) < 12:
        times.append(_timed(spark, build))
    return min(times)


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "6g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    lines = spark.read.parquet(f"{FOLDER}/lineitem.parquet").count()
    # as the reference target counts it: the rules alone, on rows already in memory
    held = _wide(spark).persist()
    held.count()
    timings = {"rules_only_5_multipliers": lambda s: apply_rules(held, MULTIPLIERS, V),
               "rules_only_5_offsets": lambda s: apply_rules(held, OFFSETS, V)}
    # text rows as a delimited file would give them, in as many splits as there are cores
    texts = _texts(spark).repartition(int(CPUS)).persist()
    texts.count()
    timings["infer_types"] = lambda s: infer_types(texts)
    seconds = {}
    for name, build in {**timings, **HEADLINES}.items():
        if name == next(iter(HEADLINES)):
            held.unpersist()
            texts.unpersist()
        seconds[name] = round(_best(spark, build), 4)
        if os.environ.get("BENCH_VERBOSE"):
            print(name, seconds[name], file=sys.stderr, flush=True)
    rates = {n: round(lines * 5 / seconds[n]) for n in seconds if n.startswith("rules_")}
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 4), "unit": "sec", "queries": seconds,
        "sf": FOLDER.rstrip("/").rsplit("sf", 1)[-1], "fact_rows": lines, "rows_rules_per_sec": rates,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
