"""Positions and running totals over a whole result, without sorting it in one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.values import precise_sum
from ..sources.shared import settle


def with_running(
    df: DataFrame,
    order: Sequence[Column],
    position: str | None = "pos",
    running: Mapping[str, str] | None = None,
) -> DataFrame:
    """Add the 1-based position and running totals (``{new column: summed column}``) in the given order.

    ``df`` is a group-level result and ``order`` must be total. The rows are range-partitioned by the order and kept in
    shared storage with the number of their range, so both passes see the same ranges; each range is numbered on its own
    and shifted by the sums of the ranges before it (one row per range).
    """
    running = dict(running or {})
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = settle(df.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy("_range").agg(
        F.count(F.lit(1)).alias("_n"), *[precise_sum(F.col(c)).alias(f"_sum_{o}") for o, c in running.items()]
    )
    shifts = sizes.select(
        "_range",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"),
        *[F.coalesce(F.sum(f"_sum_{o}").over(before), F.lit(0.0)).alias(f"_shift_{o}") for o in running],
    )
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = _numbered(ranged, inside, "_pos" if position else None, running)
    shifted = numbered.join(F.broadcast(shifts), "_range")  # one row per range: at most `parts` rows
    keep = [F.col(c) for c in df.columns]
    extra = [(F.col(o) + F.col(f"_shift_{o}")).alias(o) for o in running]
    if position:
        extra.insert(0, (F.col("_pos") + F.col("_shift")).alias(position))
    return shifted.select(*keep, *extra)


def _numbered(df: DataFrame, window, position: str | None, running: Mapping[str, str]) -> DataFrame:
    extra = [F.sum(F.col(c)).over(window).alias(o) for o, c in running.items()]
    if position:
        extra.insert(0, F.count(F.lit(1)).over(window).alias(position))
    return df.select("*", *extra)
