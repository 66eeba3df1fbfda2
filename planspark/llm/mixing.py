"""Mixing sources to target weights: repetition rates per source, a hash-seeded copy for the fraction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.ordering import with_running
from ..sources.shared import settle, tidy

WORD = r"[^\x20\x09-\x0D]+"


def sizes(docs: DataFrame) -> DataFrame:
    """Words per document: ``doc_id, source, size``. A null text has size 0."""
    return docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def source_targets(sized: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """Target words per source: ``source, source_size, target``.

    Sources in code point order, null last, get ``weights`` in turn and divide ``share`` times all words by weight.
    No target exceeds ``most`` times its source; the excess goes to the other sources by weight. Only totals reach the
    driver; the work is done on one row per source.
    """
    source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    # Numbered in ranges: there may be as many sources as sites.
    source = with_running(source, [F.col("source").isNull(), F.col("source")], position="place")
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    source = settle(source.select("source", "source_size", weight.alias("weight")))

    def totals(free: Column):
        return source.agg(
            F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum(F.when(~free, F.col("source_size"))), F.lit(0)),
            F.coalesce(F.sum(F.when(free, F.col("weight"))), F.lit(0)), F.count(F.when(free, 1)),
        ).first()

    # A source once full stays full, since the level only rises: at most one round a source, and few in practice.
    level, left = float("inf"), -1
    while True:
        free = F.lit(True) if level == float("inf") else F.col("weight") * F.lit(level) <= most * F.col("source_size")
        every, full, weighed, free_now = totals(free)
        if free_now == left or not weighed:
            break
        level, left = (share * every - most * full) / weighed, free_now
    wanted = F.col("weight") * F.lit(level)
    capped = (most * F.col("source_size")).cast("double")
    return source.select("source", "source_size", F.when(wanted <= capped, wanted).otherwise(capped).alias("target"))


def unit(doc_id: Column, seed: str = "mix") -> Column:
    """A number in [0, 1) that depends on the document and the seed alone: 52 bits of an MD5."""
    text = F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(2**52))


@tidy
def mix(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, most: int = 2, seed: str = "mix") -> DataFrame:
    """How often each document is taken: ``doc_id, source, size, source_size, target, copies, taken``.

    A document comes floor(rate) times, plus once with the probability of the rate's fraction, where the rate is its
    source's target over its size; the draw is a hash of the id, so reruns agree. Repeated rows are rows of their own
    (with the same draw). Documents of a source without words have rate 0. An empty table gives no rows.
    """
    sized = settle(sizes(docs))
    copied = _copies(sized, source_targets(sized, weights, share, most), seed)
    return copied.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def _copies(docs: DataFrame, target: DataFrame, seed: str) -> DataFrame:
    joined = docs.alias("d").join(target.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source")), "left")
    rate = F.when(F.col("t.source_size") > 0, F.col("t.target") / F.col("t.source_size")).otherwise(F.lit(0.0))
    copies = F.floor(rate) + (unit(F.col("d.doc_id"), seed) < rate - F.floor(rate)).cast("long")
    return joined.select("d.*", F.col("t.source_size").alias("source_size"), F.col("t.target").alias("target"), copies.alias("copies"))


@tidy
def emit(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, most: int = 2, seed: str = "mix") -> DataFrame:
    """The documents themselves, each as often as ``mix`` takes it, with the number of the copy (from 1) as ``mix_copy``.

    All columns of ``docs`` stay, whatever their names; repeated rows are rows of their own.
    """
    target = source_targets(settle(sizes(docs)), weights, share, most)
    held = docs.select("doc_id", "source", F.struct("*").alias("held"))
    return (_copies(held, target, seed).filter("copies > 0")
            .select("held.*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("mix_copy")))
