"""Bounded training samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .texts import fold_column


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, folds: int = 4, held_fold: int = 2) -> DataFrame:
    """At most ``per_class`` documents of either label outside the held-out fold: ``doc_id, label, text``.

    The ones whose hashed id comes first are taken, so the sample is even and the same on every run. Labels that are null
    or not 0 or 1 don't count; a document labelled twice may come twice. At most ``2 * per_class`` ids are broadcast.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).filter("doc_id IS NOT NULL AND label IN (0, 1)")
    known = known.filter(fold_column(F.col("doc_id"), folds) != held_fold)
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    first = [known.filter(F.col("label") == v).orderBy(*order).limit(per_class) for v in (0, 1)]
    chosen = first[0].unionByName(first[1])
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text")
