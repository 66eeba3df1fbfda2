"""From raw documents to a training mix: quality, near-duplicates, repeated passages, benchmark leaks, source weights.

Every stage takes ``(spark, docs, sf_dir)`` and returns a frame; each is written as Parquet and reread as the next one's
documents. All but the last return the columns of ``documents``; the last adds the number of the copy. Every stage takes null ids,
null, empty and very long texts, repeated rows and further columns as they come, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from planspark.llm import decontamination, jaccard, mixing, quality, repeats
from planspark.sources.shared import discard, new_path, scope

QUALITY = 0.7


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier does not reject. Null and empty texts are judged as one empty line; equal texts are
    judged alike. With labels of one kind only, or none, every score is 0.5, so nothing is kept at the threshold of 0.7."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs, quality.fit(docs, labels), QUALITY)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by shingles of five words and a similarity of 0.8 or more: the one with the smallest
    id (null last), of equal ids the one whose text has the smaller hash. Texts without words link with nothing and all stay."""
    return jaccard.keep_one(docs, jaccard.Similarity(5, 80))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that an earlier 100-byte passage has; documents of which nothing is left go.

    Null and empty texts stay. Of repeated rows the first keeps its text. ``n_chars`` is that of the shorter text.
    """
    found = repeats.without_repeats(docs).filter("n_removed = 0 OR n_removed < n_bytes")
    columns = {"text": F.col("kept"), "n_chars": F.when(F.col("n_removed") > 0, F.length("kept")).otherwise(F.col("doc.n_chars")).cast("long")}
    return found.select(*[columns.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Null and empty texts hold none; null and empty items are in no document."""
    return decontamination.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's weight asks for, with the copy's number as ``mix_copy``. A null source is a source;
    a source without words is left out."""
    return mixing.emit(docs)


STAGES = [
    ("quality classifier", quality_filter),
    ("n-gram jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("benchmark decontamination", benchmark_leaks),
    ("mixing to target weights", source_mix),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result stored in the shared folder before the next stage reads it.

    What a stage has stored for itself, and the result of the stage before it, go once its own result is stored.
    """
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        path = new_path(spark, "stage")
        with scope(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if last:
            discard(spark, last)
        docs, last = spark.read.parquet(path), path
    return docs
