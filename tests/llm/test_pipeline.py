"""The pipeline and the classifiers' folds on messy and empty tables, and what operators leave in storage."""

import os

import corpus_pipeline
from planspark.llm import jaccard, language, linededup, quality, toxicity
from planspark.sources.shared import shared_folder, stored_under


def folder(spark, tmp_path, docs, labels, items):
    sf = str(tmp_path / "sf")
    docs.write.parquet(f"{sf}/documents.parquet")
    labels.write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    return sf


def test_stages_take_messy_and_empty_tables(spark, messy, no_docs, some_labels, tmp_path):
    sf = folder(spark, tmp_path, messy, some_labels, [(1, None), (2, ""), (None, "the quick brown fox jumps over the lazy dog while seven wise owls")])
    for _, stage in corpus_pipeline.STAGES[1:]:
        out = stage(spark, messy, sf)
        assert out.columns[:len(messy.columns)] == messy.columns and 0 < out.count()
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, no_docs, sf)
        assert out.columns[:len(messy.columns)] == messy.columns and out.count() == 0
    kept = corpus_pipeline.near_duplicates(spark, messy, sf)
    assert sorted(r.doc_id for r in kept.filter("text = 'one'").collect()) == [6]


def test_held_out_is_never_null(spark, messy, some_labels):
    for found in (toxicity.classify(messy, some_labels), quality.classify(messy, some_labels), language.identify(messy)):
        rows = found.select("doc_id", "held_out").collect()
        assert len(rows) == messy.count() and all(isinstance(r.held_out, bool) for r in rows)
        assert {r.held_out for r in rows if r.doc_id is None} == {False}


def stored(spark):
    place = f"{shared_folder(spark)}/planspark".removeprefix("file:")
    return set(os.listdir(place)) if os.path.isdir(place) else set()


def test_operators_leave_only_what_their_result_reads(spark, messy):
    for build in (jaccard.jaccard_components, jaccard.keep_one, linededup.without_shared_lines):
        before = stored(spark)
        found = build(messy)
        left = stored(spark) - before
        assert left == stored_under(found) - before and found.count() > 0
