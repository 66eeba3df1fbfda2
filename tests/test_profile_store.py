"""Profiles from states of files against profiles of the whole table."""

import pytest
from pyspark.sql import functions as F

from planspark import ProfileStore, measure_stats, profile_columns
from planspark.sources.shared import new_path
from tests.conftest import rows


def load(spark, low, high, folder, **more):
    frame = spark.range(low, high).select(
        "id", (F.col("id") % 7).cast("string").alias("account_nr"), F.when(F.col("id") % 5 > 0, F.col("id") / 4).alias("amount"),
        F.concat(F.lit("2024-0"), (1 + F.col("id") % 9).cast("string")).alias("month"), F.when(F.col("id") % 3 == 0, "yes").alias("flag"))
    frame.repartition(2).write.mode(more.get("mode", "append")).parquet(folder)


@pytest.fixture
def folder(spark):
    return new_path(spark, "growing table")


def test_an_append_reads_its_new_files_only(spark, folder):
    store = ProfileStore(spark, new_path(spark, "profile"))
    load(spark, 0, 100, folder)
    assert store.update(folder) == 2 and store.update(folder) == 0
    load(spark, 80, 300, folder)
    read, real = [], store._add
    store._add = lambda frame, new: (read.append(frame.count()), real(frame, new))
    assert store.update(folder) == 2 and read == [220]
    whole = spark.read.parquet(folder)
    assert store.profile(folder) == profile_columns(whole)
    assert rows(store.measure_stats(folder, ["amount", "id", "month"])) == rows(measure_stats(whole, ["amount", "id", "month"]))
    again = ProfileStore(spark, store.states.files.root.rsplit("/", 1)[0])
    assert again.update(folder) == 0


def test_files_that_go_or_change_no_longer_count(spark, folder):
    store = ProfileStore(spark, new_path(spark, "profile"))
    load(spark, 0, 50, folder)
    store.update(folder)
    load(spark, 1000, 1100, folder, mode="overwrite")
    assert store.update(folder) == 2
    assert store.profile(folder) == profile_columns(spark.read.parquet(folder))


def test_sketches_stay_within_their_error(spark, folder):
    store = ProfileStore(spark, new_path(spark, "profile"), exact=False)
    for k in range(3):
        load(spark, 20_000 * k, 20_000 * k + 30_000, folder)
        store.update(folder)
    got, number = store.profile(folder)
    want, _ = profile_columns(spark.read.parquet(folder))
    assert number == 90_000
    for g, w in zip(got, want):
        assert abs(g.unique_count - w.unique_count) <= max(1, 4 * 0.0082 * w.unique_count)
        assert (g.column_name, g.data_type, g.null_count, g.sample_values, g.role, g.calendar) == (w.column_name, w.data_type, w.null_count, w.sample_values, w.role, w.calendar)
    assert not store.values.numbers()


def test_a_failed_update_counts_nothing_twice(spark, folder, monkeypatch):
    store = ProfileStore(spark, new_path(spark, "profile"))
    load(spark, 0, 40, folder)
    monkeypatch.setattr("planspark.operators.profile_store._append", _failing(monkeypatch))
    with pytest.raises(OSError):
        store.update(folder)
    assert store.update(folder) == 2
    assert store.profile(folder) == profile_columns(spark.read.parquet(folder))


def _failing(monkeypatch):
    from planspark.operators import profile_store
    real, calls = profile_store._append, []

    def append(table, frame):
        calls.append(table)
        if len(calls) == 2:
            raise OSError("disk")
        real(table, frame)
    return append


def test_files_without_rows_and_folders_without_files(spark, folder):
    store = ProfileStore(spark, new_path(spark, "profile"))
    assert store.update(folder) == 0
    with pytest.raises(ValueError):
        store.profile(folder)
    spark.createDataFrame([], "a int, b string").repartition(1).write.parquet(folder)
    assert store.update(folder) == 1 and store.update(folder) == 0
    profile, number = store.profile(folder)
    assert number == 0 and [p.column_name for p in profile] == ["a", "b"]


def test_text_files_with_a_schema(spark, folder):
    store = ProfileStore(spark, new_path(spark, "profile"))
    spark.range(30).select(F.col("id").cast("string").alias("n"), F.lit("x").alias("c")).coalesce(1).write.csv(folder)
    assert store.update(folder, "csv", schema="n string, c string") == 1
    assert store.profile(folder) == profile_columns(spark.read.schema("n string, c string").csv(folder))
