"""Loads and label upserts at the same time."""

import threading

from pyspark.sql import functions as F

from planspark import LabelStore, upsert_labels, write_typed
from planspark.sources.shared import new_path
from planspark.sources.tables import RANGE_BITS, reserve_row_ids
from tests.conftest import rows

SHAPE = "column_name string, raw_value string, display_label string, category string"


def labels(spark, *values):
    return spark.createDataFrame(list(values), SHAPE)


def test_interleaved_loads_have_ids_of_their_own(spark):
    path = new_path(spark, "loads")
    frame = spark.range(50).select(F.col("id").cast("string").alias("n")).repartition(3)
    write_typed(frame, {"n": "integer"}, path)
    first = reserve_row_ids(spark, path)   # a load that has begun and not yet written
    assert write_typed(frame, {"n": "integer"}, path, mode="append") == 50
    second = reserve_row_ids(spark, path)
    assert write_typed(frame, {"n": "integer"}, path, mode="append") == 50
    stored = spark.read.parquet(path)
    assert stored.count() == stored.select("_row_id").distinct().count() == 150
    ranges = {r[0] for r in stored.select(F.shiftright("_row_id", RANGE_BITS)).distinct().collect()}
    assert ranges == {0, 2, 4} and not ranges & {first >> RANGE_BITS, second >> RANGE_BITS}
    assert stored.filter(F.col("_row_id") < 0).isEmpty()


def test_ranges_reserved_at_the_same_time_differ(spark):
    path, found = new_path(spark, "loads"), []
    threads = [threading.Thread(target=lambda: found.append(reserve_row_ids(spark, path))) for _ in range(8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(set(found)) == 8


def test_an_upsert_leaves_other_buckets_alone(spark):
    store = LabelStore(spark, new_path(spark, "labels"), buckets=8, parts=2)
    base = labels(spark, *[(f"col{i % 12}", str(i), f"label {i}", None) for i in range(200)])
    assert store.upsert(base) > 8
    before = store.table.version().folders
    fresh = labels(spark, ("col3", "3", "three", "odd"), ("col3", "x", None, None), ("col3", "", "never", None))
    written = store.upsert(fresh)
    after = store.table.version().folders
    assert 1 <= written <= 2 and sum(before.get(p) != f for p, f in after.items()) == written
    assert rows(store.labels().drop("dataset")) == rows(upsert_labels(base, fresh))
    assert store.upsert(fresh.limit(0)) == 0 and store.table.version().folders == after


def test_upserts_at_the_same_time_all_count(spark):
    store = LabelStore(spark, new_path(spark, "labels"), buckets=2, parts=1)
    store.upsert(labels(spark, ("c", "0", "zero", None)), "d")
    errors = []

    def add(k):
        try:
            LabelStore(spark, store.table.files.root, buckets=2, parts=1).upsert(labels(spark, ("c", str(k), f"n{k}", None)), "d")
        except Exception as problem:  # noqa: BLE001
            errors.append(problem)

    threads = [threading.Thread(target=add, args=(k,)) for k in range(1, 4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not errors and rows(store.labels().select("dataset", "raw_value")) == [("d", str(k)) for k in range(4)]


def test_datasets_are_apart(spark):
    store = LabelStore(spark, new_path(spark, "labels"))
    store.upsert(labels(spark, ("c", "1", "one", "x")), "a")
    store.upsert(labels(spark, ("c", "1", "uno", None)), "b")
    store.upsert(labels(spark, ("c", "1", "One", None)), "a")
    assert rows(store.labels().select("dataset", "display_label", "category")) == [("a", "One", "x"), ("b", "uno", None)]
