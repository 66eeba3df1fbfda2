"""Versioned tables and stored transformation steps."""

import threading

import pytest
from pyspark.sql import functions as F

from planspark import VersionConflict, VersionedTable, materialize_steps
from planspark.sources.shared import new_path
from tests.conftest import rows

DATA = [(1, "a", "2024-01", 1.0), (2, "b", "2024-01", 2.0), (3, "a", "2024-02", 3.0), (4, None, None, None), (5, "c", "2024-03", 5.0)]


def stored(spark, by="period"):
    frame = spark.createDataFrame(DATA, "id int, seg string, period string, amount double")
    return VersionedTable.create(frame, new_path(spark, "versions"), by)


def bands(result, order=1, **more):
    return {"step_type": "reclassification", "source_column": "seg", "output_column": "band", "output_type": "text", "step_order": order,
            "rules": [{"condition": {"op": "equals", "value": "c"}, "result": result}, {"default": "rest"}], **more}


@pytest.mark.parametrize("by", ["period", None])
def test_steps_are_stored_in_order(spark, by):
    table = stored(spark, by)
    steps = [bands("special", 2), {"step_type": "rename", "from_column": "band", "to_column": "group", "step_order": 3, "status": "approved"},
             {"step_type": "calculated_column", "output_column": "twice", "output_type": "numeric", "step_order": 1,
              "expression": {"op": "multiply", "left": {"column": "amount"}, "right": {"literal": 2}}},
             {"step_type": "rename", "from_column": "seg", "to_column": "gone", "status": "rejected"},
             {"step_type": "concat", "columns": ["group", "id"], "output_column": "code", "separator": "-", "step_order": 4}]
    found = materialize_steps(table, steps)
    assert [s.get("status") for s in found.steps] == ["applied", "applied", "applied", "rejected", "applied"]
    assert found.rows == 15 and found.moved == 10 and found.version == 4
    got = table.read().select("id", "seg", "period", "amount", F.col("twice").cast("double"), "group", "code")
    assert rows(got, "id") == [(i, s, p, a, None if a is None else 2 * a, g, f"{g}-{i}") for (i, s, p, a), g in zip(DATA, ["rest"] * 4 + ["special"])]
    assert rows(table.read(1), "id") == DATA and table.read().columns == ["id", "seg", "period", "amount", "twice", "group", "code"]


def test_only_partitions_that_change_are_written(spark):
    table = stored(spark)
    materialize_steps(table, [bands("special")])
    before = table.version()
    found = materialize_steps(table, [bands("other")])
    assert found.rows == 5 and found.moved == 1 and len(found.partitions) == 1
    after = table.version()
    assert [p for p in after.folders if after.folders[p] != before.folders[p]] == found.partitions
    again = materialize_steps(table, [bands("other")])
    assert again.moved == 0 and again.partitions == [] and again.rows == 5 and table.version().folders == after.folders
    assert {r.band for r in table.read().collect()} == {"rest", "other"}


def test_a_new_column_of_nulls_writes_nothing(spark):
    table = stored(spark)
    nothing = {"step_type": "calculated_column", "output_column": "ratio", "expression": {"op": "divide", "left": {"column": "amount"}, "right": {"literal": 0}}}
    found = materialize_steps(table, [nothing])
    assert found.moved == 0 and found.partitions == [] and {r.ratio for r in table.read().collect()} == {None}
    retyped = materialize_steps(table, [{**nothing, "expression": {"column": "amount"}}, bands("x")])
    assert retyped.moved > 0 and sorted(r.ratio or 0.0 for r in table.read().collect()) == [0.0, 1.0, 2.0, 3.0, 5.0]


def test_a_failed_write_leaves_the_old_version(spark):
    table = stored(spark)

    @F.udf("string")
    def broken(x):
        raise RuntimeError("lost")

    with pytest.raises(Exception):
        table.update(lambda df: df.withColumn("seg", broken("seg")), ["seg"])
    assert table.numbers() == [1] and rows(table.read(), "id") == DATA
    real, table._write = table._write, lambda *a: (real(*a), (_ for _ in ()).throw(OSError("disk")))[0]
    with pytest.raises(OSError):
        materialize_steps(table, [bands("special")])
    table._write = real
    assert table.numbers() == [1] and rows(table.read(), "id") == DATA
    assert len(table.vacuum()) == 1 and rows(table.read(), "id") == DATA


def test_a_failed_step_keeps_the_steps_before_it(spark):
    table = stored(spark)
    steps = [bands("special"), {"step_type": "rename", "from_column": "nowhere", "to_column": "x", "step_order": 2}]
    with pytest.raises(ValueError):
        materialize_steps(table, steps)
    assert table.numbers() == [1, 2] and "band" in table.read().columns and steps[0].get("status") is None
    with pytest.raises(ValueError):
        table.update(lambda df: df.withColumn("period", F.lit("x")), ["period"])
    with pytest.raises(ValueError):
        table.rename("seg", "amount")


def test_the_first_of_two_writers_wins(spark):
    table = stored(spark)
    late = VersionedTable(spark, table.files.root)
    real = late._write

    def slow(*args):
        found = real(*args)
        materialize_steps(table, [bands("first")])
        return found

    late._write = slow
    with pytest.raises(VersionConflict):
        materialize_steps(late, [bands("second")])
    assert {r.band for r in table.read().collect()} == {"rest", "first"}
    with pytest.raises(VersionConflict):
        VersionedTable.create(table.read(), table.files.root)


def test_appends_at_the_same_time_all_count(spark):
    table = stored(spark)
    more = [spark.createDataFrame([(10 + i, f"2024-0{i + 1}", 9)], "ID int, period string, extra int") for i in range(4)]
    errors = []

    def add(frame):
        try:
            VersionedTable(spark, table.files.root).append(frame)
        except Exception as problem:  # noqa: BLE001
            errors.append(problem)

    threads = [threading.Thread(target=add, args=(f,)) for f in more]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not errors and table.numbers() == [1, 2, 3, 4, 5]
    got = rows(table.read().select("id", "period"), "id")
    assert got == [(i, p) for i, _, p, _ in DATA] + [(10 + i, f"2024-0{i + 1}") for i in range(4)]


def test_appending_while_columns_change(spark):
    table = stored(spark)
    late = VersionedTable(spark, table.files.root)
    real, first = late._write, []

    def slow(*args):
        found = real(*args)
        if not first:
            first.append(1)
            table.rename("seg", "segment")
        return found

    late._write = slow
    late.append(spark.createDataFrame([(9, "z", "2024-09")], "id int, segment string, period string"))
    assert rows(table.read().filter("id = 9").select("segment", "period")) == [("z", "2024-09")]


def test_an_empty_table_takes_steps(spark):
    table = VersionedTable.create(spark.createDataFrame([], "id int, seg string, period string"), new_path(spark, "versions"), "period")
    found = materialize_steps(table, [bands("special")])
    assert (found.rows, found.moved, found.partitions) == (0, 0, []) and table.read().columns == ["id", "seg", "period", "band"]
    assert table.read().count() == 0
