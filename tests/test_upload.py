"""Several files to one linked model."""

import pytest

from planspark import ingest_table, ingest_tables


@pytest.fixture()
def files(tmp_path):
    texts = {
        "sales": "Cust Nr;Day;Year;Amount\n1;31-12-2024;2024;10.5\n2;15-01-2025;2025;20\n1;16-01-2025;2025;1.5\n9;17-01-2025;2025;4\n",
        "cust": "Cust Nr;Cust Name\n1;Ann\n2;Bob\n3;Cid\n",
    }
    paths = {}
    for name, text in texts.items():
        (tmp_path / f"{name}.csv").write_text(text)
        paths[name] = str(tmp_path / f"{name}.csv")
    return paths


def test_tables_are_linked_labelled_and_widened(spark, files):
    found = ingest_tables(spark, files)
    links = {(r.source, r.source_column, r.target, r.target_column) for r in found.model.relationships}
    assert links == {("sales", "cust_nr", "cust", "cust_nr"), ("sales", "day", "_calendar", "date")}
    wide = found.baseline(["day", "month_year", "cust_name", "amount"]).orderBy("day").collect()
    assert [tuple(r)[:3] for r in wide] == [("2024-12-31", "2024-12", "Ann"), ("2025-01-15", "2025-01", "Bob"), ("2025-01-16", "2025-01", "Ann"), ("2025-01-17", "2025-01", None)]
    assert {(r.raw_value, r.display_label) for r in found.labels.collect()} == {("1", "Ann"), ("2", "Bob"), ("3", "Cid")}


def test_time_columns_are_text_with_fresh_samples(spark, files):
    found = ingest_table(spark, files["sales"])
    by_name = {p.column_name: p for p in found.profile}
    assert dict(found.df.dtypes)["year"] == "string" and by_name["year"].data_type == "text" and by_name["year"].role == "time"
    assert by_name["day"].sample_values[0] == "2024-12-31" and by_name["day"].calendar == "date"


def test_each_file_is_parsed_twice(spark, files, monkeypatch):
    from planspark.sources import tables
    parsed = []
    original = tables.read_delimited

    def counting(spark, path, *args):
        got = original(spark, path, *args)
        seen = spark.sparkContext.accumulator(0)
        parsed.append(seen)

        def count(batches):
            for batch in batches:
                seen.add(batch.num_rows)
                yield batch
        return got.mapInArrow(count, got.schema)

    monkeypatch.setattr(tables, "read_delimited", counting)
    ingest_tables(spark, files).baseline().collect()
    assert [a.value for a in parsed] == [8, 6]
