"""Files, inference, profiles, names, typed tables."""

import pytest
from pyspark.sql import functions as F

from planspark import (
    coerce_types, export_rows, infer_types, ingest_table, measure_stats, normalize_period, profile_columns, read_delimited,
    sanitize_columns, write_table, write_typed,
)
from planspark.operators.profile import column_facts, default_fact, detect_role, is_fact
from planspark.sources.infer import infer_schema
from planspark.sources.naming import sanitize_name, unique_names
from tests.conftest import rows


def texts(spark, **columns):
    names = list(columns)
    shape = ", ".join(f"{n} string" for n in names)
    return spark.createDataFrame(list(zip(*columns.values())), shape)


@pytest.mark.parametrize("name, sep, content", [
    ("comma.csv", None, "a,b\n1,x;y\n2,NA\n"), ("semicolon.csv", None, "a;b\n1;x\n2;N/A\n"),
    ("tab.tsv", None, "a\tb\n1\tx\n2\t-\n"), ("pipe.txt", None, "a|b\n1|x\n2|#N/A\n"),
    ("bom.csv", None, "﻿a,b\n1,x\n2,null\n"), ("given.csv", "|", "a|b\n1|x\n2|NULL\n"),
])
def test_separators_and_null_tokens(spark, tmp_path, name, sep, content):
    path = tmp_path / name
    path.write_text(content, encoding="utf-8")
    got = read_delimited(spark, str(path), sep)
    assert got.columns == ["a", "b"]
    assert rows(got) == [("1", "x;y" if name == "comma.csv" else "x"), ("2", None)]


def test_ingest_gives_typed_rows_roles_and_iso_times(spark, tmp_path):
    path = tmp_path / "ledger.csv"
    lines = ["Konto;Buchungs Datum;Betrag (€);Text;Aktiv"]
    lines += [f"{400 + i};{i + 1:02d}.03.2024;{i}.5;t{i};{'yes' if i % 2 else 'no'}" for i in range(10)]
    path.write_text("\n".join(lines), encoding="utf-8")
    result = ingest_table(spark, str(path))
    assert result.row_count == 10
    assert dict(result.df.dtypes) == {"konto": "bigint", "buchungs_datum": "string", "betrag": "double", "text": "string", "aktiv": "boolean"}
    assert {p.column_name: p.role for p in result.profile} == {
        "konto": "key", "buchungs_datum": "time", "betrag": "measure", "text": "attribute", "aktiv": "attribute"}
    assert result.df.agg(F.max("buchungs_datum")).first()[0] == "2024-03-10"
    assert next(p for p in result.profile if p.role == "time").data_type == "text"


def test_other_file_types_are_rejected(spark):
    with pytest.raises(ValueError, match="unsupported"):
        ingest_table(spark, "/tmp/book.xlsx")


@pytest.mark.parametrize("values, want", [
    (["yes", "NO", " x ", "", "1", None], "boolean"), (["0", "1", "1", "0"], "boolean"),
    (["1", "2", "3", None], "integer"), (["1.0", "2", "1e3"], "integer"), (["1.5", "2", "-3"], "numeric"),
    (["1"] * 5 + ["2"] * 14 + ["bad"], "integer"), (["2"] * 17 + ["bad"] * 3, "text"),
    (["2024-01-31", "2024-02-29"], "date:yyyy-M-d"), (["31.12.2024", "1.2.2024"], "date:d.M.yyyy"),
    (["12/31/2024", "01/02/2024"], "date:M/d/yyyy"), (["31/12/2024", "01/02/2024"], "date:d/M/yyyy"),
    (["20240131", "20240229"], "integer"), (["2024-02-31"] * 3, "text"), (["1d", "2f", "0x1"], "text"),
    ([None, None], "text"), (["a", "b"], "text"),
])
def test_type_of_a_text_column(spark, values, want):
    assert infer_schema(texts(spark, c=values)) == {"c": want}


def test_inference_options(spark):
    digits = texts(spark, c=["0", "1"])
    assert infer_schema(digits, infer_bool_digits=False) == {"c": "integer"}
    german = texts(spark, c=["1.234,56", "€ 12,50", "-7"])
    assert [r[0] for r in infer_types(german, decimal_style="de").collect()] == [1234.56, 12.5, -7.0]


def test_inferred_values(spark):
    df = texts(spark, b=["yes", "n", "", None], n=[" 9007199254740993 ", "2", "3", "4"], d=["2024-01-05", None, None, None], t=[" a ", "b", "c", None])
    got = infer_types(df)
    assert dict(got.dtypes) == {"b": "boolean", "n": "bigint", "d": "date", "t": "string"}
    assert [tuple(r) for r in got.select("b", "n", "t", F.col("d").cast("string")).collect()] == [
        (True, 9007199254740993, "a", "2024-01-05"), (False, 2, "b", None), (False, 3, "c", None), (None, 4, None, None)]


def test_typed_data_survives_a_round_trip_through_text(spark):
    typed = spark.createDataFrame([(i, i + 0.25, f"w{i}", bool(i % 2)) for i in range(1, 30)], "a bigint, b double, c string, d boolean")
    as_text = typed.select(*[F.col(c).cast("string").alias(c) for c in typed.columns])
    assert infer_types(as_text).dtypes == typed.dtypes and rows(infer_types(as_text)) == rows(typed)


def test_coercion_makes_null_of_what_does_not_fit(spark):
    df = texts(spark, i=["1", "2.5", "x"], n=["1.5", "1d", "7"], b=["TRUE", "yes", "false"], d=["2024-01-31", "31.01.2024", "soon"], t=["a", None, "c"])
    got = coerce_types(df, {"i": "integer", "n": "numeric", "b": "boolean", "d": "date"})
    assert [tuple(r) for r in got.withColumn("d", F.col("d").cast("string")).collect()] == [
        (1, 1.5, True, "2024-01-31", "a"), (None, None, None, "2024-01-31", None), (None, 7.0, False, None, "c")]


@pytest.mark.parametrize("values, want", [
    (["2024-01-05", "x"], ["2024-01-05", "x"]), (["1.2024", "12.2024", " 3.2024"], ["2024-01", "2024-12", "2024-03"]),
    (["31.12.2024", "01.02.2024", "bad", "02.02.2024"], ["2024-12-31", "2024-02-01", "bad", "2024-02-02"]),
    (["1.2.2024", "11.12.2024"], ["2024-02-01", "2024-12-11"]), (["2024/01/31"], ["2024-01-31"]),
    (["02/03/2024"], ["2024-03-02"]), (["02-03-2024", None], ["2024-03-02", None]),
])
def test_time_normalisation(spark, values, want):
    assert [r[0] for r in normalize_period(texts(spark, p=values), "p").collect()] == want


def test_month_first_time_normalisation(spark):
    assert normalize_period(texts(spark, p=["02/03/2024"]), "p", dayfirst=False).first()[0] == "2024-02-03"


def test_names():
    assert [sanitize_name(n) for n in ("Größe (€)", "2024 Wert", "Ünï--x", "§", "a" * 70, "__A__")] == [
        "groesse", "col_2024_wert", "ueni_x", "col", "a" * 63, "a"]
    assert unique_names(["x", "x", "x_2", "x"]) == ["x", "x_2", "x_2_2", "x_3"]
    assert [sanitize_name(sanitize_name(n)) for n in ("Größe", "1")] == ["groesse", "col_1"]


def test_sanitised_table_keeps_its_values(spark):
    df = spark.createDataFrame([(1, 2)], ["A B", "a.b"])
    safe, names = sanitize_columns(df)
    assert safe.columns == ["a_b", "a_b_2"] and names == {"a_b": "A B", "a_b_2": "a.b"} and rows(safe) == [(1, 2)]


@pytest.mark.parametrize("args, want", [
    (("amount", "numeric", 50, 60, 100), "ignore"), (("amount", "numeric", 1, 0, 100), "ignore"),
    (("Row Count", "integer", 9, 0, 100), "ignore"), (("year", "integer", 9, 0, 100), "time"),
    (("booked", "date", 9, 0, 100), "time"), (("customer_id", "integer", 9, 0, 100), "key"),
    (("reihe", "integer", 9, 0, 100, ["400", "401"]), "key"), (("reihe", "integer", 9, 0, 100, ["4", "401"]), "attribute"),
    (("menge", "integer", 9, 0, 100, ["4"]), "measure"), (("x", "numeric", 9, 0, 100), "measure"),
    (("month", "numeric", 9, 0, 100), "measure"), (("name", "text", 9, 0, 100), "attribute"),
])
def test_roles(args, want):
    assert detect_role(*args) == want


def test_profile_counts_null_as_a_value(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, None, 2.5), (3, "a", None)], "k bigint, t string, v double")
    for approx in (False, True):
        profile, n = profile_columns(df, approx=approx)
        assert n == 3
        assert [(p.column_name, p.data_type, p.unique_count, p.null_count) for p in profile] == [
            ("k", "integer", 3, 0), ("t", "text", 2, 1), ("v", "numeric", 3, 1)]
    assert is_fact(profile) and default_fact({"_calendar": profile, "f": profile}) == "f"
    assert "WindowGroupLimit" in column_facts(df)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("values, want", [
    (["ja", "NEIN", "1"], "boolean"), (["2024-01", "2024-02", "x", "2024-03", "2024-04", "2024-05"], "date"),
    (["1.234,56", "€ 12,50"], "numeric"), (["€ 12", "13"], "integer"), (["a", "1"], "text"),
])
def test_profile_of_texts(spark, values, want):
    assert profile_columns(texts(spark, c=values))[0][0].data_type == want


def test_measure_statistics_skip_empty_measures(spark):
    df = spark.createDataFrame([(1.005, "2", None), (2.0, "x", None)], "a double, b string, c double")
    assert rows(measure_stats(df, ["a", "b", "c"])) == [("a", 1.01, 2.0, 3.01), ("b", 2.0, 2.0, 2.0)]


def test_written_table_is_typed_counted_and_numbered(spark, tmp_path):
    df = spark.createDataFrame([("1", "2.50", "2024-01"), ("x", "3", "2024-02")], "k string, v string, period string")
    path = str(tmp_path / "t")
    assert write_typed(df, {"k": "integer", "v": "numeric"}, path, partition_by="period") == 2
    back = spark.read.parquet(path)
    assert dict(back.dtypes)["v"] == "decimal(18,4)" and back.select("_row_id").distinct().count() == 2
    assert rows(back.select("k", F.col("v").cast("string"))) == [(1, "2.5000"), (None, "3.0000")]
    assert write_table(back, str(tmp_path / "u"), mode="append") == 2 == write_table(back, str(tmp_path / "u"), mode="append")


def test_line_breaks_inside_quotes(spark, tmp_path):
    path = tmp_path / "q.csv"
    path.write_text('a,b\n1,"x\ny"\n')
    assert rows(read_delimited(spark, str(path), multi_line=True)) == [("1", "x\ny")]


def test_export_is_fit_for_json(spark):
    df = spark.sql("SELECT date'2024-01-05' d, timestamp_ntz'2024-01-05 06:07:08.5' t, double('nan') n, 1.50BD m, 'x' s")
    assert rows(export_rows(df)) == [("2024-01-05", "2024-01-05T06:07:08.500000", None, 1.5, "x")]
