"""Quoted line breaks read by many tasks against Spark's own reader, which takes a file as one task."""

import os
import random

import pytest

from pyspark.sql import Row

from planspark import read_delimited
from planspark.sources import quoted
from planspark.sources.quoted import read_quoted
from tests.conftest import rows


def written(path, records, sep=",", end="\n", header=("id", "note", "more")):
    def cell(x):
        return x if x is None or not any(c in x for c in f'{sep}"\n\r') else '"' + x.replace('"', '""') + '"'

    with open(path, "w", newline="") as out:
        for r in [header, *records]:
            out.write(sep.join("" if x is None else cell(x) for x in r) + end)


def one_task(spark, path, sep=","):
    return spark.read.csv(path, sep=sep, header=True, multiLine=True, escape='"')


@pytest.fixture
def small_blocks(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    for n in names:
        spark.conf.set(n, "400")
    yield
    for n, v in zip(names, before):
        spark.conf.set(n, v)


@pytest.mark.parametrize("seed,sep,end", [(1, ",", "\n"), (2, ";", "\r\n"), (3, "|", "\n"), (4, "\t", "\n")])
def test_many_tasks_read_the_same_rows(spark, small_blocks, tmp_path, seed, sep, end):
    rng = random.Random(seed)
    pieces = ["a", "b c", sep, '"', "\n", "\n\n", "plain text", 'say ""', "é", sep + "\n" + sep, "x" * 30]
    records = [(str(i), "".join(rng.choice(pieces) for _ in range(rng.randint(0, 6))) or None,
                rng.choice([None, "end", 'q"', "two\nlines"])) for i in range(300)]
    path = str(tmp_path / "t.csv")
    written(path, records, sep, end)
    got = read_quoted(spark, path, sep)
    assert spark.read.text(path).rdd.getNumPartitions() > 5 and got.columns == ["id", "note", "more"]
    assert rows(got) == rows(one_task(spark, path, sep))
    assert sorted(r.id for r in got.collect()) == sorted(r[0] for r in records)


def test_long_fields_span_blocks(spark, small_blocks, tmp_path):
    records = [("1", "\n".join(f"line {i}" for i in range(400)), "x"), ("2", "short", "y"), ("3", "\n" * 900, "z"), ("4", 'odd "quotes"\n' * 50, None)]
    path = str(tmp_path / "t.csv")
    written(path, records)
    assert rows(read_quoted(spark, path, ",")) == rows(one_task(spark, path)) == sorted(records, key=repr)


def test_several_files_and_a_quote_inside_a_field(spark, small_blocks, tmp_path):
    for k in range(3):
        written(str(tmp_path / f"f{k}.csv"), [(f"{k}{i}", "a\nb" if i % 2 else "c", "e") for i in range(40)])
    with open(tmp_path / "f0.csv", "a") as out:
        out.write('90,5" pipe,6"\n\n91,"x",y,surplus\n92\n')
    got = read_quoted(spark, str(tmp_path), ",")
    assert rows(got) == rows(one_task(spark, str(tmp_path)))
    assert {r.id: (r.note, r.more) for r in got.collect()}["90"] == ('5" pipe', '6"')


def test_reader_option_nulls_and_byte_order_mark(spark, tmp_path):
    path = str(tmp_path / "t.csv")
    with open(path, "w") as out:
        out.write('﻿id;note\n1;"a\nb"\n2;N/A\n')
    got = read_delimited(spark, path, multi_line=True)
    assert got.columns == ["id", "note"] and rows(got) == [("1", "a\nb"), ("2", None)]


def test_headers_without_rows_and_empty_files(spark, tmp_path):
    path = str(tmp_path / "t.csv")
    written(path, [])
    got = read_quoted(spark, path, ",")
    assert got.columns == ["id", "note", "more"] and got.count() == 0
    open(os.path.join(tmp_path, "e.csv"), "w").close()
    assert read_quoted(spark, str(tmp_path / "e.csv"), ",").columns == []


@pytest.mark.parametrize("size", [1, 7])
def test_lines_of_one_block_are_worked_out_in_chunks(spark, monkeypatch, tmp_path, size):
    """A block of any length is dealt to chunks of a few lines, so that no task holds a whole one; the first file by name gives the names."""
    monkeypatch.setattr(quoted, "CHUNK", size)
    given, tables = quoted.settle, []
    monkeypatch.setattr(quoted, "settle", lambda df: tables.append(given(df)) or tables[-1])
    records = [(f"{i}", "a\n\nb,c" * (i % 5), None if i % 3 else 'q"\n') for i in range(60)] + [("60", "\n".join(map(str, range(100))), "x")]
    for k, header in enumerate([("zid", "note", "more"), ("id", "note", "more")]):
        written(str(tmp_path / f"f{1 - k}.csv"), [(f"{k}-{r[0]}", r[1] or None, r[2]) for r in records], header=header)
    got = read_quoted(spark, str(tmp_path), ",")
    assert got.columns == ["id", "note", "more"]
    assert sorted(map(repr, got.collect())) == sorted(repr(Row(id=f"{k}-{r[0]}", note=r[1] or None, more=r[2])) for k in (0, 1) for r in records)
    assert tables[0].groupBy("file", "block", "chunk").count().agg({"count": "max"}).first()[0] <= size
