"""Delimited files whose quoted fields hold line breaks, read by many tasks.

Whether a line begins inside a quoted field depends on all lines before it. Each line maps the state before it (outside or
inside quotes) to the state after it: it keeps, swaps or fixes it. The state before a line thus follows from the last fixing
line and the swaps since, first inside each chunk of the file for both states it may begin in, then over the chunks, of
which there are few. A chunk is the lines of a block, ``CHUNK`` of them at most: what a task holds at once doesn't grow with the
blocks. Rows carry a hash of their file's path instead of the path.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .shared import settle


CHUNK = 1 << 15


def _open_after(line: Column, sep: str) -> Column:
    """Whether a quoted field is still open at the end of a line that begins outside quotes. A quote opens a field only at its beginning."""
    begin = rf"(^|{re.escape(sep)})"
    closed = F.regexp_replace(line, rf'{begin}"[^"]*+(?:""[^"]*+)*+"(?={re.escape(sep)}|$)', "$1")
    return F.contains(line, F.lit('"')) & closed.rlike(rf'{begin}"')


def _state(begin: Column) -> Column:
    """The state before a line or chunk: that of the last fixing one before it (else ``begin``), swapped as often as since then."""
    since = F.col("swaps") - F.coalesce(F.col("fixed.swaps"), F.lit(0))
    return F.coalesce(F.col("fixed.value"), begin) != (since % 2 == 1)


def read_quoted(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """All columns as text, names from the first file's header (each file has one). Fields are quoted by ``"``, doubled inside.

    Line breaks inside quotes are kept as line feeds. Lines between fields that are empty are passed over; missing fields are NULL,
    surplus ones are dropped. A quote that is never closed makes one record of the rest of its file.
    """
    raw = spark.read.option("lineSep", "\n").text(path)
    at = F.monotonically_increasing_id()
    lines = raw.select(
        F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), at.alias("at"),
        F.regexp_replace("value", r"\r$", "").alias("line"))
    # What a line does, in one column: 1 if a field is open after it when none was before, 2 more if one is when one was.
    does = _open_after(F.col("line"), sep).cast("int") + 2 * _open_after(F.concat(F.lit('"'), "line"), sep).cast("int")
    lines = lines.withColumns({"chunk": F.floor(F.col("at") / CHUNK), "does": does})
    f0, f1 = F.col("does").bitwiseAND(1) == 1, F.col("does").bitwiseAND(2) == 2
    swap, fix = (F.col("does") == 1).cast("int"), F.col("does").isin(0, 3)

    inside = Window.partitionBy("file", "block", "chunk").orderBy("at")
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.withColumn("swaps", F.coalesce(F.sum(swap).over(earlier), F.lit(0)))
    lines = lines.withColumn("fixed", F.last(F.when(fix, F.struct(f0.alias("value"), "swaps")), ignorenulls=True).over(earlier))
    # Both beginnings of the chunk are worked out, since the chunks before it are not known yet.
    for b in (0, 1):
        lines = lines.withColumn(f"s{b}", _state(F.lit(bool(b))))
        lines = lines.withColumn(f"n{b}", F.sum((~F.col(f"s{b}")).cast("int")).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    lines = settle(lines.select("file", "block", "chunk", "at", "line", "does", "s0", "s1", "n0", "n1"))

    def after(b: int) -> Column:
        return F.when(F.col(f"s{b}"), f1).otherwise(f0)

    chunks = settle(lines.groupBy("file", "block", "chunk").agg(
        *[F.max_by(after(b), "at").alias(f"e{b}") for b in (0, 1)], *[F.max(f"n{b}").alias(f"n{b}") for b in (0, 1)]))
    in_file = Window.partitionBy("file").orderBy("block", "chunk")  # one row per chunk of a file
    before = in_file.rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.withColumn("of", F.row_number().over(in_file) - 1)
    chunks = chunks.withColumns({"swap": (F.col("e0") & ~F.col("e1")).cast("int"), "fix": F.col("e0") == F.col("e1")})
    chunks = chunks.withColumn("swaps", F.coalesce(F.sum("swap").over(before), F.lit(0)))
    chunks = chunks.withColumn("fixed", F.last(F.when(F.col("fix"), F.struct(F.col("e0").alias("value"), "swaps")), ignorenulls=True).over(before))
    chunks = chunks.withColumn("begin", _state(F.lit(False)))
    chunks = chunks.withColumn("records", F.when(F.col("begin"), F.col("n1")).otherwise(F.col("n0")))
    # A line before the first record of its chunk belongs to the last record of an earlier chunk.
    chunks = chunks.withColumn("open", F.last(F.when(F.col("records") > 0, F.struct("of", "records")), ignorenulls=True).over(before))
    placed = lines.join(settle(chunks.select("file", "block", "chunk", "of", "begin", "open")), ["file", "block", "chunk"])
    pick = lambda a, b: F.when(F.col("begin"), F.col(b)).otherwise(F.col(a))
    placed = placed.withColumns({"state": pick("s0", "s1"), "number": pick("n0", "n1")})
    placed = placed.withColumn("ends", F.when(F.col("state"), f1).otherwise(f0)).select(
        "file", "at", "block", "line", (F.col("state") | F.col("ends")).alias("part"),
        F.when(F.col("number") > 0, F.col("of")).otherwise(F.col("open.of")).alias("of"),
        F.when(F.col("number") > 0, F.col("number")).otherwise(F.col("open.records")).alias("record"))
    single = placed.filter(~F.col("part")).select("file", "of", "record", "line")
    several = placed.filter("part").groupBy("file", "of", "record").agg(F.array_sort(F.collect_list(F.struct("block", "at", "line"))).alias("lines"))
    records = single.unionByName(several.select("file", "of", "record", F.array_join("lines.line", "\n").alias("line")))

    # The first file by its path; this lists files and reads none.
    first = spark.read.format("binaryFile").load(path).filter("length > 0").agg(F.min("_metadata.file_path")).first()[0]
    heads = (records.filter("of = 0 AND record = 1").orderBy(F.col("file") != F.xxhash64(F.lit(first)), "file").select("line").limit(1).collect())  # one header
    if not heads:
        return spark.createDataFrame([], "value string").select()
    options = {"sep": sep, "quote": '"', "escape": '"', "mode": "PERMISSIVE"}
    width = spark.range(1).select(F.schema_of_csv(F.lit(heads[0]["line"]), options)).first()[0].count(": ")
    shape = ", ".join(f"c{i} string" for i in range(width))
    head = spark.range(1).select(F.from_csv(F.lit(heads[0]["line"]), shape, options).alias("v")).first()["v"]
    names = [(n or f"_c{i}").lstrip("﻿") for i, n in enumerate(head)]
    body = records.filter("NOT (of = 0 AND record = 1)").filter(F.trim("line") != "")
    return body.select(F.from_csv("line", shape, options).alias("v")).select(*[F.col(f"v.c{i}").alias(n) for i, n in enumerate(names)])
