"""Tables with versions: a new version rewrites only the partitions that change, and a reader sees the old one until it is complete.

A table is a folder with ``data/_w=<writer>/...`` (Parquet, partitioned or not) and ``log/<number>.json``. A log entry names the folders of every
partition and the columns, so a version is complete the moment its entry appears under the next number. Entries are
written aside and renamed; a number that another writer took first is never overwritten.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.values import column, resolve

WHOLE = ""  # the only partition of a table without partitions


class VersionConflict(RuntimeError):
    """Another writer completed the next version first."""


@dataclass(frozen=True)
class Version:
    """One state of a table: ``columns`` maps the names shown to the names stored, in order; ``folders`` the partitions to their writers' folders."""

    number: int
    schema: str
    columns: dict[str, str]
    folders: dict[str, list[str]]
    partition_by: str | None = None


class FileLog:
    """Small files that are published once under a name, on whatever store the path names."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm = spark._jvm
        self.conf = spark._jsc.hadoopConfiguration()

    def path(self, *parts: str):
        return self.jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def names(self, folder: str) -> list[str]:
        place = self.path(folder)
        system = place.getFileSystem(self.conf)
        return sorted(s.getPath().getName() for s in system.listStatus(place)) if system.exists(place) else []

    def read(self, *parts: str) -> str:
        place = self.path(*parts)
        stream = place.getFileSystem(self.conf).open(place)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, text: str, folder: str, name: str) -> bool:
        """Write a file aside and rename it to its name; false where that name is taken."""
        aside, final = self.path(folder, f".{name}-{uuid.uuid4().hex}"), self.path(folder, name)
        system = final.getFileSystem(self.conf)
        stream = system.create(aside, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        if not system.exists(final):
            try:
                self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.conf).rename(
                    aside, final, self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0))
                return True
            except Exception as problem:  # noqa: BLE001  the gateway wraps the store's own errors
                if "FileAlreadyExists" not in str(problem):
                    raise
        system.delete(aside, False)
        return False

    def delete(self, *parts: str) -> None:
        place = self.path(*parts)
        place.getFileSystem(self.conf).delete(place, True)


class VersionedTable:
    """A table under ``path``; ``partition_by`` names the column whose values are stored apart (a period, say)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.files = spark, FileLog(spark, path)

    @classmethod
    def create(cls, df: DataFrame, path: str, partition_by: str | None = None) -> VersionedTable:
        """Store a frame as version 1 of a new table. A table that exists already raises."""
        table = cls(df.sparkSession, path)
        if table.numbers():
            raise VersionConflict(f"{path} has versions already")
        by = resolve(df, partition_by) if partition_by else None
        stored = {name: f"c{i}" for i, name in enumerate(df.columns)}
        folders = table._write(df.select(*[column(n).alias(s) for n, s in stored.items()]), stored.get(by))
        table._publish(Version(1, _ddl(df.schema, stored), stored, folders, by))
        return table

    def numbers(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self.files.names("log") if n.endswith(".json") and not n.startswith("."))

    def version(self, number: int | None = None) -> Version:
        number = self.numbers()[-1] if number is None else number
        return Version(**json.loads(self.files.read("log", f"{number:010d}.json")))

    def read(self, number: int | None = None, partitions: Sequence[str] | None = None) -> DataFrame:
        """The rows of a version (the last one if none is named), or of some of its partitions."""
        return self._rows(self.version(number), partitions)

    def _rows(self, version: Version, partitions: Sequence[str] | None = None) -> DataFrame:
        schema = T.StructType.fromDDL(version.schema) if version.schema else T.StructType()
        wanted = version.folders if partitions is None else {p: version.folders[p] for p in partitions}
        paths = [f"{self.files.root}/data/{f}" for folders in wanted.values() for f in folders]
        shown = [column(s).alias(n) for n, s in version.columns.items()]
        if not paths:
            return self.spark.createDataFrame([], schema).select(*shown)
        # A column that a folder was written without is read as NULL, so adding one rewrites nothing by itself.
        return self.spark.read.schema(schema).option("basePath", f"{self.files.root}/data").parquet(*paths).select(*shown)

    def _write(self, stored: DataFrame, by: str | None) -> dict[str, list[str]]:
        """Write rows to a folder of their own; the partitions it holds, with their folders."""
        writer = f"_w={uuid.uuid4().hex}"
        if by:
            stored.hint("rebalance", by).write.partitionBy(by).parquet(f"{self.files.root}/data/{writer}")
        else:
            stored.write.parquet(f"{self.files.root}/data/{writer}")
            return {WHOLE: [writer]}
        return {n: [f"{writer}/{n}"] for n in self.files.names(f"data/{writer}") if n.startswith(f"{by}=")}

    def _publish(self, version: Version) -> Version:
        if not self.files.publish(json.dumps(asdict(version)), "log", f"{version.number:010d}.json"):
            raise VersionConflict(f"version {version.number} was completed by another writer")
        return version

    def _next(self, version: Version, **changes) -> Version:
        return Version(**{**asdict(version), **changes, "number": version.number + 1})

    def append(self, df: DataFrame) -> Version:
        """Add rows with the columns of the last version; columns the frame lacks are NULL. Tried again where another writer was first."""
        known = {n.lower(): n for n in df.columns}
        while True:
            version = self.version()
            types = {f.name: f.dataType for f in T.StructType.fromDDL(version.schema).fields}
            cells = [(column(known[n.lower()]) if n.lower() in known else F.lit(None)).cast(types[s]).alias(s) for n, s in version.columns.items()]
            by = version.columns.get(version.partition_by) if version.partition_by else None
            new = self._write(df.select(*cells), by)
            while True:
                folders = {p: [*version.folders.get(p, []), *new.get(p, [])] for p in {**version.folders, **new}}
                try:
                    return self._publish(self._next(version, folders=folders))
                except VersionConflict:
                    latest = self.version()
                    if (latest.schema, latest.columns) != (version.schema, version.columns):
                        break  # the columns changed meanwhile: write the rows in their new shape
                    version = latest  # only folders changed: what was written stays good

    def rename(self, old: str, new: str) -> Version:
        """A new version whose column has another name: an entry in the log, no rows are written."""
        version = self.version()
        found = next((n for n in version.columns if n.lower() == old.lower()), None)
        if found is None or any(n.lower() == new.lower() for n in version.columns if n != found):
            raise ValueError(f"cannot rename {old!r} to {new!r}: columns are {list(version.columns)}")
        names = {(new if n == found else n): s for n, s in version.columns.items()}
        by = new if version.partition_by == found else version.partition_by
        return self._publish(self._next(version, columns=names, partition_by=by))

    def update(self, change, outputs: Sequence[str]) -> Update:
        """A new version in which ``change`` (rows to rows, by column expressions alone) has set the ``outputs`` columns.

        Only partitions in which a value differs are written again, and a column that is new and NULL throughout a partition
        changes nothing there. The comparison reads the columns that ``change`` needs; the partitions to be written are read whole.
        """
        version = self.version()
        rows = self._rows(version)
        after = change(rows)
        if version.partition_by in outputs:
            raise ValueError(f"{version.partition_by!r} says where rows are stored and cannot be set in place")
        kinds = {o: after.schema[o].dataType for o in outputs}
        before = {o: column(o).cast(kinds[o]) if o in rows.columns and rows.schema[o].dataType == kinds[o] else None for o in outputs}
        retyped = [o for o in outputs if o in rows.columns and before[o] is None]
        old = [(before[o] if before[o] is not None else F.lit(None).cast(kinds[o])).alias(f"_old_{o}") for o in outputs]
        place = column(version.partition_by) if version.partition_by else F.lit(None).cast("string")
        told = change(rows.select("*", *old)).select(place.alias("_place"), F.lit(True) if retyped else _differs(outputs))
        counts = told.toDF("_place", "_new").groupBy("_place").agg(F.count(F.lit(1)).alias("n"), F.count_if("_new").alias("moved")).collect()
        total, moved = sum(r["n"] for r in counts), sum(r["moved"] for r in counts)

        stored = dict(version.columns)
        for o in outputs:
            if o not in stored or o in retyped:
                stored[o] = f"c{1 + max([int(s[1:]) for s in (*version.columns.values(), *stored.values())])}"
        schema = _ddl(T.StructType([T.StructField(n, kinds[n] if n in kinds else rows.schema[n].dataType) for n in stored]), stored)
        if not moved:
            return Update(self._publish(self._next(version, schema=schema, columns=stored)), total, 0, [])
        by = version.columns.get(version.partition_by) if version.partition_by else None
        touched = [r["_place"] for r in counts if r["moved"]]
        some = rows.filter(place.isin([t for t in touched if t is not None]) | (place.isNull() if None in touched else F.lit(False))) if by else rows
        new = self._write(change(some).select(*[column(n).alias(s) for n, s in stored.items()]), by)
        folders = {**version.folders, **new}
        return Update(self._publish(self._next(version, schema=schema, columns=stored, folders=folders)), total, moved, sorted(new))

    def replace(self, version: Version, partitions: Sequence[str], df: DataFrame) -> Version:
        """The version after ``version`` in which these partitions (by folder name) hold the rows of ``df`` and no others. Raises
        where another writer completed that version first, since the rows were made from an older state."""
        by = version.columns[version.partition_by]
        new = self._write(df.select(*[column(n).alias(s) for n, s in version.columns.items()]), by)
        if not set(new) <= set(partitions):
            raise ValueError(f"rows of other partitions: {sorted(set(new) - set(partitions))}")
        kept = {p: f for p, f in version.folders.items() if p not in partitions}
        return self._publish(self._next(version, folders={**kept, **new}))

    def vacuum(self, keep: int = 2) -> list[str]:
        """Delete versions but the last ``keep``, and writers' folders that none of those reads; not while others write."""
        numbers = self.numbers()
        for n in numbers[:-keep]:
            self.files.delete("log", f"{n:010d}.json")
        used = {f.split("/")[0] for n in numbers[-keep:] for folders in self.version(n).folders.values() for f in folders}
        gone = [n for n in self.files.names("data") if n.startswith("_w=") and n not in used]
        for n in gone:
            self.files.delete("data", n)
        return gone


@dataclass(frozen=True)
class Update:
    """What an update did: the version it made, the rows it covered, the rows whose values moved, the partitions written."""

    version: Version
    rows: int
    moved: int
    partitions: list[str]


def _differs(outputs: Sequence[str]):
    tests = [~column(o).eqNullSafe(column(f"_old_{o}")) for o in outputs]
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def _ddl(schema: T.StructType, stored: dict[str, str]) -> str:
    """Types by stored names."""
    return ", ".join(f"{stored[f.name]} {f.dataType.simpleString()}" for f in schema.fields if f.name in stored)
