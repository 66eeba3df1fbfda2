"""Shared storage for intermediate results: who stored them, and when they go."""

from __future__ import annotations

import uuid
import warnings
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

from pyspark.sql import Column, DataFrame, Observation, SparkSession, types as T

_SCOPES: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where that is unset, one inside the session's warehouse."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_intermediate"
        if folder.startswith(("file:", "/")) and not context.master.startswith("local"):
            warnings.warn(f"spark.checkpoint.dir is not set: {folder} must be a folder that all executors share", stacklevel=2)
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A path of its own for a table to store; inside a ``scope`` the scope owns it."""
    path = f"{shared_folder(spark)}/planspark/{label}-{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    return path


def _storable(kind: T.DataType) -> bool:
    """Whether Parquet takes a column of this type as it is."""
    if isinstance(kind, T.StructType):
        names = [f.name.lower() for f in kind.fields]
        return bool(names) and len(set(names)) == len(names) and all(_storable(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _storable(kind.elementType)
    if isinstance(kind, T.MapType):
        return _storable(kind.keyType) and _storable(kind.valueType)
    return not isinstance(kind, (T.NullType, T.CalendarIntervalType, T.UserDefinedType))


def settle(df: DataFrame) -> DataFrame:
    """Compute once and keep the result as Parquet in shared storage: later steps read it and survive lost executors.

    What is read back starts a plan of its own, with the size of its files; a checkpoint would carry the estimate of the
    plan that made it, and a loop of joins multiplies such estimates round after round. Types that Parquet does not take
    (nothing but nulls, calendar intervals, structs with equal names) are checkpointed after all.
    """
    spark = df.sparkSession
    shared_folder(spark)
    if not df.columns or not all(_storable(f.dataType) for f in df.schema.fields):
        return df.checkpoint(eager=True)
    plain = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(df.schema.fields)])
    path = new_path(spark, "rows")
    df.toDF(*plain.names).write.parquet(path)
    return spark.read.schema(plain).parquet(path).toDF(*df.columns)


def settle_with(df: DataFrame, *totals: Column) -> tuple[DataFrame, list]:
    """``settle``, and aggregates over the rows that the same job works out while it stores them: a loop needs no second query.

    A table without rows is counted apart, as no task then reports anything.
    """
    seen = Observation()
    named = [t.alias(f"t{i}") for i, t in enumerate(totals)]
    kept = settle(df.observe(seen, *named))
    found = seen.get
    return kept, [found[f"t{i}"] for i in range(len(totals))] if len(found) == len(totals) else list(kept.agg(*named).first())


def discard(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table that nothing reads any more; only paths given by ``new_path`` are accepted."""
    if not path.startswith(f"{shared_folder(spark)}/planspark/"):
        raise ValueError(f"not an intermediate path: {path}")
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def _label(path: str) -> str:
    """The last part of an intermediate path, which is unique."""
    return path.rsplit("/", 1)[1]


def stored_under(df: DataFrame) -> set[str]:
    """The intermediate tables that a frame reads when it is computed, by their labels."""
    return {part for file in df.inputFiles() if "/planspark/" in file for part in file.rsplit("/planspark/", 1)[1].split("/")[:1]}


class Scope:
    """Owner of the tables stored while it is open."""

    def __init__(self, spark: SparkSession, paths: list[str]):
        self.spark, self.paths, self.kept = spark, paths, set()

    def keep(self, df: DataFrame) -> DataFrame:
        """The frame, whose tables stay when the scope ends."""
        self.kept |= stored_under(df)
        return df

    def drop_all_but(self, *frames: DataFrame) -> None:
        """Delete now what was stored so far and what none of the frames reads: for the rounds of a loop."""
        wanted = self.kept.union(*map(stored_under, frames))
        for path in [p for p in self.paths if _label(p) not in wanted]:
            discard(self.spark, path)
            self.paths.remove(path)


@contextmanager
def scope(spark: SparkSession) -> Iterator[Scope]:
    """Tables stored inside are deleted at the end, but for those that a frame given to ``keep`` reads.

    What is kept passes to the scope around this one, if there is one.
    """
    owner = Scope(spark, [])
    _SCOPES.append(owner.paths)
    try:
        yield owner
    finally:
        _SCOPES.pop()
        for path in owner.paths:
            if _label(path) not in owner.kept:
                discard(spark, path)
            elif _SCOPES:
                _SCOPES[-1].append(path)


def tidy(build: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """An operator that leaves in storage only what its result reads."""
    @wraps(build)
    def run(*args, **kwargs):
        spark = SparkSession.active()
        with scope(spark) as owner:
            return owner.keep(build(*args, **kwargs))
    return run
