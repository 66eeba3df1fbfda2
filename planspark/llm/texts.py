"""Whole texts as byte arrays: words, hashes and lines of many documents at once, without Python strings.

All functions take the bytes of a run of documents as one array and the document bounds as offsets, the way Arrow
holds a text column. A null text has no bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession, functions as F

CHUNK_BYTES = 1_000_000

_SPACES = np.zeros(256, bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BYTE_CODES = np.random.default_rng(20_240_607).integers(1, 2**63, 256, dtype=np.uint64)


def fold_column(doc_id: Column, folds: int) -> Column:
    """The fold of a document: crc32 of its id as text, modulo ``folds``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def byte_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, bounds, data = column.buffers()
    if len(column) == 0 or data is None:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(bounds, kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]], offsets - offsets[0]


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows with at most ``limit`` bytes of text, or a single longer row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = byte_column(batch.column(text))
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
            yield batch.slice(first, last - first)
            first = last


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Hashes of any byte range of one array, from prefix sums of a polynomial modulo 2**64."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.inverse = _powers(pow(int(_BASE), -1, 2**64), n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE_CODES[data] * _powers(int(_BASE), n + 1)[:n], out=self.sums[1:])

    def unmixed(self, size: int) -> np.ndarray:
        """All ranges of ``size`` bytes as polynomials, of which the higher bits are scrambled well."""
        number = len(self.sums) - size
        return (self.sums[size:] - self.sums[:number]) * self.inverse[:number]

    def ranges(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64))


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64; kept for runs of the usual length."""
    kept = _POWERS.get(base)
    if kept is None or len(kept) < n:
        out = np.full(n, base, np.uint64)
        out[0] = 1
        np.multiply.accumulate(out, out=out)
        if n <= 2 * CHUNK_BYTES:
            _POWERS[base] = out
        return out
    return kept[:n]


def runs(blank: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the longest runs without blanks inside one document, and their number per document."""
    if not len(blank):
        none = np.empty(0, np.int64)
        return none, none, np.zeros(len(offsets) - 1, np.int64)
    before, after = np.empty(len(blank), bool), np.empty(len(blank), bool)
    before[0], before[1:] = True, blank[:-1]
    before[offsets[:-1][offsets[:-1] < len(blank)]] = True
    after[-1], after[:-1] = True, blank[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = True
    starts = np.flatnonzero(~blank & before)
    ends = np.flatnonzero(~blank & after) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` and the number of words of every document."""
    return runs(_SPACES[data], offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, A-Z lower-cased, and the number of words of every document."""
    starts, ends, counts = words(data, offsets)
    return Rolling(LOWER[data]).ranges(starts, ends), counts


def shingles(hashes: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed word n-grams, ascending within every document, and their number per document.

    A document with fewer words than ``width`` has its whole sequence as the only shingle; one without words has none.
    """
    docs = len(counts)
    bounds = np.concatenate(([0], np.cumsum(counts)))
    total = len(hashes)
    sums = np.zeros(total, np.uint64)
    for k in range(width):
        shifted = np.zeros(total, np.uint64)
        shifted[:max(total - k, 0)] = hashes[k:]
        sums = sums * np.uint64(0x100000001B3) + mixed(shifted + np.uint64(k + 1))
    owner = np.repeat(np.arange(docs), counts)
    whole = np.arange(total) + width <= bounds[1:][owner]
    owners, values = owner[whole], mixed(sums[whole])
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        extra = mixed(counts[short].astype(np.uint64))
        for k in range(int(counts[short].max())):
            more = counts[short] > k
            extra[more] = mixed(extra[more] * np.uint64(0x100000001B3) + hashes[bounds[:-1][short[more]] + k])
        owners, values = np.concatenate((owners, short)), np.concatenate((values, extra))
    order = np.lexsort((values, owners)) if len(short) else None
    if order is not None:
        owners, values = owners[order], values[order]
    return _distinct(owners, values, docs)


def _distinct(owners: np.ndarray, values: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    bounds = np.searchsorted(owners, np.arange(docs + 1))
    parts = [np.unique(values[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
    return (np.concatenate(parts) if parts else np.empty(0, np.uint64)), np.array([len(p) for p in parts], np.int64)


@contextmanager
def small_batches(spark: SparkSession, rows: int):
    """Arrow batches of at most ``rows`` rows for the jobs that run inside; the setting is put back afterwards."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def ragged(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    """A list column from consecutive runs of values."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(values))
