"""Benchmark decontamination: pieces of test items found exactly, verified by bit-parallel edit distance."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

BLOCK_CHARS = 4_000_000
ERROR_RATE = 0.05

_GAPS = re.compile(r"[\W_]+")


def normal(text: str | None) -> str:
    """Lower case, every run of other characters than letters and digits one space, a space at both ends."""
    inner = _GAPS.sub(" ", (text or "").lower()).strip()
    return f" {inner} " if inner else ""


def budget(length: int, rate: float = ERROR_RATE) -> int:
    return int(length * rate)


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """The item in ``errors + 1`` pieces (offset, text): an occurrence with at most that many edits keeps one of them whole."""
    parts = min(errors + 1, len(item))
    cuts = [len(item) * i // parts for i in range(parts + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


class Pattern:
    """Myers' bit vectors of one item: the least edit distance to any substring of a text."""

    def __init__(self, item: str):
        self.length, self.masks = len(item), {}
        for i, c in enumerate(item):
            self.masks[c] = self.masks.get(c, 0) | 1 << i

    def distance(self, text: str) -> int:
        full, high = (1 << self.length) - 1, 1 << (self.length - 1)
        plus, minus, score, get = full, 0, self.length, self.masks.get
        best = score
        for c in text:
            equal = get(c, 0)
            vertical = equal | minus
            horizontal = (((equal & plus) + plus) ^ plus) | equal
            up, down = minus | (full & ~(horizontal | plus)), plus & horizontal
            if up & high:
                score += 1
            elif down & high:
                score -= 1
                if score < best:
                    best = score
            up, down = (up << 1) & full, (down << 1) & full
            plus, minus = down | (full & ~(vertical | up)), up & vertical
        return best


class Finder:
    """Finds the items of one block in texts, each within its own error budget."""

    def __init__(self, items: list[tuple[int, str]], rate: float = ERROR_RATE):
        self.items = [(k, t) for k, t in ((k, normal(t)) for k, t in items) if t]
        self.errors = [budget(len(t), rate) for _, t in self.items]
        self.patterns: dict[int, Pattern] = {}
        places: dict[str, list[tuple[int, int]]] = {}
        for i, (_, item) in enumerate(self.items):
            for at, piece in pieces(item, self.errors[i]):
                places.setdefault(piece, []).append((i, at))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        if places:
            self.automaton.make_automaton()

    def __call__(self, text: str) -> list[tuple[int, int]]:
        """(item index, least distance) of the items found in a normalised text."""
        if not self.items or not text:
            return []
        starts: dict[int, set[int]] = {}
        for end, (size, where) in self.automaton.iter(text):
            for i, at in where:
                starts.setdefault(i, set()).add(end + 1 - size - at)
        found = []
        for i, begins in starts.items():
            item, errors = self.items[i][1], self.errors[i]
            if item in text:
                found.append((i, 0))
                continue
            pattern = self.patterns.setdefault(i, Pattern(item))
            best = min(pattern.distance(text[a:b]) for a, b in _windows(sorted(begins), len(item), errors, len(text)))
            if best <= errors:
                found.append((i, best))
        return found


def _windows(begins: list[int], size: int, errors: int, end: int) -> Iterator[tuple[int, int]]:
    """Text ranges that hold every occurrence with a piece at one of the begins; overlapping ones are joined."""
    first, last = max(0, begins[0] - errors), begins[0] + size + errors
    for b in begins[1:]:
        if b - errors > last:
            yield first, min(last, end)
            first = max(0, b - errors)
        last = b + size + errors
    yield first, min(last, end)


def item_blocks(benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of at most about ``block_chars`` characters; one block at a time is on the driver."""
    listed = benchmark.select("item_id", "text").filter("text IS NOT NULL")
    chars = listed.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-int(chars) // block_chars))
    for block in range(blocks):
        own = listed.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        yield [(r.item_id, r.text) for r in own.orderBy("item_id", "text").collect()]


def contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """All (document, item) pairs where the document holds the item: ``doc_id, item_id, distance, errors``.

    Texts are compared in the form of ``normal``; an item is held where some passage is within ``rate`` of the item's
    length in edits, ``distance`` being the least. Items enter the tasks in blocks of at most about ``block_chars``
    characters, each block a pass over the documents, so nothing grows with the benchmark. Null and empty texts hold
    nothing; items without letters or digits are never held; repeated rows give repeated pairs; rows with null ids count.
    """
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id long, distance int, errors int"
    found = None
    for items in item_blocks(benchmark, block_chars):
        pairs = docs.select("doc_id", "text").filter("text IS NOT NULL").mapInArrow(_search(items, rate), schema)
        found = pairs if found is None else found.unionByName(pairs)
    return found


def _search(items: list[tuple[int, str]], rate: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(items, rate)
        for batch in batches:
            ids, rows, named, near, errors = batch.column(0), [], [], [], []
            for row, text in enumerate(batch.column(1)):
                for i, distance in finder(normal(text.as_py())):
                    rows.append(row)
                    named.append(finder.items[i][0])
                    near.append(distance)
                    errors.append(finder.errors[i])
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(rows, pa.int64())), pa.array(named, pa.int64()), pa.array(near, pa.int32()), pa.array(errors, pa.int32())],
                    ["doc_id", "item_id", "distance", "errors"])
    return run


def keep_clean(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns."""
    def filtered(items: list[tuple[int, str]]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            finder = Finder(items, rate)
            for batch in batches:
                clean = pa.array([not finder(normal(t.as_py())) for t in batch.column("text")], pa.bool_())
                yield batch.filter(clean)
        return run

    for items in item_blocks(benchmark, block_chars):
        docs = docs.mapInArrow(filtered(items), docs.schema)
    return docs
