"""Language identification by cross-parsing: the language whose labelled text needs the fewest phrases wins.

Labelled text of every language becomes a suffix automaton, which follows any substring of it. A text is parsed from left
to right into the longest phrases that occur in the language's text. Symbols are the UTF-8 bytes of the case-folded
letters, so letters of all scripts count. Texts are parsed side by side, one symbol of every segment at a time.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .texts import byte_column, chunks, fold_column

SAMPLE_DOCS = 64
SYMBOLS = 20_000
SEGMENT = 512
WINDOW = 256  # symbols at most of a piece taken from a long text
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _folded() -> np.ndarray:
    """Code point of every code point's case-folded letter, 0 where it is no letter."""
    table = np.zeros(0x110000, np.uint32)
    for code in range(0x110000):
        c = chr(code)
        if c.isalpha():
            table[code] = ord(c.lower()[0])
    return table


def letters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of the documents' folded letters with runs of others than letters as one 0, and the new offsets."""
    codes = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    found = _folded()[codes]
    heads = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    bounds = heads[offsets]
    before = np.zeros(len(found), np.uint32)
    before[1:] = found[:-1]
    before[bounds[:-1][bounds[:-1] < len(found)]] = 0
    kept = (found != 0) | (before != 0)
    bounds = np.concatenate(([0], np.cumsum(kept)))[bounds]
    found = found[kept]
    width = 1 + (found >= 0x80).astype(np.int64) + (found >= 0x800) + (found >= 0x10000)
    raw = np.frombuffer(found.astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)
    return raw, np.concatenate(([0], np.cumsum(width)))[bounds]


def symbols(data: np.ndarray, offsets: np.ndarray, alphabet: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of the documents' ``letters`` and their offsets: 0 no letter, 1 a byte that is not in the alphabet, else its place."""
    table = np.ones(256, np.uint8)
    table[0] = 0
    table[list(alphabet)] = np.arange(len(alphabet)) + 2
    raw, bounds = letters(data, offsets)
    return table[raw], bounds


def automaton(text: bytes, letters: int) -> np.ndarray:
    """The suffix automaton of a symbol sequence: next state by (state, symbol), -1 where the substring ends."""
    follow: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for symbol in text:
        new = len(follow)
        follow.append({})
        length.append(length[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and symbol not in follow[at]:
            follow[at][symbol] = new
            at = link[at]
        if at >= 0:
            reached = follow[at][symbol]
            if length[reached] == length[at] + 1:
                link[new] = reached
            else:
                twin = len(follow)
                follow.append(dict(follow[reached]))
                length.append(length[at] + 1)
                link.append(link[reached])
                link[reached] = link[new] = twin
                while at >= 0 and follow[at].get(symbol) == reached:
                    follow[at][symbol] = twin
                    at = link[at]
        last = new
    table = np.full((len(follow), letters), -1, np.int32)
    for state, steps in enumerate(follow):
        for symbol, target in steps.items():
            table[state, symbol] = target
    return table


class Parser:
    """The automata of all languages in one table."""

    def __init__(self, alphabet: str | bytes, texts: Sequence[bytes]):
        self.letters = len(alphabet) + 2
        tables, shift, self.roots = [], 0, []
        for text in texts:
            table = automaton(text, self.letters)
            tables.append(np.where(table >= 0, table + shift, -1).astype(np.int32))
            self.roots.append(shift)
            shift += len(table)
        self.steps = np.concatenate(tables).ravel()
        # Where a new phrase begins with a symbol the language does not have, the parse stays at the root.
        root = np.array(self.roots, np.int32)
        first = self.steps.reshape(-1, self.letters)[root]
        self.first = np.where(first >= 0, first, root[:, None])

    def phrases(self, found: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Phrases per document and language; long texts are parsed in segments, whose phrases add up."""
        sizes = np.diff(bounds)
        pieces = -(-sizes // SEGMENT)
        owner = np.repeat(np.arange(len(sizes)), pieces)
        number = np.arange(len(owner)) - np.repeat(np.concatenate(([0], np.cumsum(pieces)[:-1])), pieces)
        start = bounds[owner] + number * SEGMENT
        size = np.minimum(SEGMENT, bounds[owner + 1] - start)
        order = np.argsort(-size, kind="stable")
        owner, start, size = owner[order], start[order], size[order]
        state = np.repeat(np.array(self.roots, np.int32)[:, None], len(owner), 1)
        count = np.ones((len(self.roots), len(owner)), np.int32)
        live = np.searchsorted(-size, -np.arange(1, SEGMENT + 1), "right")
        for j in range(int(size[0]) if len(size) else 0):
            n = live[j]
            symbol = found[start[:n] + j]
            moved = self.steps[state[:, :n] * self.letters + symbol]
            ended = moved < 0
            if j:
                count[:, :n] += ended
            state[:, :n] = np.where(ended, self.first[:, symbol], moved)
        out = np.zeros((len(self.roots), len(sizes)))
        for k in range(len(self.roots)):
            out[k] = np.bincount(owner, count[k], len(sizes))
        return out


@lru_cache(maxsize=2)
def _parser(alphabet: bytes, texts: tuple[bytes, ...]) -> Parser:
    return Parser(alphabet, texts)


def spread(text: bytes, size: int) -> bytes:
    """At most ``size`` symbols of a text: all of it, or windows spread over it by its hash, each closed by a 0."""
    if len(text) <= size:
        return text
    number = -(-size // WINDOW)
    width = size // number
    rng = np.random.default_rng(zlib.crc32(text))
    chosen = np.sort(rng.choice(len(text) // width, number, replace=False))
    slack = len(text) - len(text) // width * width
    shift = int(rng.integers(0, slack + 1))
    return b"\0".join(text[shift + c * width:shift + (c + 1) * width] for c in chosen)


def level(sizes: np.ndarray, total: int) -> int:
    """The least amount that, as the most taken of each size, gives ``total`` symbols, or the largest size."""
    ordered = np.sort(sizes)
    for i, size in enumerate(ordered):
        if size * (len(ordered) - i) >= total:
            return max(1, total // (len(ordered) - i))
        total -= size
    return int(ordered[-1])


def fit(docs: DataFrame, folds: int = 4, held_fold: int = 2, sample_docs: int = SAMPLE_DOCS, size: int = SYMBOLS) -> tuple[list[str], bytes, tuple[bytes, ...]]:
    """Languages, alphabet and labelled text of each, with about ``size`` symbols a language or all that it has.

    Of every language the documents whose hashed id comes first are taken, as many as hold ``size`` characters when each gives
    at most a ``sample_docs``-th part; where there are fewer, long texts give more. Texts count as a whole: what
    is taken of a long one is spread over it.
    """
    known = docs.filter("doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL")
    known = known.filter(fold_column(F.col("doc_id"), folds) != held_fold)
    # Steps of a logarithmic scale of the hash, finer towards those that come first.
    unit = F.shiftrightunsigned(F.xxhash64("doc_id"), 11).cast("double") + 1
    step = F.floor(F.log2(unit) * 8).cast("long")
    amounts = (known.select("lang", step.alias("step"), F.least(F.length("text"), F.lit(max(1, size // sample_docs))).alias("n"))
               .filter("n > 0").groupBy("lang", "step").agg(F.sum("n").alias("n")).collect())
    last: dict[str, int] = {}
    held: dict[str, int] = {}
    for row in sorted(amounts, key=lambda r: r.step):
        if held.get(row.lang, 0) < size:
            last[row.lang], held[row.lang] = row.step, held.get(row.lang, 0) + row.n
    if not last:
        return [], b"", ()

    def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            raw, bounds = letters(*byte_column(batch.column(1)))
            parts = [spread(raw[a:b].tobytes(), size) for a, b in zip(bounds, bounds[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(parts, pa.binary())], ["own", "text"])

    ends = docs.sparkSession.createDataFrame(sorted(last.items()), "own string, last long")
    texts = (known.select("lang", "text", step.alias("step")).join(F.broadcast(ends), (F.col("lang") == F.col("own")) & (F.col("step") <= F.col("last")))
             .select("own", "text").mapInArrow(taken, "own string, text binary").toArrow().to_pylist())  # a few hundred short or fewer long ones a language
    found: dict[str, list[bytes]] = {}
    for row in texts:
        found.setdefault(row["own"], []).append(row["text"])
    languages = sorted(found)
    # Valid UTF-8 has fewer than 250 different bytes, so all of them are symbols.
    alphabet = bytes(sorted({b for parts in found.values() for t in parts for b in set(t)} - {0}))
    place = np.zeros(256, np.uint8)
    place[list(alphabet)] = np.arange(len(alphabet)) + 2
    out = []
    for language in languages:
        parts = sorted(found[language])
        share = level(np.array([len(t) for t in parts]), size)
        text = b"\0".join(spread(t, share) for t in parts) + b"\0"
        out.append(place[np.frombuffer(text, np.uint8)].tobytes())
    return languages, alphabet, tuple(out)


def identify(docs: DataFrame, folds: int = 4, held_fold: int = 2, sample_docs: int = SAMPLE_DOCS, size: int = SYMBOLS) -> DataFrame:
    """The language of every document: ``doc_id, held_out, lang_pred, score``.

    The language with the fewest phrases wins, each multiplied by the logarithm of the size of the language's labelled text, since
    phrases grow that much longer with it; the first by name in a tie. ``score`` is the share by which the runner-up needs more (0 in a tie, 1 with a single language). Texts that are null or have no letter are ``und``
    with score 0, as are all where nothing was learnt. Whole texts are parsed; long ones in segments of 512 symbols. Repeated
    rows are judged alike; languages of the held-out fold and of null ids are never learnt.
    """
    languages, alphabet, texts = fit(docs, folds, held_fold, sample_docs, size)
    worth = np.log(np.array([len(t) + 2.0 for t in texts]))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            data, offsets = byte_column(batch.column(1))
            found, bounds = symbols(data, offsets, alphabet)
            spoken = np.diff(np.concatenate(([0], np.cumsum(found != 0)))[bounds]) > 0
            names, scores = [UNKNOWN] * len(spoken), np.zeros(len(spoken))
            if languages:
                needed = _parser(alphabet, texts).phrases(found, bounds) * worth[:, None]
                best = needed.argmin(0)
                ranked = np.sort(needed, 0)
                scores = np.where(spoken, (ranked[1] - ranked[0]) / np.maximum(ranked[1], 1) if len(languages) > 1 else 1.0, 0.0)
                names = [languages[b] if s else UNKNOWN for b, s in zip(best, spoken)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    judged = docs.select("doc_id", "text").mapInArrow(run, schema)
    return judged.select("doc_id", F.coalesce(fold_column(F.col("doc_id"), folds) == held_fold, F.lit(False)).alias("held_out"), "lang_pred", "score")
