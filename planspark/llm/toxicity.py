"""Toxicity: a sparse linear classifier whose score must not change when identity terms are swapped.

The counterfactual of a labelled text replaces every identity term by another term of the same list. Training minimises
the logistic loss plus ``fairness`` times the squared change of the score between a text and its counterfactual, so that
naming a group by itself adds nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .sampling import labelled_sample
from .texts import LOWER, Rolling, byte_column, chunks, fold_column, mixed, runs

PER_CLASS = 5_000
BUCKETS = 1 << 20
ROUNDS = 300
OPENINGS, LEVELS = (5, 6), (1, 2, 3)

# Neutral names of groups, per language.
IDENTITY_TERMS = (
    "women men girls boys muslims christians jews hindus buddhists atheists immigrants refugees foreigners gays lesbians "
    "black white asian african american mexican arab turkish polish "
    "frauen männer mädchen jungen muslime christen juden einwanderer flüchtlinge ausländer schwule lesben schwarze weiße "
    "femmes hommes filles garçons musulmans chrétiens juifs immigrés réfugiés étrangers noirs blancs arabes "
    "mujeres hombres chicas chicos musulmanes cristianos judíos inmigrantes refugiados extranjeros negros blancos árabes"
).split()

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def term_buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of the distinct features of every document, ascending, and their number per document.

    Features are its words (runs of letters and digits, A-Z lower-cased) and, for inflected insults, the openings of its
    words of ``OPENINGS`` bytes, each once for every one of ``LEVELS`` that the number of occurrences reaches. Identity terms
    have no openings, so a swap of the word is a swap of all its features.
    """
    starts, ends, counts = runs(~_LETTER[data], offsets)
    owner = np.repeat(np.arange(len(counts)), counts)
    rolling = Rolling(LOWER[data])
    whole = _place(rolling.ranges(starts, ends), 0, 0)
    keys = [np.unique(owner * BUCKETS + whole)]
    plain = ~np.isin(whole, _identities())
    for size in OPENINGS:
        long = (ends - starts >= size) & plain
        opening = rolling.ranges(starts[long], starts[long] + size)
        order = np.lexsort((opening, owner[long]))
        who, what = owner[long][order], opening[order]
        new = np.ones(len(what), bool)
        new[1:] = (what[1:] != what[:-1]) | (who[1:] != who[:-1])
        heads = np.flatnonzero(new)
        number = np.diff(np.append(heads, len(what)))
        for level in LEVELS:
            reached = heads[number >= level]
            keys.append(who[reached] * BUCKETS + _place(what[reached], size, level))
    merged = np.unique(np.concatenate(keys))
    return (merged % BUCKETS).astype(np.int32), np.bincount(merged // BUCKETS, minlength=len(counts))


def _place(hashes: np.ndarray, size: int, level: int) -> np.ndarray:
    return (mixed(hashes + np.uint64(size * 16 + level)) % np.uint64(BUCKETS)).astype(np.int64)


@lru_cache(maxsize=1)
def _identities() -> np.ndarray:
    return np.array([_bucket(w) for w in IDENTITY_TERMS])


def _bucket(word: str) -> int:
    data = np.frombuffer(word.encode(), np.uint8)
    return int(_place(Rolling(LOWER[data]).ranges(np.array([0]), np.array([len(data)])), 0, 0)[0])


def swaps() -> dict[int, int]:
    """The bucket of every identity term and that of the term it is swapped for: the next one of the list."""
    found = _identities().tolist()
    return {a: b for a, b in zip(found, found[1:] + found[:1]) if a != b}


@dataclass
class ToxicModel:
    buckets: np.ndarray
    weights: np.ndarray
    bias: float

    def table(self) -> np.ndarray:
        out = np.zeros(BUCKETS)
        out[self.buckets] = self.weights
        return out


def _scores(table: np.ndarray, bias: float, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    terms, counts = term_buckets(data, offsets)
    sums = np.concatenate(([0.0], np.cumsum(table[terms])))[np.concatenate(([0], np.cumsum(counts)))]
    return 1 / (1 + np.exp(-np.clip(np.diff(sums) + bias, -500, 500)))


def train(terms: np.ndarray, counts: np.ndarray, labels: np.ndarray, fairness: float = 10.0, sparsity: float = 1e-3,
          least: int = 5, rounds: int = ROUNDS, prior: float = 0.2) -> ToxicModel:
    """Accelerated proximal gradient steps on the weighted loss; features of fewer than ``least`` texts get no weight.

    ``prior`` is what the texts of label 1 weigh in all, whatever number of them the sample has.
    """
    empty = ToxicModel(np.empty(0, np.int64), np.empty(0), 0.0)
    if len(set(labels)) < 2:
        return empty
    swap = swaps()
    # Every identity term has a column, seen or not: a text may be swapped into one that the sample lacks.
    used, column, seen = np.unique(np.concatenate((terms, list(swap))), return_inverse=True, return_counts=True)
    column = column[:len(terms)]
    wanted = (seen >= least) | np.isin(used, list(swap))
    place = np.cumsum(wanted) - 1
    row = np.repeat(np.arange(len(counts)), counts)
    known = wanted[column]
    row, column = row[known], place[column[known]]
    used, width, n = used[wanted], int(wanted.sum()), len(counts)
    if not width:
        return empty
    # Difference between a text and its counterfactual, as (row, column, change).
    other = {int(np.searchsorted(used, a)): int(np.searchsorted(used, b)) for a, b in swap.items()}
    named = np.isin(column, list(other))
    away = row[named], column[named], np.array([other[c] for c in column[named]], int)
    share = np.where(labels == 1, prior / (labels == 1).sum(), (1 - prior) / (labels == 0).sum())
    weights, bias, old, old_bias, momentum = np.zeros(width), 0.0, np.zeros(width), 0.0, 1.0
    step = 1.0 / _curvature(row, column, away, share, width, n, fairness)
    for _ in range(rounds):
        grown = (1 + np.sqrt(1 + 4 * momentum * momentum)) / 2
        ahead, ahead_bias = weights + (momentum - 1) / grown * (weights - old), bias + (momentum - 1) / grown * (bias - old_bias)
        odds = np.bincount(row, ahead[column], n) + ahead_bias
        error = (1 / (1 + np.exp(-np.clip(odds, -500, 500))) - labels) * share
        slope = np.bincount(column, error[row], width)
        if len(away[0]):
            change = np.bincount(away[0], ahead[away[1]] - ahead[away[2]], n) * 2 * fairness * share
            slope += np.bincount(away[1], change[away[0]], width) - np.bincount(away[2], change[away[0]], width)
        old, old_bias, momentum = weights, bias, grown
        moved = ahead - step * slope
        weights = np.sign(moved) * np.maximum(np.abs(moved) - step * sparsity, 0)
        bias = ahead_bias - step * error.sum()
    kept = np.abs(weights) > 0
    return ToxicModel(used[kept], weights[kept], float(bias))


def _curvature(row, column, away, share, width, n, fairness) -> float:
    """A bound of the loss's curvature: the largest eigenvalue of its quadratic part, by a few power steps."""
    v, b = np.random.default_rng(1).normal(size=width), 1.0
    value = 1.0
    for _ in range(20):
        z = 0.25 * (np.bincount(row, v[column], n) + b) * share
        y = 2 * fairness * np.bincount(away[0], v[away[1]] - v[away[2]], n) * share if len(away[0]) else np.zeros(n)
        v = np.bincount(column, z[row], width) + np.bincount(away[1], y[away[0]], width) - np.bincount(away[2], y[away[0]], width)
        b = z.sum()
        value = float(np.sqrt((v * v).sum() + b * b)) + 1e-12
        v, b = v / value, b / value
    return 1.3 * value


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, folds: int = 4, held_fold: int = 2, fairness: float = 10.0) -> ToxicModel:
    """Train on at most ``2 * per_class`` labelled documents outside the held-out fold."""
    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            found, counts = term_buckets(*byte_column(batch.column(1)))
            parts = np.split(found, np.cumsum(counts)[:-1])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([p.tobytes() for p in parts], pa.binary())], ["label", "terms"])

    sample = labelled_sample(docs, labels, "toxic", per_class, folds, held_fold)
    rows = sample.select("label", "text").mapInArrow(terms, "label int, terms binary").toArrow().to_pandas()
    rows = rows.sort_values(["label", "terms"], kind="stable")
    found = [np.frombuffer(bytes(x), np.int32) for x in rows["terms"]]
    merged = np.concatenate(found) if found else np.empty(0, np.int32)
    return train(merged.astype(np.int64), np.array([len(x) for x in found], int), rows["label"].to_numpy(dtype=int), fairness)


def score(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """``doc_id, score`` of every document."""
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.table()
        for batch in chunks(batches):
            found = _scores(table, model.bias, *byte_column(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, folds: int = 4, held_fold: int = 2,
             threshold: float = 0.3, fairness: float = 10.0) -> DataFrame:
    """A toxicity score for every document: ``doc_id, held_out, score, predicted``.

    Labels of the held-out fold are never learnt. Null and empty texts have no words and get the score of the intercept;
    repeated rows are scored alike; with one label only, or none, every score is 0.5. Only the text is read for a score.
    """
    found = score(docs, fit(docs, labels, per_class, folds, held_fold, fairness))
    return found.select(
        "doc_id", F.coalesce(fold_column(F.col("doc_id"), folds) == held_fold, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))
