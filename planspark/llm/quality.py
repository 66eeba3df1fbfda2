"""Quality classifier: a linear-chain conditional random field labels every line, its marginals make the document's score.

The features of a line and of its two neighbours give its log-odds of being good, a 2 x 2 table the log-odds of
neighbouring labels. Forward-backward marginals, weighted by line length, are averaged over the document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .sampling import labelled_sample
from .texts import Rolling, byte_column, chunks, fold_column, runs, words

PER_CLASS = 2_500
CHAIN = 64  # lines of a training chain
EPOCHS = 150
SEED = 11

# Byte classes whose share of a line is a feature.
_CLASSES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t", b".", b",", b"!?", b"|", b"#$%&*+=<>{}[]\\/^~_@", b"-:;'\"()"]
_CLASS_OF = np.full(256, len(_CLASSES), np.uint8)
for _i, _chars in enumerate(_CLASSES):
    _CLASS_OF[list(_chars)] = _i
_CLASS_OF[128:] = len(_CLASSES) + 1
OWN = len(_CLASSES) + 2 + 6
WIDTH = 3 * OWN + 3


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features and byte lengths of all non-empty lines, and the number of those lines per document."""
    starts, ends, counts = runs(data == 10, offsets)
    own = np.zeros((len(starts), OWN))
    size = (ends - starts).astype(float)
    if len(starts):
        kinds = _CLASS_OF[data]
        for k in range(len(_CLASSES) + 2):
            sums = np.concatenate(([0], np.cumsum(kinds == k)))
            own[:, k] = (sums[ends] - sums[starts]) / size
        heads, tails, _ = words(data, offsets)
        number = (np.searchsorted(heads, ends) - np.searchsorted(heads, starts)).astype(float)
        rolling = Rolling(data)
        owner = np.repeat(np.arange(len(counts)), counts)
        k = len(_CLASSES) + 2
        own[:, k] = np.log1p(size) / 5
        own[:, k + 1] = np.log1p(number) / 5
        own[:, k + 2] = np.minimum(size / np.maximum(number, 1), 40) / 10
        own[:, k + 3] = _repeated(owner, rolling.ranges(starts, ends))
        own[:, k + 4] = np.isin(data[ends - 1], list(b".!?")).astype(float)
        own[:, k + 5] = _repeated_words(rolling.ranges(heads, tails), np.searchsorted(heads, starts), np.searchsorted(heads, ends))
    first = np.ones(len(starts), bool)
    last = np.ones(len(starts), bool)
    if len(starts):
        owner = np.repeat(np.arange(len(counts)), counts)
        first[1:] = owner[1:] != owner[:-1]
        last[:-1] = first[1:]
    out = np.zeros((len(starts), WIDTH))
    out[:, :OWN] = own
    out[1:, OWN:2 * OWN] = np.where(first[1:, None], 0, own[:-1])
    out[:-1, 2 * OWN:3 * OWN] = np.where(last[:-1, None], 0, own[1:])
    out[:, 3 * OWN], out[:, 3 * OWN + 1], out[:, 3 * OWN + 2] = first, last, 1
    return out, size, counts


def _repeated(owner: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """1 where the same document has the same line more than once."""
    order = np.lexsort((hashes, owner))
    same = (owner[order][1:] == owner[order][:-1]) & (hashes[order][1:] == hashes[order][:-1])
    twice = np.zeros(len(owner))
    twice[order[1:][same]] = 1
    twice[order[:-1][same]] = 1
    return twice


def _repeated_words(hashes: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Share of a line's words that occur earlier in the line."""
    number = last - first
    line = np.repeat(np.arange(len(first)), number)
    own = hashes[np.repeat(first - np.concatenate(([0], np.cumsum(number)[:-1])), number) + np.arange(number.sum())]
    order = np.lexsort((own, line))
    same = np.zeros(len(own), bool)
    same[1:] = (line[order][1:] == line[order][:-1]) & (own[order][1:] == own[order][:-1])
    return np.bincount(line[order][same], minlength=len(first)) / np.maximum(number, 1)


@dataclass
class LineField:
    """Weights of the features and log-potentials ``steps[previous label, label]``."""
    weights: np.ndarray
    steps: np.ndarray

    def marginals(self, features: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The probability of label 1 for every line, documents of similar length side by side."""
        odds = features @ self.weights
        out = np.empty(len(odds))
        bounds = np.concatenate(([0], np.cumsum(counts)))
        order = np.argsort(counts, kind="stable")
        order = order[counts[order] > 0]
        while len(order):
            longest = counts[order[-1]]
            take = max(1, int(np.sum(counts[order] * 2 > longest)))
            rows, order = order[-take:], order[:-take]
            grid = bounds[rows][:, None] + np.minimum(np.arange(longest), counts[rows][:, None] - 1)
            inside = np.arange(longest) < counts[rows][:, None]
            good, _, _ = _forward_backward(odds[grid], inside, self.steps)
            out[grid[inside]] = good[inside]
        return out


def _forward_backward(odds: np.ndarray, inside: np.ndarray, steps: np.ndarray):
    """Marginals of label 1, expected label pairs and log normalisers of padded chains."""
    n, longest = odds.shape
    ahead = np.zeros((longest, n, 2))
    behind = np.zeros((longest, n, 2))
    ahead[0, :, 1] = odds[:, 0]
    for t in range(1, longest):
        moved = np.logaddexp(ahead[t - 1, :, 0, None] + steps[0], ahead[t - 1, :, 1, None] + steps[1])
        moved[:, 1] += odds[:, t]
        ahead[t] = np.where(inside[:, t, None], moved, ahead[t - 1])
    for t in range(longest - 2, -1, -1):
        next_ = behind[t + 1].copy()
        next_[:, 1] += odds[:, t + 1]
        moved = np.logaddexp(next_[:, 0, None] + steps[:, 0], next_[:, 1, None] + steps[:, 1])
        behind[t] = np.where(inside[:, t + 1, None], moved, 0.0)
    total = np.logaddexp(ahead[-1, :, 0], ahead[-1, :, 1])
    both = ahead + behind
    good = (1 / (1 + np.exp(np.clip(both[..., 0] - both[..., 1], -500, 500)))).T
    pairs = np.zeros((2, 2))
    for t in range(1, longest):
        live = inside[:, t]
        if live.any():
            next_ = behind[t, live].copy()
            next_[:, 1] += odds[live, t]
            joint = ahead[t - 1, live][:, :, None] + steps + next_[:, None, :] - total[live, None, None]
            pairs += np.exp(joint).sum(0)
    return good, pairs, total


def train(features: np.ndarray, counts: np.ndarray, labels: np.ndarray, epochs: int = EPOCHS, ridge: float = 1e-3, rate: float = 0.1) -> LineField:
    """Maximum likelihood with every line labelled as its document, classes weighted evenly, by Adam steps."""
    kept = counts > 0
    if not kept.any() or len(set(labels[kept])) < 2:
        return LineField(np.zeros(WIDTH), np.zeros((2, 2)))
    counts, labels = counts[kept], labels[kept].astype(float)
    bounds = np.concatenate(([0], np.cumsum(counts)))
    longest = int(counts.max())
    grid = bounds[:-1][:, None] + np.minimum(np.arange(longest), counts[:, None] - 1)
    inside = np.arange(longest) < counts[:, None]
    share = np.where(labels == 1, 0.5 / max(labels.sum(), 1), 0.5 / max((1 - labels).sum(), 1)) / np.maximum(counts, 1)
    weights, steps = np.zeros(WIDTH), np.zeros((2, 2))
    moments = [[np.zeros_like(x), np.zeros_like(x)] for x in (weights, steps)]
    truth = np.repeat(labels, counts)
    line_share = np.repeat(share, counts)
    for epoch in range(1, epochs + 1):
        good, _, _ = _forward_backward((features @ weights)[grid], inside, steps)
        line_good = np.empty(len(features))
        line_good[grid[inside]] = good[inside]
        slope = features.T @ ((line_good - truth) * line_share) + ridge * weights
        turn = np.zeros((2, 2))
        for value in (0, 1):
            rows = labels == value
            _, pairs, _ = _forward_backward((features @ weights)[grid[rows]], inside[rows], steps)
            seen = float((counts[rows] - 1).sum())
            per = 0.5 / max(counts[rows].sum(), 1)
            pairs[value, value] -= seen
            turn += pairs * per
        for x, g, m in ((weights, slope, moments[0]), (steps, turn + ridge * steps, moments[1])):
            m[0][...] = 0.9 * m[0] + 0.1 * g
            m[1][...] = 0.999 * m[1] + 0.001 * g * g
            x -= rate * (m[0] / (1 - 0.9**epoch)) / (np.sqrt(m[1] / (1 - 0.999**epoch)) + 1e-9)
    return LineField(weights, steps)


def document_scores(field: LineField, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Length-weighted mean of the line marginals; documents without lines get what a line without features gets."""
    features, size, counts = line_features(data, offsets)
    bounds = np.concatenate(([0], np.cumsum(counts)))
    totals = lambda x: np.diff(np.concatenate(([0.0], np.cumsum(x)))[bounds])
    weight = totals(size)
    empty = 1 / (1 + np.exp(-np.clip(field.weights[-1], -500, 500)))
    mean = totals(size * field.marginals(features, counts)) / np.maximum(weight, 1)
    return np.clip(np.where(weight > 0, mean, empty), 0.0, 1.0)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, folds: int = 4, held_fold: int = 2) -> LineField:
    """Train on at most ``2 * per_class`` documents outside the held-out fold, on all their lines: a document is one chain,
    a long one several chains of ``CHAIN`` lines that follow each other."""
    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            features, _, counts = line_features(*byte_column(batch.column(1)))
            bounds = np.concatenate(([0], np.cumsum(counts)))
            cuts = [(i, c, min(c + CHAIN, b)) for i, (a, b) in enumerate(zip(bounds, bounds[1:])) for c in range(a, max(b, a + 1), CHAIN)]
            rows = [features[a:b].astype(np.float32).tobytes() for _, a, b in cuts]
            label = batch.column(0).take(pa.array([i for i, _, _ in cuts], pa.int64()))
            yield pa.RecordBatch.from_arrays([label, pa.array(rows, pa.binary())], ["label", "lines"])

    sample = labelled_sample(docs, labels, "quality", per_class, folds, held_fold)
    rows = sample.select("label", "text").mapInArrow(lines, "label int, lines binary").toArrow().to_pandas()
    rows = rows.sort_values(["label", "lines"], kind="stable")  # sums must not depend on the order of arrival
    found = [np.frombuffer(bytes(x), np.float32).reshape(-1, WIDTH) for x in rows["lines"]]
    features = np.concatenate(found).astype(float) if found else np.zeros((0, WIDTH))
    return train(features, np.array([len(x) for x in found], int), rows["label"].to_numpy(dtype=int))


def score(docs: DataFrame, field: LineField) -> DataFrame:
    """``docs`` with its ``doc_id`` and text as ``doc_id, score``."""
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            scores = document_scores(field, *byte_column(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, folds: int = 4, held_fold: int = 2, threshold: float = 0.7) -> DataFrame:
    """A quality score for every document: ``doc_id, held_out, score, predicted``.

    Labels of the held-out fold are never learnt. Null and empty texts have no lines and get the score of an empty line;
    repeated rows are scored alike; with one label only, or none, every score is 0.5. Only the text is read for a score.
    """
    found = score(docs, fit(docs, labels, per_class, folds, held_fold))
    return found.select(
        "doc_id", F.coalesce(fold_column(F.col("doc_id"), folds) == held_fold, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, field: LineField, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` whose text scores at least ``threshold``, with all their columns."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            good = document_scores(field, *byte_column(batch.column("text"))) >= threshold
            if good.any():
                yield batch.filter(pa.array(good))

    return docs.select(*names).mapInArrow(run, docs.schema)
