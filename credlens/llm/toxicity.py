"""Toxicity: a linear classifier of character n-grams, scaled by naive Bayes log-count ratios.

Features are the hashed n-grams inside words, with a mark at word starts and ends; a document has a feature or hasn't it.
Each feature is scaled by the log of the ratio of its (smoothed) shares among toxic and other documents, and a logistic
regression is fitted to the scaled features. Features with a clear ratio that are seen often enough are kept, so that long
clean texts don't gather noise.

Labels come from a bounded sample of labelled rows (EACH of either label), whatever their texts' length; its n-grams are
counted in PARTS tasks, and the driver gets the counts and the sample's kept features alone. Every document is scored over
its whole text, row by row, without a shuffle. Null text counts as empty and gets the score of a text without features.
Without labels of both kinds every score is 0. Repeated rows are scored alike; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .arrays import characters, longer, within
from .common import fold, labelled_texts, map_batches, released, slices, texts_of, written

#: Sampled labelled rows of either label, and the tasks that count them.
EACH, PARTS = 4000, 8
SIZES, BITS = (3, 4, 5, 6), 20
BUCKETS = 1 << BITS
#: Kept features: least documents, least absolute ratio.
SEEN, RATIO = 8, 1.0
#: Words whose n-grams are held at once.
FEATURED = 10_000


def ngrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word, feature): the hashed n-grams of each word, which stands between marks; by the word's number."""
    chars, starts, sizes = characters([f"<{w}>" for w in words])
    word = np.repeat(np.arange(len(words)), sizes)
    left = sizes[word] - within(starts, sizes, len(chars))
    grams, found = longer(chars, chars, 2), []
    for n in range(3, max(SIZES) + 1):
        grams = longer(grams, chars, n)
        if n in SIZES:
            found.append((word[left >= n], grams[left >= n]))
    return np.concatenate([w for w, _ in found]), (np.concatenate([g for _, g in found]) >> np.uint64(64 - BITS)).astype(np.int64)


def document_features(texts: list[str], place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, place), sorted and each once: the features that each text has. place: by feature; those with -1 are left out."""
    words = [set(t.lower().split()) for t in texts]
    different = list(dict.fromkeys(chain.from_iterable(words)))
    number = dict(zip(different, range(len(different)), strict=True))
    held = np.fromiter(map(number.__getitem__, chain.from_iterable(words)), np.int64)
    text = np.repeat(np.arange(len(texts)), list(map(len, words)))
    sizes, kept = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for at in range(0, len(different), FEATURED):
        some = different[at : at + FEATURED]
        word, feature = ngrams(some)
        feature = place[feature]
        pairs = np.unique(word[feature >= 0] * len(place) + feature[feature >= 0])
        sizes.append(np.bincount(pairs // len(place), minlength=len(some)))
        kept.append(pairs % len(place))
    sizes, kept = np.concatenate(sizes), np.concatenate(kept)
    n = sizes[held]
    spots = np.repeat((np.cumsum(sizes) - sizes)[held], n) + within(np.cumsum(n) - n, n, int(n.sum()))
    pairs = np.unique(np.repeat(text, n) * len(place) + kept[spots])
    return pairs // len(place), pairs % len(place)


@dataclass(frozen=True)
class Model:
    features: np.ndarray  # the kept ones
    weights: np.ndarray  # of each of them
    bias: float

    def place(self) -> np.ndarray:
        out = np.full(BUCKETS, -1, np.int64)
        out[self.features] = np.arange(len(self.features))
        return out


def count_features(sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Documents with each feature, by label, and documents by label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, docs, every = np.zeros((2, BUCKETS), np.int32), np.zeros(2, np.int64), np.arange(BUCKETS)
        for batch in (part for whole in batches for part in slices(whole)):
            labels = np.asarray(batch.column("label"))
            docs += np.bincount(labels, minlength=2)
            text, feature = document_features(batch.column("text").to_pylist(), every)
            np.add.at(counts, (labels[text], feature), np.int32(1))
        at = np.flatnonzero(counts.any(0)).astype(np.int32)
        yield pa.RecordBatch.from_pydict({"n0": [docs[0]], "n1": [docs[1]], "at": [at.tobytes()], "c0": [counts[0][at].tobytes()], "c1": [counts[1][at].tobytes()]})

    counts, docs = np.zeros((2, BUCKETS)), np.zeros(2)
    for row in sample.repartition(PARTS, "doc_id").mapInArrow(released(run), "n0 long, n1 long, at binary, c0 binary, c1 binary").toLocalIterator():
        at = np.frombuffer(row["at"], np.int32)
        docs += row["n0"], row["n1"]
        counts[0, at] += np.frombuffer(row["c0"], np.int32)
        counts[1, at] += np.frombuffer(row["c1"], np.int32)
    return counts, docs


def log_ratios(counts: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The kept features and their log-count ratios."""
    ratio = np.log((counts[1] + 0.5) / (docs[1] + 1)) - np.log((counts[0] + 0.5) / (docs[0] + 1))
    good = np.flatnonzero((counts.sum(0) >= SEEN) & (np.abs(ratio) >= RATIO))
    return good, ratio[good]


def logistic(row: np.ndarray, column: np.ndarray, value: np.ndarray, labels: np.ndarray, n: int, steps: int = 300, penalty: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias by accelerated gradient descent; the documents' values come as (row, column, value)."""
    m = len(labels)
    weights, bias, velocity, push = np.zeros(n), 0.0, np.zeros(n), 0.0
    rate = 1.0 / max(1.0, np.bincount(row, value**2, m).mean())
    for _ in range(steps):
        ahead = weights + 0.9 * velocity
        z = np.bincount(row, value * ahead[column], m) + bias + 0.9 * push
        wrong = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) / m
        velocity = 0.9 * velocity - rate * (np.bincount(column, value * wrong[row], n) + penalty * ahead)
        push = 0.9 * push - rate * wrong.sum()
        weights, bias = weights + velocity, bias + push
    return weights, float(bias)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    sample = written(labelled_texts(docs, labels, "toxic", EACH), "toxicity-sample")
    counts, n = count_features(sample)
    if not n.all():
        return Model(np.zeros(0, np.int64), np.zeros(0), -30.0)
    features, ratios = log_ratios(counts, n)
    shared = docs.sparkSession.sparkContext.broadcast(Model(features, ratios, 0.0))

    def make():
        place = shared.value.place()

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            text, found = document_features(batch.column("text").to_pylist(), place)
            parts = np.split(found.astype(np.int32), np.searchsorted(text, np.arange(1, batch.num_rows)))
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array([p.tobytes() for p in parts], pa.binary())], ["doc_id", "label", "found"])

        return one

    seen = map_batches(sample.select("doc_id", "text", "label").repartition(PARTS, "doc_id"), "doc_id long, label int, found binary", make).toPandas().sort_values("doc_id")
    found = [np.frombuffer(x, np.int32) for x in seen["found"]]
    row, column = np.repeat(np.arange(len(found)), list(map(len, found))), np.concatenate(found).astype(np.int64)
    weights, bias = logistic(row, column, ratios[column], seen["label"].to_numpy(float), len(features))
    return Model(features, weights * ratios, bias)


def probabilities(model: Model, place: np.ndarray, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Each text's score, and how many kept features it has."""
    text, found = document_features(texts, place)
    z = model.bias + np.bincount(text, model.weights[found], len(texts))
    return 1 / (1 + np.exp(-np.clip(z, -30, 30))), np.bincount(text, minlength=len(texts))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1) and features (how many kept ones the text has)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model, place = shared.value, shared.value.place()

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            scores, features = probabilities(model, place, batch.column("text").to_pylist())
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores), pa.array(features.astype(np.int32))], ["doc_id", "score", "features"])

        return one

    return map_batches(texts_of(docs), "doc_id long, score double, features int", make)


def keep_clean(docs: DataFrame, model: Model, floor: float) -> DataFrame:
    """The rows of docs whose score is under floor, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model, place = shared.value, shared.value.place()

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            scores, _ = probabilities(model, place, [t or "" for t in batch.column(at).to_pylist()])
            return batch.filter(pa.array(scores < floor))

        return one

    at = docs.columns.index("text")
    return map_batches(docs, docs.schema, make)


def learning(labels: DataFrame) -> DataFrame:
    """The labels that may be learned from."""
    return labels.where(fold("doc_id", 3) != 1)
