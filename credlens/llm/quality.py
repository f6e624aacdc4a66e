"""Quality classifier: a byte-level convolutional network in numpy.

A text's bytes are cut into overlapping chunks that cover all of it. In each chunk learned filters slide over embedded
bytes; the maximum of each filter feeds a hidden layer, and each hidden unit's maximum and mean over the chunks are
combined into one probability. All weights are learned by gradient descent; as maxima pass gradients to one place each,
the backward step touches those places alone.

Learning takes a bounded sample of labelled rows (EACH of either label) on the driver, and of each at most LEARNED chunks,
evenly spread over the whole text; they are cut in tasks, so that no text reaches the driver whole.
Scoring goes over whole texts, CHUNKS chunks at a time, row by row, without a shuffle. Null text counts as empty and is
scored as one chunk of padding. Without labels of both kinds every score is the share of label 1 (1, if there are none).
Repeated rows are scored alike; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import fold, labelled_texts, map_batches, texts_of

EACH = 700
#: Bytes of a chunk and of its overlap with the next; the filters' width and stride; sizes of the layers.
CHUNK, OVERLAP, WIDTH, STRIDE = 264, 24, 9, 3
EMBED, FILTERS, HIDDEN = 6, 24, 16
EPOCHS, BATCH, RATE = 8, 16, 0.01
#: Chunks that are worked on at once, and of a text that is learned from.
CHUNKS, LEARNED = 4096, 512
PAD = 256


@dataclass
class Network:
    embed: np.ndarray  # 257, EMBED
    filters: np.ndarray  # WIDTH * EMBED, FILTERS
    floor: np.ndarray
    hidden: np.ndarray  # FILTERS, HIDDEN
    offset: np.ndarray
    out: np.ndarray  # 2 * HIDDEN
    bias: np.ndarray  # 1

    @staticmethod
    def random(seed: int = 3) -> Network:
        r = np.random.default_rng(seed)
        f = lambda *shape, scale: r.normal(0, scale, shape).astype(np.float32)
        return Network(f(257, EMBED, scale=1), f(WIDTH * EMBED, FILTERS, scale=(WIDTH * EMBED) ** -0.5), f(FILTERS, scale=0.01),
                       f(FILTERS, HIDDEN, scale=FILTERS**-0.5), f(HIDDEN, scale=0.01), f(2 * HIDDEN, scale=0.2), f(1, scale=0.01))

    def parts(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.floor, self.hidden, self.offset, self.out, self.bias]


def chunk_count(data: bytes) -> int:
    return max(1, -(-(len(data) - OVERLAP) // (CHUNK - OVERLAP)))


def spread_chunks(data: bytes, most: int = LEARNED) -> list[bytes]:
    """At most so many of a text's chunks, evenly spread."""
    n, step = chunk_count(data), CHUNK - OVERLAP
    return [data[at * step : at * step + CHUNK] for at in (range(n) if n <= most else np.arange(most) * n // most)]


def chunked(data: bytes) -> np.ndarray:
    """(chunks, CHUNK) byte values; the last chunk is padded."""
    step, n = CHUNK - OVERLAP, chunk_count(data)
    padded = np.full((n - 1) * step + CHUNK, PAD, np.int16)
    padded[: len(data)] = np.frombuffer(data, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::step]


def windows(net: Network, chunks: np.ndarray) -> np.ndarray:
    """(chunks, places, WIDTH * EMBED): the embedded bytes under the filters."""
    x = net.embed[chunks]
    view = np.lib.stride_tricks.sliding_window_view(x, WIDTH, axis=1)[:, ::STRIDE]  # chunks, places, EMBED, WIDTH
    return view.transpose(0, 1, 3, 2).reshape(len(chunks), -1, WIDTH * EMBED)


def hidden(net: Network, chunks: np.ndarray) -> tuple[np.ndarray, ...]:
    under = windows(net, chunks)
    top = under @ net.filters
    place = top.argmax(1)
    most = np.take_along_axis(top, place[:, None], 1)[:, 0] + net.floor
    return under, place, most, np.maximum(np.tanh(most) @ net.hidden + net.offset, 0)


def probability(net: Network, data: bytes) -> float:
    """The network's output over a whole text, in bounded memory."""
    chunks = chunked(data)
    most, total = np.zeros(HIDDEN, np.float32), np.zeros(HIDDEN)
    for at in range(0, len(chunks), CHUNKS):
        h = hidden(net, chunks[at : at + CHUNKS])[-1]
        most, total = np.maximum(most, h.max(0)), total + h.sum(0)
    return combined(net, most, total / len(chunks))


def combined(net: Network, most: np.ndarray, mean: np.ndarray) -> float:
    z = float(np.concatenate([most, mean]) @ net.out + net.bias[0])
    return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def probabilities(net: Network, texts: list[bytes]) -> list[float]:
    """probability() of each text; short ones share the matrix products."""
    out, group, size = [0.0] * len(texts), [], 0

    def finish() -> None:
        nonlocal group, size
        if group:
            h = hidden(net, np.concatenate([c for _, c in group]))[-1]
            starts = np.cumsum([0, *(len(c) for _, c in group)])[:-1]
            most, total = np.maximum.reduceat(h, starts), np.add.reduceat(h.astype(float), starts)
            for j, (i, c) in enumerate(group):
                out[i] = combined(net, most[j], total[j] / len(c))
        group, size = [], 0

    for i, data in enumerate(texts):
        if len(data) > CHUNKS // 16 * (CHUNK - OVERLAP):
            out[i] = probability(net, data)
            continue
        chunks = chunked(data)
        group.append((i, chunks))
        size += len(chunks)
        if size >= CHUNKS // 16:
            finish()
    finish()
    return out


def gradients(net: Network, texts: list[np.ndarray], labels: np.ndarray, weights: np.ndarray) -> list[np.ndarray]:
    """Of the weighted log loss over a few texts (their chunks)."""
    chunks = np.concatenate(texts)
    sizes = np.array([len(t) for t in texts])
    starts, doc = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(texts)), sizes)
    under, place, most, h = hidden(net, chunks)
    top, mean = np.maximum.reduceat(h, starts), np.add.reduceat(h, starts) / sizes[:, None]
    both = np.concatenate([top, mean], 1)
    p = 1 / (1 + np.exp(-np.clip(both @ net.out + net.bias, -30, 30)))
    wrong = ((p - labels) * weights / len(texts)).astype(np.float32)
    d_both = wrong[:, None] * net.out
    d_h = (d_both[:, HIDDEN:] / sizes[:, None])[doc]
    first = np.full((len(texts), HIDDEN), len(chunks))  # the chunk that holds a unit's maximum; of several, the first
    at, unit = np.nonzero(h == top[doc])
    np.minimum.at(first, (doc[at], unit), at)
    d_h[first, np.arange(HIDDEN)] += d_both[:, :HIDDEN]
    d_h *= h > 0
    bent = np.tanh(most)
    d_most = (d_h @ net.hidden.T) * (1 - bent**2)
    row = np.arange(len(chunks))[:, None]
    spots = under[row, place]  # chunks, FILTERS, WIDTH * EMBED
    d_filters = np.einsum("cf,cfw->wf", d_most, spots)
    d_spots = (d_most[:, :, None] * net.filters.T[None]).reshape(-1, EMBED)
    values = chunks[row[:, :, None], place[:, :, None] * STRIDE + np.arange(WIDTH)].reshape(-1)
    d_embed = np.stack([np.bincount(values, d_spots[:, j], 257) for j in range(EMBED)], 1)
    return [d_embed, d_filters, d_most.sum(0), bent.T @ d_h, d_h.sum(0), both.T @ wrong, wrong.sum(keepdims=True)]


def train(texts: list[list[bytes]], labels: np.ndarray, share: float) -> Network:
    """texts: their chunks. share: of label 1 among all labels; the sample's labels are weighted by it."""
    net, random = Network.random(), np.random.default_rng(11)
    chunks = [np.concatenate([chunked(c) for c in t]) for t in texts]
    own = labels.mean()
    weights = np.where(labels == 1, share / own, (1 - share) / (1 - own))
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in net.parts()]
    step, steps = 0, EPOCHS * -(-len(texts) // BATCH)
    for _ in range(EPOCHS):
        order = random.permutation(len(texts))
        for at in range(0, len(order), BATCH):
            some, step = order[at : at + BATCH], step + 1
            rate = RATE * (1 - 0.95 * step / steps)
            for p, g, (m, v) in zip(net.parts(), gradients(net, [chunks[i] for i in some], labels[some], weights[some]), moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
    return net


def fit(docs: DataFrame, labels: DataFrame) -> Network:

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        chunks = [spread_chunks(t) for t in batch.column("text").cast(pa.binary()).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(chunks, pa.list_(pa.binary()))], ["doc_id", "label", "chunks"])

    sample = labelled_texts(docs, labels, "quality", EACH).select("doc_id", "label", "text")
    got = map_batches(sample, "doc_id long, label int, chunks array<binary>", lambda: cut).toPandas().sort_values("doc_id")  # about EACH rows of either label
    marks = got["label"].to_numpy(float)
    if not 0 < marks.sum() < len(marks):
        net = Network.random()
        net.out[:], net.bias[:] = 0, 30.0 if not len(marks) or marks[0] == 1 else -30.0
        return net
    counts = {r["quality"]: r["count"] for r in labels.where("quality in (0, 1)").groupBy("quality").count().collect()}
    return train([list(c) for c in got["chunks"]], marks, counts[1] / (counts[0] + counts[1]))


def score(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id, score (0 to 1, higher: better) and n_chunks of each document."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def make():
        net = shared.value

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [t.as_py().encode() for t in batch.column("text")]
            sizes = [chunk_count(t) for t in texts]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(probabilities(net, texts), pa.float64()), pa.array(sizes, pa.int64())], ["doc_id", "score", "n_chunks"])

        return one

    return map_batches(texts_of(docs), "doc_id long, score double, n_chunks long", make)


def learning(labels: DataFrame) -> DataFrame:
    """The labels that may be learned from."""
    return labels.where(fold("doc_id", 5) != 0)
