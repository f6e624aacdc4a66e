"""Language ID of words in code-switched text by a linear-chain conditional random field.

A word's emission scores are sums of learned weights of its features: prefixes, suffixes, character n-grams and the word
itself (lexicon); transitions between the languages of neighbouring words are learned as well. Forward-backward over all
words of a text gives each word's probabilities; their mean over the words that have a letter gives the document's
language. Training sequences are spliced from spans of documents in different languages, so that transitions are seen.

A word of more than WORD characters, such as a text without spaces, is cut into pieces of WORD characters. Each piece is a
position of its own, in learning too, and all characters and n-grams of the word are read, each once. Where words are
labelled, a long word's label is that of its pieces together.

Learning takes a bounded sample (about EACH documents of every language; see bounded_sample), and of long texts spans that are
spread over all of them, so that the driver gets about LEARNED words at most. Whole texts are labelled: words
are packed in rows of SPAN, and a longer text's rows are joined by their transfer matrices, so that long texts need no long
loop and no padding to the longest; with so many languages that the matrices of a text would take over 32 MB, it is gone through
word by word in segments instead. Row by row, without a shuffle. Null text or text without a letter is `und` with
score 0; without anything to learn from all are. Repeated rows are labelled alike, empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import MULTIPLIER, characters, longer, mixed, within
from .common import bounded_sample, fold, map_batches, written

EACH = 300
BITS = 17
BUCKETS = 1 << BITS
#: Words of a training sequence, sequences of a step, and steps; words of a row in forward-backward.
LENGTH, SEQUENCES, STEPS, SPAN = 24, 64, 250, 64
#: Words that are worked on at once, and words whose features are held at once.
AT_ONCE, FEATURED = 200_000, 10_000
#: Characters of a position: longer words are cut.
WORD = 40
#: Words that the driver learns from at most, about, and words of a span where not all of a text's are among them.
LEARNED, SPREAD = 2_000_000, 8 * 24
#: Numbers in the transfer matrices that are held at once (8 bytes each), and words of a segment of a text that would need more.
MATRICES, SEGMENT = 1 << 22, 4096


def pieces(word: str) -> list[str]:
    """A word, or its pieces if it is long. All pieces but the first begin with a blank and the two characters before, all but
    the last end with a blank; words have no blanks."""
    if len(word) <= WORD:
        return [word]
    return [(f" {word[i - 2 : i]}" if i else "") + word[i : i + WORD] + (" " if i + WORD < len(word) else "") for i in range(0, len(word), WORD)]


def cut(text: str) -> list[str]:
    words = text.split()
    return words if max(map(len, words), default=0) <= WORD else [p for w in words for p in pieces(w)]


def lettered(piece: str) -> bool:
    """Whether a word or piece has a letter of its own."""
    return piece.isalpha() or any(map(str.isalpha, piece[3:] if piece[0] == " " else piece))


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word, feature): all features of words or pieces (none empty), by the word's number. Features are n-grams of one to
    three characters; two or three characters at the start, one to three at the end; the whole. A piece has those n-grams
    whose last character it has, the start if it is a word's first and the end if it is its last."""
    lower = [w.strip(" ").lower() for w in words]
    before = np.array([len(w[1:3].lower()) if w[0] == " " else 0 for w in words], np.int64)
    last = np.array([w[-1] != " " for w in words], bool)
    c, starts, sizes = characters(lower)
    two = longer(c, c, 2)
    three = longer(two, c, 3)
    word = np.repeat(np.arange(len(words)), sizes)
    place = within(starts, sizes, len(c))
    left, needed = sizes[word] - place, before[word] - place
    found = [(word[ok], h[ok]) for h, ok in ((c, needed <= 0), (two, (left > 1) & (needed <= 1)), (three, (left > 2) & (needed <= 2)))]

    def edge(at: np.ndarray, n: int, end: bool) -> None:
        size = np.minimum(sizes[at], n)
        first = starts[at] + (sizes[at] - size if end else 0)
        found.append((at, mixed(np.choose(size - 1, [x[first] for x in (c, two, three)]) + np.uint64(1 + end))))

    for n in (2, 3):
        edge(np.flatnonzero(before == 0), n, False)
    for n in (1, 2, 3):
        edge(np.flatnonzero(last), n, True)
    at = np.flatnonzero((before == 0) & last)
    whole = np.add.reduceat(mixed(c + place.astype(np.uint64) * MULTIPLIER), starts) if len(c) else c
    found.append((at, mixed(whole[at] + np.uint64(3))))
    return np.concatenate([w for w, _ in found]), (np.concatenate([h for _, h in found]) >> np.uint64(64 - BITS)).astype(np.int64)


def emissions(words: list[str], table: np.ndarray) -> np.ndarray:
    """Each word's sum of its features' rows of the table; a word without a letter has zeros."""
    out = np.zeros((len(words), table.shape[1]))
    known = [i for i, w in enumerate(words) if lettered(w)]
    if known:
        word, feature = features([words[i] for i in known])
        rows = table[feature]
        out[known] = np.stack([np.bincount(word, rows[:, j], len(known)) for j in range(table.shape[1])], 1)
    return out


@dataclass(frozen=True)
class Model:
    languages: list[str]
    emission: np.ndarray  # BUCKETS, languages
    transition: np.ndarray  # from, to


def step_gradient(scores: np.ndarray, transition: np.ndarray, gold: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the negative log-likelihood by scores (sequences, words, languages) and by transition."""
    n, length, _ = scores.shape
    e, a = np.exp(scores - scores.max(2, keepdims=True)), np.exp(transition)
    alpha, beta, norm = np.empty_like(e), np.ones_like(e), np.empty((n, length, 1))
    for t in range(length):
        x = e[:, t] if t == 0 else alpha[:, t - 1] @ a * e[:, t]
        norm[:, t] = x.sum(1, keepdims=True)
        alpha[:, t] = x / norm[:, t]
    for t in range(length - 2, -1, -1):
        beta[:, t] = (beta[:, t + 1] * e[:, t + 1]) @ a.T / norm[:, t + 1]
    marginal = alpha * beta
    marginal /= marginal.sum(2, keepdims=True)
    by_score = marginal.copy()
    np.put_along_axis(by_score, gold[..., None], np.take_along_axis(by_score, gold[..., None], 2) - 1, 2)
    pair = np.einsum("nti,ij,ntj->nij", alpha[:, :-1], a, beta[:, 1:] * e[:, 1:] / norm[:, 1:]) if length > 1 else np.zeros((n, *a.shape))
    by_transition = pair.sum(0)
    np.subtract.at(by_transition, (gold[:, :-1].ravel(), gold[:, 1:].ravel()), 1)
    return by_score / n, by_transition / n


def spread_spans(words: list[str], most: int) -> list[str]:
    """At most about so many of a text's words: all, or spans of SPREAD words that are evenly spread over it."""
    if len(words) <= most:
        return words
    n = max(1, most // SPREAD)
    starts = [k * (len(words) - SPREAD) // max(1, n - 1) for k in range(n)]
    return [w for at in starts for w in words[at : at + SPREAD]]


def fit(docs: DataFrame) -> Model:
    """docs: text and lang of the documents that may be learned from."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    ids = bounded_sample(rows.select("doc_id", "lang"), "lang", EACH).select("doc_id").distinct()
    ids = written(ids, "learned")
    most = max(SPREAD, LEARNED // max(1, ids.count()))

    def lettered_words(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = [spread_spans([w for w in cut(t) if lettered(w)], most) for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), pa.array(words, pa.list_(pa.string()))], ["doc_id", "lang", "words"])

    got = rows.join(F.broadcast(ids), "doc_id").select("doc_id", "lang", "text")
    got = map_batches(got, "doc_id long, lang string, words array<string>", lambda: lettered_words).toPandas()  # bounded: see LEARNED
    got["words"] = got["words"].map(list)
    got = got[got["words"].map(len) > 0].sort_values(["doc_id", "lang"])
    languages = sorted(got["lang"].unique())
    k = len(languages)
    if not k:
        return Model([], np.zeros((0, 0)), np.zeros((0, 0)))
    by_language = [got["words"][got["lang"] == x].tolist() for x in languages]
    random = np.random.default_rng(5)
    weights, squares = np.zeros((BUCKETS, k)), np.full((BUCKETS, k), 1e-6)
    transition, t_squares = np.zeros((k, k)), np.full((k, k), 1e-6)
    for _ in range(STEPS):
        words, gold = [], np.empty((SEQUENCES, LENGTH), np.int64)
        for s in range(SEQUENCES):
            at = 0
            while at < LENGTH:  # a span of 3 to LENGTH words of one language, then another
                lang = int(random.integers(k))
                doc = by_language[lang][int(random.integers(len(by_language[lang])))]
                start = int(random.integers(len(doc)))
                span = doc[start : start + min(LENGTH - at, int(random.integers(3, LENGTH + 1)))]
                words += span
                gold[s, at : at + len(span)] = lang
                at += len(span)
        word, flat = features(words)
        scores = np.stack([np.bincount(word, weights[flat, j], len(words)) for j in range(k)], 1).reshape(SEQUENCES, LENGTH, k)
        by_score, by_transition = step_gradient(scores, transition, gold)
        used, place = np.unique(flat, return_inverse=True)
        spread = by_score.reshape(-1, k)[word]
        gradient = np.stack([np.bincount(place, spread[:, j], len(used)) for j in range(k)], 1)
        squares[used] += gradient**2
        weights[used] -= 0.1 * gradient / np.sqrt(squares[used])
        t_squares += by_transition**2
        transition -= 0.05 * by_transition / np.sqrt(t_squares)
    return Model(languages, weights.astype(np.float32), transition)


def in_segments(scores: np.ndarray, a: np.ndarray) -> np.ndarray:
    """forward_backward of one text, word after word with vectors alone; of the first pass, only where segments begin is kept."""
    n, k = scores.shape
    starts, x, entered = range(0, n, SEGMENT), np.full(k, 1.0 / k), []
    of = lambda s: np.exp((part := scores[s : s + SEGMENT]) - part.max(1, keepdims=True))

    def forward(x: np.ndarray, e: np.ndarray) -> Iterator[np.ndarray]:
        for own in e:
            y = x @ a * own
            x = y / y.sum()
            yield x

    for s in starts:
        entered.append(x)
        for x in forward(x, of(s)):  # noqa: B007
            pass
    out, leave = np.empty((n, k)), np.ones(k)
    for s, x in zip(reversed(starts), reversed(entered), strict=True):
        e = of(s)
        out[s : s + len(e)] = list(forward(x, e))
        for t in range(len(e) - 1, -1, -1):
            out[s + t] *= leave
            leave = a @ (leave * e[t])
            leave /= leave.sum()
    out /= out.sum(1, keepdims=True)
    return out


def forward_backward(scores: np.ndarray, sizes: np.ndarray, transition: np.ndarray) -> np.ndarray:
    """Each word's probabilities. scores: all documents' words after each other; sizes: words of each document."""
    k, a = scores.shape[1], np.exp(transition - transition.max())
    rows = -(-sizes // SPAN)
    if len(rows) == 1 < rows[0] and rows[0] * k * k > MATRICES:
        return in_segments(scores, a)
    first, n = np.cumsum(rows) - rows, int(rows.sum())
    row = np.repeat(first, sizes) + within(np.cumsum(sizes) - sizes, sizes, len(scores)) // SPAN  # of each word
    lengths = np.bincount(row, minlength=n)
    order = np.argsort(-lengths, kind="stable")  # long rows first: the first live[t] have a word at place t
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    live = np.searchsorted(-lengths[order], -np.arange(SPAN), "left")
    at = (within(np.cumsum(lengths) - lengths, lengths, len(scores)), rank[row])
    e = np.empty((SPAN, n, k))
    e[at] = np.exp(scores - scores.max(1, keepdims=True))
    enter, leave = np.full((n, k), 1.0 / k), np.ones((n, k))
    several = np.flatnonzero(np.repeat(rows > 1, rows))
    if len(several):  # rows of texts that have several get a transfer matrix each
        several = several[np.argsort(rank[several])]
        own = rank[several]
        matrix = np.broadcast_to(np.eye(k), (len(several), k, k)).copy()
        for t in range(SPAN):
            m = int(np.searchsorted(own, live[t]))
            x = matrix[:m] @ a * e[t, own[:m]][:, None, :]
            matrix[:m] = x / x.max((1, 2), keepdims=True)
        of = np.zeros(n, np.int64)
        of[several] = np.arange(len(several))
        for j in range(1, int(rows.max())):
            to = first[rows > j] + j
            x = np.einsum("ni,nij->nj", enter[rank[to - 1]], matrix[of[to - 1]])
            enter[rank[to]] = x / x.sum(1, keepdims=True)
            to = (first + rows - 1 - j)[rows > j]
            x = np.einsum("nij,nj->ni", matrix[of[to + 1]], leave[rank[to + 1]])
            leave[rank[to]] = x / x.sum(1, keepdims=True)
    alpha, x = np.empty_like(e), enter
    for t in range(SPAN):
        y = x[: live[t]] @ a * e[t, : live[t]]
        x = y / y.sum(1, keepdims=True)
        alpha[t, : live[t]] = x
    x = leave
    for t in range(SPAN - 1, -1, -1):
        m = live[t]
        alpha[t, :m] *= x[:m]
        y = (x[:m] * e[t, :m]) @ a.T
        x[:m] = y / y.sum(1, keepdims=True)
    found = alpha[at]
    return found / found.sum(1, keepdims=True)


def label_texts(texts: list[str], model: Model) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text, the probabilities of its words (a long one's pieces) and which of them have a letter."""
    out: list[tuple[np.ndarray, np.ndarray]] = []
    k, start = len(model.languages), 0
    words, at_once = [cut(t) for t in texts], min(AT_ONCE, max(SPAN, SPAN * MATRICES // max(1, k * k)))
    while start < len(words):
        stop, total = start, 0
        while stop < len(words) and (stop == start or total + len(words[stop]) <= at_once):
            total += len(words[stop])
            stop += 1
        sizes = np.array([len(w) for w in words[start:stop]])
        different = list(dict.fromkeys(chain.from_iterable(words[start:stop])))  # each one's scores are worked out once
        number = dict(zip(different, range(len(different)), strict=True))
        at = np.fromiter(map(number.__getitem__, chain.from_iterable(words[start:stop])), np.int64, total)
        has = np.fromiter(map(lettered, different), bool, len(different))
        table = [emissions(different[i : i + FEATURED], model.emission) for i in range(0, len(different), FEATURED)]
        found = forward_backward(np.concatenate(table)[at], sizes, model.transition) if total else np.zeros((0, k))
        ends = np.cumsum(sizes)[:-1]
        out += zip(np.split(found, ends), np.split(has[at], ends), strict=True)
        start = stop
    return out


def word_labels(text: str, p: np.ndarray, names: np.ndarray) -> list[str]:
    """Each word's language; p: the probabilities of its pieces."""
    sizes = np.array([-(-len(w) // WORD) for w in text.split()])
    return names[np.add.reduceat(p, np.cumsum(sizes) - sizes).argmax(1)].tolist()


def identify(docs: DataFrame, model: Model, words: bool = False) -> DataFrame:
    """doc_id, lang_pred, score, shares (mean probability of each language) and, if asked for, labels (of each word)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = "doc_id long, lang_pred string, score double, shares map<string, double>" + (", labels array<string>" if words else "")

    def make():
        model = shared.value
        names = np.array(model.languages, object)

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            known = [bool(model.languages) and any(map(str.isalpha, t)) for t in texts]
            found = label_texts([t if ok else "" for t, ok in zip(texts, known, strict=True)], model)
            means = [p[has].mean(0) if ok else None for (p, has), ok in zip(found, known, strict=True)]
            columns = [
                batch.column("doc_id"),
                pa.array(["und" if m is None else names[m.argmax()] for m in means], pa.string()),
                pa.array([0.0 if m is None else min(1.0, float(m.max())) for m in means], pa.float64()),
                pa.array([[] if m is None else list(zip(model.languages, m.tolist(), strict=True)) for m in means], pa.map_(pa.string(), pa.float64())),
            ]
            if words:
                columns.append(pa.array([word_labels(t, p, names) if ok else [] for t, (p, _), ok in zip(texts, found, known, strict=True)], pa.list_(pa.string())))
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "lang_pred", "score", "shares", *(["labels"] if words else [])])

        return one

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(rows, schema, make)


def learning(docs: DataFrame) -> DataFrame:
    """The documents that may be learned from."""
    return docs.where(fold("doc_id", 3) != 1)
