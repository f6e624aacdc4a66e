"""Texts as numpy arrays: hashes of words and of character n-grams, worked out for many words at once.

Hashes have 64 bits. A word's is a sum over its bytes, each times a random number of its place, mixed; an n-gram's is made
from its characters' in order. Memory is bounded by the texts given, of which words are looked at about GROUP bytes at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

GROUP = 1 << 20
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _places(at: np.ndarray) -> np.ndarray:
    return mixed((at.astype(np.uint64) + np.uint64(1)) * MULTIPLIER) | np.uint64(1)


_PLACES = _places(np.arange(1 << 12))
_BYTES = mixed(np.arange(256, dtype=np.uint64) + np.uint64(1 << 20))


def within(starts: np.ndarray, sizes: np.ndarray, total: int) -> np.ndarray:
    """Each element's place in its own run, for runs that follow each other."""
    return np.arange(total) - np.repeat(starts, sizes)


def _groups(starts: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of words that begin within GROUP bytes."""
    cuts = np.flatnonzero(np.diff(starts // GROUP)) + 1
    yield from zip([0, *cuts.tolist()], [*cuts.tolist(), len(starts)], strict=True)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (runs without ASCII white space, A-Z lower-cased) of the texts in order, and where each text's
    words begin and end among them (one more than there are texts). Null texts have none."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    flat = lists.flatten()
    ends = np.frombuffer(flat.buffers()[1], np.int32)[flat.offset : flat.offset + len(flat) + 1].astype(np.int64) if len(flat) else np.zeros(1, np.int64)
    real = np.diff(ends) > 0  # white space at either end of a text leaves an empty word
    offsets = np.concatenate([[0], np.cumsum(real)])[np.asarray(lists.offsets)]
    starts, sizes = ends[:-1][real], np.diff(ends)[real]
    out = np.empty(len(starts), np.uint64)
    if len(starts):
        data = np.frombuffer(flat.buffers()[2], np.uint8)
        for a, b in _groups(starts):
            own, n = starts[a:b] - starts[a], sizes[a:b]
            place = within(own, n, int(n.sum()))
            factor = _PLACES[place] if n.max() <= len(_PLACES) else _places(place)
            sums = np.add.reduceat(_BYTES[data[starts[a] : starts[b - 1] + sizes[b - 1]]] * factor, own)
            out[a:b] = mixed(sums + n.astype(np.uint64) * MULTIPLIER)
    return out, offsets


def shingle_sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's n-grams of that many words; of all its words, if they are fewer."""
    h, offsets = word_hashes(texts)

    def grams(h: np.ndarray, n: int) -> np.ndarray:
        x = np.full(max(0, len(h) - n + 1), n, np.uint64)
        for i in range(n):
            x = x * MULTIPLIER + h[i : len(h) - n + 1 + i]
        return mixed(x)

    every, out = grams(h, words), []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b - a < words:
            out.append(grams(h[a:b], b - a) if b > a else np.zeros(0, np.uint64))
            continue
        x = np.sort(every[a : b - words + 1])
        out.append(x[np.concatenate([[True], x[1:] != x[:-1]])])
    return out


def characters(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the characters of all words after each other, where each word starts, and its length."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
    return mixed(points.astype(np.uint64) + np.uint64(1)), np.cumsum(sizes) - sizes, sizes


def longer(grams: np.ndarray, chars: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n-grams by the place of their first character, from those that are one character shorter. Places where the
    characters end too soon keep a value that stands for nothing."""
    out = grams.copy()
    if len(chars) >= n:
        out[: len(chars) - n + 1] = mixed(grams[: len(chars) - n + 1] * MULTIPLIER + chars[n - 1 :])
    return out
