"""Secret scans: patterns, and the guess cost of values in credential contexts.

Whatever stands as the value of a credential-like name is scored by a dynamic program over its characters: the cheapest
segmentation into dictionary words, dates, repeats, keyboard walks and brute-force spans, each with the guesses (log10) it
takes to find. Values that take FLOOR or more are reported as kind `guess`, beside the pattern kinds, which always stay.
Words and their ranks come from a public vocabulary whose path is a parameter.

Positions are code points, ends exclusive. Null text counts as empty: no spans. Work is row by row, without a shuffle:
repeated rows get the same result, an empty table an empty one. Very long values cost time in proportion to their length.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable
from functools import cache
from math import log10

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_batches, texts_of
from .periodic import main_lorentz

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
#: Names that make what follows a credential, and the value: all that stands in quotes, else up to white space or brackets.
CONTEXT = re.compile(
    r"""(?:passphrase|password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credentials?|auth)["']?\x20*(?:[:=]|=>|\bis\b)\x20*(?:"([^"\r\n]+)"|'([^'\r\n]+)'|["']?([^\s"'<>(){}\[\],;]+))""",
    re.I | re.A,
)
#: Guesses (log10) from which a value counts as a secret, and the least length of one.
FLOOR, SHORTEST = 9.0, 8

#: Rows of a keyboard, and passwords and names that guessers try first.
KEYBOARD = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
COMMON = (
    "password passwd secret token changeme admin root test guest user login welcome letmein master dragon monkey shadow "
    "sunshine princess football baseball superman batman trustno1 iloveyou qwerty example sample default demo dummy none "
    "null undefined redacted placeholder your here insert value string xxxx foobar hello world summer winter spring autumn"
).split()


class Words(dict):
    """log10 of the guesses for each word, and the longest word's length."""

    def __init__(self, items):
        super().__init__(items)
        self.longest = max(map(len, self), default=0)


def ranked_words(path: str) -> Words:
    """log10 of the guesses for each word: its rank among the words of a rank file of base64 tokens, common passwords first."""
    with open(path, "rb") as f:
        tokens = [base64.b64decode(line.split()[0]).decode("utf-8", "replace").strip().lower() for line in f if line.strip()]
    words = dict.fromkeys([*COMMON, *(t for t in tokens if len(t) > 2 and t.isalpha())])
    return Words((w, log10(rank)) for rank, w in enumerate(words, 2))


@cache
def _neighbours() -> dict[str, set[str]]:
    near: dict[str, set[str]] = {}
    for y, row in enumerate(KEYBOARD):
        for x, c in enumerate(row):
            around = [(y, x - 1), (y, x + 1), (y - 1, x), (y - 1, x + 1), (y + 1, x - 1), (y + 1, x)]
            near[c] = {KEYBOARD[v][u] for v, u in around if 0 <= v < len(KEYBOARD) and 0 <= u < len(KEYBOARD[v])}
    return near


DATE = re.compile(r"(?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\2(?:19|20)\d\d|(?:19|20)\d\d", re.A)
#: Letters that stand for others, a fixed value.
LEET = str.maketrans("430157$@!", "aeoistsai")
#: Guesses (log10) of one character by brute force, of one more block of a repeat, of a step of a walk, and of a date.
BRUTE, AGAIN, STEP, DAY = 1.0, 0.3, 0.45, 4.6
#: Guesses of one more segment and of a walk, and characters of the blocks that are always tried.
SEGMENT, WALK, SHORT_BLOCK = 0.3, 1.5, 4
#: A block of more than SHORT_BLOCK characters and one more copy.
LONG_REPEAT = re.compile(r"(.{5,})\1", re.S)
#: Characters of a value that the pattern is tried on; longer ones are searched for runs at once.
PATTERN_TRIED = 100


class Open:
    """The cheapest of what may have begun at several places: a start's cost so far, and more(length) for how long it has got,
    which grows ever slower. So an earlier start that costs no less than a later one is never better again, a later one that
    isn't better at once never will be, and of two an earlier one may overtake a later one, once. A stack holds those that
    are the best at some time, the present best on top, each with the end from which the one below is no worse."""

    def __init__(self, more: Callable[[int], float], last: int):
        self.more, self.last, self.stack = more, last, []

    def cost(self, one: tuple, end: int) -> float:
        return one[0] + self.more(end - one[1])

    def overtakes(self, early: tuple, late: tuple, now: int) -> int:
        low, high = now, self.last + 1
        while low < high:
            middle = (low + high) // 2
            if self.cost(early, middle) <= self.cost(late, middle):
                high = middle
            else:
                low = middle + 1
        return low

    def add(self, cost: float, start: int, end: int) -> None:
        stack, new = self.stack, (cost, start)
        self.least(end)
        while stack and stack[-1][0] >= cost:
            stack.pop()
        if stack and self.cost(stack[-1], end) <= self.cost(new, end):
            return
        until = self.last + 2
        while stack:
            until = self.overtakes(stack[-1], new, end)
            if len(stack) < 2 or until < stack[-1][2]:
                break
            stack.pop()  # the one below overtakes it before it would overtake the new one
        stack.append((cost, start, until))

    def least(self, end: int) -> float:
        stack = self.stack
        while len(stack) > 1 and stack[-1][2] <= end:
            stack.pop()
        return self.cost(stack[-1], end) if stack else float("inf")


class Walks:
    """The cheapest walk that ends at each place: three characters or more, each next to the one before in one of the ways of
    step(). A walk may begin anywhere in a run of one kind."""

    def __init__(self, lower: str):
        self.lower, self.near, self.kind, self.since = lower, _neighbours(), None, 0
        self.begun = self.none()

    def none(self) -> Open:
        return Open(lambda length: STEP * (length - 1) ** 0.5, len(self.lower))

    def step(self, end: int) -> int | None:
        """How the last character follows the one before: 1 or -1 by number, 2 on the keyboard."""
        delta = ord(self.lower[end - 1]) - ord(self.lower[end - 2])
        return delta if delta in (-1, 1) else 2 if self.lower[end - 1] in self.near.get(self.lower[end - 2], ()) else None

    def ending(self, end: int, best: list[float]) -> float:
        """To be called for each end in turn."""
        kind = self.step(end) if end > 1 else None
        if kind is None or kind != self.kind:
            self.kind, self.begun, self.since = kind, self.none(), end - 2
        if kind is None or end - 3 < self.since:
            return float("inf")
        self.begun.add(best[end - 3], end - 3, end)
        return self.begun.least(end) + SEGMENT + WALK


class Repeats:
    """The cheapest repeat of a block of `period` characters that ends at each place. A repeat may begin anywhere and end after
    any copy from the second; the block costs what its characters cost, copies the logarithm of how many they are. Starts are
    kept for each place modulo the period."""

    def __init__(self, value: str, period: int):
        self.value, self.period, self.same = value, period, 0
        self.begun = self.none()

    def none(self) -> list[Open]:
        return [Open(lambda length: AGAIN * log10(1 + length / self.period), len(self.value)) for _ in range(self.period)]

    def ending(self, end: int, best: list[float]) -> float:
        """To be called for each end in turn."""
        period = self.period
        if end <= period or self.value[end - 1] != self.value[end - 1 - period]:
            if self.same >= period:
                self.begun = self.none()
            self.same = 0
            return float("inf")
        self.same += 1
        if self.same < period:
            return float("inf")
        begun = self.begun[end % period]
        begun.add(best[end - 2 * period], end - 2 * period, end)
        return begun.least(end) + SEGMENT + BRUTE * period


def periods(value: str) -> list[int]:
    """Lengths of the blocks that a repeat may have: short ones, and the periods of the value's runs of two copies or more. A
    block that is itself a repeat never costs less than its own block does."""
    short = list(range(1, SHORT_BLOCK + 1))
    if len(value) < 2 * SHORT_BLOCK + 2 or len(value) <= PATTERN_TRIED and not LONG_REPEAT.search(value):
        return short
    points = np.frombuffer(value.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    found = main_lorentz(points, np.zeros(1, np.int64), np.array([len(points)]), 2, 2)[:, 2]
    return short + sorted({int(p) for p in found if p > SHORT_BLOCK})


def guess_cost(value: str, words: dict[str, float]) -> float:
    """log10 of the guesses of the cheapest segmentation: best[i] is the least cost of value[:i]. Each further segment
    costs a little more, for the orders in which a guesser may try them."""
    lower, n = value.lower(), len(value)
    if len(lower) != n:  # a character that has two in lower case
        lower = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
    plain = lower.translate(LEET)
    longest = words.longest if isinstance(words, Words) else max(map(len, words), default=0)
    best = [0.0] + [float("inf")] * n
    runs = [Walks(lower), *[Repeats(value, period) for period in periods(value)]]
    for i in range(n + 1):
        best[i] = min(best[i], *[r.ending(i, best) for r in runs])
        if i == n:
            return best[n]
        at = best[i] + SEGMENT
        best[i + 1] = min(best[i + 1], best[i] + BRUTE)  # a brute-force span begins or goes on
        for end in range(i + 3, min(n, i + longest) + 1):
            if (rank := words.get(lower[i:end])) is not None:
                best[end] = min(best[end], at + rank + (0.0 if value[i:end] == lower[i:end] else 0.5))
            elif (rank := words.get(plain[i:end])) is not None:
                best[end] = min(best[end], at + rank + 0.8)
        if m := DATE.match(value, i):
            best[m.end()] = min(best[m.end()], at + (DAY if m.end() - i > 4 else 2.1))
    return best[n]


def find_spans(text: str, words: dict[str, float]) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of all spans, sorted."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    for m in CONTEXT.finditer(text):
        value, start = m[m.lastindex], m.start(m.lastindex)
        value = value.rstrip(".:!?") if m.lastindex == 3 else value
        if len(value) >= SHORTEST and guess_cost(value, words) >= FLOOR:
            found.append((start, 3, start + len(value)))
    return sorted(found)


def scan(docs: DataFrame, words_path: str) -> DataFrame:
    """doc_id and spans (array of kind, start, end), by start and then kind as listed in KINDS."""
    shared = docs.sparkSession.sparkContext.broadcast(ranked_words(words_path))

    def make():
        words = shared.value

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            spans = [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in find_spans(t.as_py(), words)] for t in batch.column("text")]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, kind)], ["doc_id", "spans"])

        return one

    return map_batches(texts_of(docs), "doc_id long, spans array<struct<kind: string, start: long, end: long>>", make)

