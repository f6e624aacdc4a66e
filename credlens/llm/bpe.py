"""Byte-level BPE by dynamic programming over prefixes.

Of every byte prefix of a piece exactly one token can be the last of the prefix's encoding: a token that ends there and
may stand after the last token of the prefix before it. Keeping these last tokens gives the encoding by walking back,
makes appending exact (earlier prefixes do not change) and makes an edit cheap (once as many prefixes in a row as the
longest token has bytes agree with the old ones, the rest agrees as well).

Null text counts as empty: no ids. Empty tables give empty results; repeated rows are encoded one by one.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Callable
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, texts_of

#: Entries of a worker's memos of chunks and of pairs of tokens. A full memo becomes the old one, whose entries move to the
#: new one when they are asked for; the old one before goes.
CHUNKS, PAIRS = 120_000, 200_000
#: Bytes of a short piece, and characters of the longest chunk that is kept in a memo.
SHORT, KEPT = 64, 64


def read_ranks(path: str) -> list[bytes]:
    """Tokens by id, from a rank file of base64 tokens and ids. Read on the driver; tasks get the list by broadcast."""
    with open(path, "rb") as f:
        rows = [line.split() for line in f if line.strip()]
    tokens = [b""] * (1 + max(int(i) for _, i in rows))
    for token, i in rows:
        tokens[int(i)] = base64.b64decode(token)
    return tokens


def last_merges(tokens: list[bytes]) -> list[tuple[int, int]]:
    """The two tokens each token was merged from last; a single byte has itself twice.

    A token's bytes are merged by lower ranks alone until two parts are left. A token that can't be reached so has (-1, -1).
    """
    rank = {t: i for i, t in enumerate(tokens) if t}
    out = []
    for i, token in enumerate(tokens):
        parts = [token[k : k + 1] for k in range(len(token))]
        while len(parts) > 2:
            best = min(range(len(parts) - 1), key=lambda k: (rank.get(parts[k] + parts[k + 1], i), k))
            if rank.get(parts[best] + parts[best + 1], i) >= i:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        if len(parts) == 1:
            out.append((i, i))
        elif len(parts) == 2 and all(p in rank for p in parts):
            out.append((rank[parts[0]], rank[parts[1]]))
        else:
            out.append((-1, -1))
    return out


class Memo(dict):
    """A bounded memo; make() gives what isn't there yet."""

    def __init__(self, make: Callable, entries: int):
        super().__init__()
        self.make, self.entries, self.old = make, entries, {}

    def __missing__(self, key):
        found = self.old[key] if key in self.old else self.make(key)
        if len(self) >= self.entries:
            self.old = dict(self)
            self.clear()
        self[key] = found
        return found


class Bpe:
    """Encoder of single pieces: last tokens of prefixes, walked back.

    A trie of reversed tokens tells the longest token that ends at a byte, and each token's longest proper suffix that is a
    token the others. A short piece's prefixes are looked at from its end, those alone that the last tokens found there rest
    on; a long piece's are worked through from its start."""

    def __init__(self, tokens: list[bytes], merges: list[tuple[int, int]]):
        self.tokens, self.merges = tokens, merges
        self.rank = {t: i for i, t in enumerate(tokens) if t and merges[i] != (-1, -1)}
        self.pair = {m: i for i, m in enumerate(merges) if m[0] != i and m != (-1, -1)}
        self.longest = max(map(len, self.rank), default=1)
        self.size = [len(t) for t in tokens]
        # trie: (node << 8 | byte) to node, read from a token's last byte; token: the token of a node, or -1
        self.trie, self.token, self.shorter = {}, [-1], [-1] * len(tokens)
        for t, i in sorted(self.rank.items(), key=lambda x: len(x[0])):
            node, most = 0, -1
            for byte in reversed(t):
                node = self.trie.setdefault(node << 8 | byte, len(self.token))
                if node == len(self.token):
                    self.token.append(-1)
                most = max(most, self.token[node], key=lambda x: self.size[x] if x >= 0 else 0)
            self.token[node], self.shorter[i] = i, most
        #: By left << 32 | right: whether the two tokens' bytes, side by side, encode to just these two tokens.
        self.may_follow = Memo(lambda key: self._holds(key >> 32, key & 0xFFFFFFFF), PAIRS)

    def _holds(self, left: int, right: int) -> bool:
        """Undo the later of the two tokens' merges again and again. A merge across the border that comes earlier than
        what was undone would have been made first; at equal rank the one further left is first."""
        pair, merges = self.pair, self.merges
        undone, on_left = len(self.tokens), True  # the merge undone last, and on which side of the border
        while True:
            across = pair.get((left, right))
            if across is not None and (across < undone or across == undone and not on_left):
                return False
            can_left, can_right = merges[left][0] != left, merges[right][0] != right
            if not can_left and not can_right:
                return True
            if can_left and (not can_right or left > right):
                undone, on_left, left = left, True, merges[left][1]
            else:
                undone, on_left, right = right, False, merges[right][0]

    def longest_ending(self, data: bytes, end: int) -> int:
        """The longest token that data[:end] ends with."""
        get, token, node, found = self.trie.get, self.token, 0, -1
        for at in range(end - 1, -1, -1):
            if (node := get(node << 8 | data[at])) is None:
                break
            if token[node] >= 0:
                found = token[node]
        if found < 0:
            raise ValueError(f"no token ends at byte {end}: the vocabulary lacks a byte")
        return found

    def extend(self, data: bytes, last: list[int]) -> None:
        """Adds the last tokens of the prefixes of data that last doesn't have yet."""
        for end in range(len(last) + 1, len(data) + 1):
            token = self.longest_ending(data, end)
            while (start := end - self.size[token]) and not self.may_follow[last[start - 1] << 32 | token]:
                token = self.shorter[token]
            last.append(token)

    def last_token(self, data: bytes, end: int, last: dict[int, int]) -> int:
        """The last token of data[:end]; last: those of prefixes that have been looked at."""
        token = self.longest_ending(data, end)
        while start := end - self.size[token]:
            before = last[start] if start in last else self.last_token(data, start, last)
            if self.may_follow[before << 32 | token]:
                break
            token = self.shorter[token]
        last[end] = token
        return token

    def walk(self, last: list[int]) -> list[int]:
        ids, end = [], len(last)
        while end:
            ids.append(last[end - 1])
            end -= self.size[ids[-1]]
        return ids[::-1]

    def encode(self, data: bytes) -> list[int]:
        if (whole := self.rank.get(data)) is not None:
            return [whole]
        if len(data) > SHORT:
            last: list[int] = []
            self.extend(data, last)
            return self.walk(last)
        seen: dict[int, int] = {}
        ids, end = [], len(data)
        while end:
            ids.append(token := seen[end] if end in seen else self.last_token(data, end, seen))
            end -= self.size[token]
        ids.reverse()
        return ids


class Encoding:
    """One piece's encoding that can be appended to and edited."""

    def __init__(self, bpe: Bpe, data: bytes = b""):
        self.bpe, self.data, self.last, self.computed = bpe, b"", [], 0
        self.append(data)

    def append(self, more: bytes) -> None:
        self.data += more
        self.computed = len(more)
        self.bpe.extend(self.data, self.last)

    def replace(self, start: int, stop: int, new: bytes) -> None:
        """Puts new in place of data[start:stop]. Prefixes are encoded anew from start until they agree with the old ones
        over as many bytes as the longest token has; what follows is kept."""
        old, shift = self.last, start + len(new) - stop
        self.data = self.data[:start] + new + self.data[stop:]
        last, agreed, self.computed = old[:start], 0, 0
        while len(last) < len(self.data):
            self.bpe.extend(self.data[: len(last) + 1], last)
            self.computed += 1
            at = len(last) - shift
            agreed = agreed + 1 if len(last) > start + len(new) and last[-1] == old[at - 1] else 0
            if agreed >= self.bpe.longest:
                last += old[at:]
        self.last = last

    def ids(self) -> list[int]:
        return self.bpe.walk(self.last)


class TextEncoder:
    """Whole texts to ids. With public_tokenizers.PATTERN a space after a non-space always starts a match, so that texts fall
    apart there without the pattern, and ASCII letters after it are one match; where white space stands in runs of several
    kinds, or with any other pattern, the pattern splits the text itself."""

    RUNS = regex.compile(r"\s (?!\S)")

    def __init__(self, bpe: Bpe, pattern: str):
        self.bpe, self.find, self.at_spaces = bpe, regex.compile(pattern).findall, pattern == public_tokenizers.PATTERN
        self.chunks = Memo(self.chunk, CHUNKS)
        self.packers = [struct.Struct(f"<{n}I").pack for n in range(SHORT + 1)]

    def piece(self, piece: str) -> bytes:
        ids = self.bpe.encode(piece.encode())
        return self.packers[len(ids)](*ids) if len(ids) <= SHORT else struct.pack(f"<{len(ids)}I", *ids)

    def pieces(self, text: str) -> bytes:
        return b"".join(map(self.piece, self.find(text)))

    def chunk(self, chunk: str) -> bytes:
        """A space and what follows up to the next one."""
        if chunk.isascii() and chunk.isalpha():
            return self.piece(" " + chunk)
        first, *rest = self.find(" " + chunk)
        if rest and first[0] == " " and len(first) <= KEPT:  # a word with something behind it: the word may be known
            return self.chunks[first[1:]] + b"".join(map(self.piece, rest))
        return self.piece(first) + b"".join(map(self.piece, rest))

    def __call__(self, text: str) -> bytes:
        if not self.at_spaces or self.RUNS.search(text):
            return self.pieces(text)
        head, *rest = text.split(" ")
        if max(map(len, rest), default=0) > KEPT:
            return self.pieces(head) + b"".join([self.chunks[c] if len(c) <= KEPT else self.chunk(c) for c in rest])
        return self.pieces(head) + b"".join(map(self.chunks.__getitem__, rest))


@cache
def _vocabulary(path: str) -> tuple[list[bytes], list[tuple[int, int]]]:
    tokens = read_ranks(path)
    return tokens, last_merges(tokens)


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, decode: bool = False) -> DataFrame:
    """doc_id, ids (binary: 32-bit little-endian) and n_tokens of each whole text, and if asked for decoded (binary: the bytes
    that the ids stand for); each match of pattern is encoded by itself and no special token is known. Row for row, without
    a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(_vocabulary(ranks_path))

    def make():
        encoder, decoder = TextEncoder(Bpe(*shared.value), pattern), Decoder(shared.value[0])

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = pa.array([encoder(t.as_py()) for t in batch.column("text")], pa.binary())
            columns = [batch.column("doc_id"), ids, pc.divide(pc.binary_length(ids), 4).cast(pa.int64())]
            return pa.RecordBatch.from_arrays([*columns, decoder(ids)] if decode else columns, names)

        return one

    schema = "doc_id long, ids binary, n_tokens long" + (", decoded binary" if decode else "")
    names = [x.split()[0] for x in schema.split(", ")]
    return map_batches(texts_of(docs), schema, make)


class Decoder:
    """Ids to bytes, for a column at once. Ids that no token has raise an error."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = pa.array(tokens, pa.large_binary())

    def __call__(self, ids: pa.Array) -> pa.Array:
        sizes = np.asarray(pc.binary_length(ids.fill_null(b"")), np.int64) // 4
        tokens = self.tokens.take(pa.array(np.frombuffer(b"".join(ids.fill_null(b"").to_pylist()), "<u4")))
        ends = np.frombuffer(tokens.buffers()[1], np.int64)[: len(tokens) + 1] if len(tokens) else np.zeros(1, np.int64)
        places = ends[np.concatenate([[0], np.cumsum(sizes)])].astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(places.tobytes()), tokens.buffers()[2] or pa.py_buffer(b"")])


def decode_documents(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id, ids, n_tokens and decoded (binary: the bytes that the ids stand for). Null ids stand for nothing."""
    shared = encoded.sparkSession.sparkContext.broadcast(_vocabulary(ranks_path)[0])

    def make():
        decoder = Decoder(shared.value)
        return lambda batch: pa.RecordBatch.from_arrays([*batch.columns, decoder(batch.column("ids"))], [*batch.schema.names, "decoded"])

    return map_batches(encoded.select("doc_id", "ids", "n_tokens"), "doc_id long, ids binary, n_tokens long, decoded binary", make)


def round_trip(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """The digests of ids and of the bytes decoded from them, by document; encoded and decoded in one pass."""
    both = encode_documents(docs, ranks_path, pattern, decode=True)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
