"""Byte-pair encoding by prefix dynamic programming.

For every prefix of a piece of text there is exactly one token that can end the encoding of that
prefix. ``PrefixEncoder`` stores that token for each byte position. It is found by walking a trie of
token bytes forward from each position and asking whether the next token may follow the last token
of the prefix (``Vocabulary.may_follow``: would the merges, applied to the two tokens' bytes alone,
give back those two tokens). The stored tokens give the encoding by walking back from the end;
appending bytes only adds positions, and an edit keeps every position before it and stops as soon
as the new positions agree with the old ones for as long as the longest token is.

A text is first cut by the tokenizer's pattern into pieces that no token crosses. Pieces recur, so
a worker keeps the ids of pieces it has met (a bounded cache that changes speed only).

Defined results: null and empty texts have no ids; strings of special tokens inside a text are
ordinary text; lone surrogates can't occur in Spark strings; texts of any length are encoded whole;
repeated rows give repeated rows.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the pattern that cuts texts before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CACHE_PIECES = 400_000
_TOP = 1 << 30


class Vocabulary:
    """Token ranks with what the dynamic program asks of them."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.longest = max(map(len, ranks))
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.single = [ranks.get(bytes([b])) for b in range(256)]
        if None in self.single:
            raise ValueError("the vocabulary must have every byte")
        #: prefix -> may be extended; tokens are looked up in ranks
        self.open = {b[:k] for b in ranks for k in range(1, len(b))}
        self._halves: dict[int, tuple[int, int]] = {}
        self._follows: dict[int, bool] = {}

    @classmethod
    def from_bytes(cls, content: bytes) -> Vocabulary:
        """Of a rank file: a token in base64 and its rank on each line."""
        return cls({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, content.splitlines())})

    def halves(self, token: int) -> tuple[int, int]:
        """The two tokens whose merge makes ``token``; (token, token) for a single byte."""
        got = self._halves.get(token)
        if got is None:
            parts = self.merge(self.bytes_of[token], token)
            got = self._halves[token] = (parts[0], parts[-1]) if len(parts) == 2 else (token, token)
        return got

    def merge(self, piece: bytes, below: int = _TOP) -> list[int]:
        """Plain merging, lowest rank first, with ranks under ``below``; used for short byte strings."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        ranks = self.ranks
        while len(parts) > 1:
            best, at = below, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1], _TOP)
                if r < best:
                    best, at = r, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def may_follow(self, left: int, right: int) -> bool:
        """Whether ``left, right`` is the encoding of their joined bytes."""
        key = left << 32 | right
        known = self._follows.get(key)
        if known is None:
            if len(self._follows) > 2_000_000:
                self._follows.clear()
            known = self._follows[key] = self._stable(left, right)
        return known

    def _stable(self, left: int, right: int) -> bool:
        # Undo merges on either side of the border, the latest first. Each time the two tokens that then touch
        # must have no merge that would have come before the merges already undone.
        ranks, names, limit = self.ranks, self.bytes_of, _TOP
        a, b = left, right
        while True:
            if ranks.get(names[a] + names[b], _TOP) < limit:
                # a merge across the border counts only if it is made of exactly these two tokens
                joined = ranks[names[a] + names[b]]
                if self.halves(joined) == (a, b):
                    return False
            inner, outer = self.halves(a)[1], self.halves(b)[0]
            can_a, can_b = inner != a, outer != b
            if not can_a and not can_b:
                return True
            # of equal ranks the left one was merged first, hence is undone last
            if can_a and (not can_b or a > b):
                limit, a = a, inner
            else:
                limit, b = b + 1, outer


class PrefixEncoder:
    """The unique last token of every prefix of one piece; grows by appending, re-encodes after edits."""

    def __init__(self, vocabulary: Vocabulary, piece: bytes = b""):
        self.v, self.piece = vocabulary, bytearray()
        self.last: list[int] = [-1]  # last[i]: the token that ends the encoding of piece[:i]
        self.append(piece)

    def append(self, more: bytes) -> None:
        # a token that ends inside `more` may begin in front of it
        start = len(self.piece)
        self.piece += more
        self.last += [-1] * len(more)
        self._fill(max(0, start - self.v.longest + 1), start)

    def _fill(self, begin: int, known: int, stop=None) -> None:
        """Find last[i] for every i > known, from tokens that begin at ``begin`` or later."""
        piece, last, v = bytes(self.piece), self.last, self.v
        ranks, opened, may_follow, n, widest = v.ranks, v.open, v.may_follow, len(piece), v.longest
        unset = known + 1  # every position before it has its token
        for i in range(begin, n):
            if i and stop and stop(i):
                return
            while unset <= n and last[unset] >= 0:
                unset += 1
            before = last[i]
            for j in range(max(unset, i + 1), min(n, i + widest) + 1):
                part = piece[i:j]
                if last[j] < 0:
                    token = ranks.get(part)
                    if token is not None and (not i or may_follow(before, token)):
                        last[j] = token
                if part not in opened:
                    break

    def edit(self, at: int, cut: int, put: bytes) -> None:
        """Replace ``cut`` bytes at ``at`` by ``put``; positions after the edit are reused once they agree."""
        tail = self.last[at + cut + 1 :]
        shift = at + len(put)
        self.piece[at : at + cut] = put
        old_end = len(self.piece)
        agreed = 0
        self.last = self.last[: at + 1] + [-1] * (old_end - at)
        last, v = self.last, self.v

        def settled(i: int) -> bool:
            nonlocal agreed
            k = i - shift - 1
            agreed = agreed + 1 if k >= 0 and last[i] == tail[k] else 0
            if agreed >= v.longest:
                last[i + 1 :] = tail[k + 1 :]
                return True
            return False

        self._fill(max(0, at - v.longest + 1), at, settled)

    def ids(self) -> list[int]:
        out, i, names = [], len(self.piece), self.v.bytes_of
        while i > 0:
            t = self.last[i]
            out.append(t)
            i -= len(names[t])
        return out[::-1]


class PieceCache(dict):
    """piece text -> ids, filled through the dynamic program."""

    def __init__(self, v: Vocabulary):
        super().__init__()
        self.v = v

    def __missing__(self, piece: str) -> list[int]:
        if len(self) > CACHE_PIECES:
            self.clear()
        ids = PrefixEncoder(self.v, piece.encode("utf-8", "surrogatepass")).ids()
        if len(piece) < 256:
            self[piece] = ids
        return ids


_CACHES: dict[int, PieceCache] = {}


def encode_texts(texts: list[str | None], cache: PieceCache, pattern: str = PATTERN) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and ids of all texts."""
    find = regex.compile(pattern).findall
    offsets, flat = [0], []
    extend, look = flat.extend, cache.__getitem__
    for t in texts:
        if t:
            for ids in map(look, find(t)):
                extend(ids)
        offsets.append(len(flat))
    return np.array(offsets, np.int32), np.array(flat, np.int32)


def _encode(content, pattern: str):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # one vocabulary and one cache per worker, whatever the number of tasks
        key = hash(content.value)
        if key not in _CACHES:
            _CACHES.clear()
            _CACHES[key] = PieceCache(Vocabulary.from_bytes(content.value))
        for b in batches:
            for k in range(0, b.num_rows, 500):
                part = b.slice(k, 500)
                offsets, flat = encode_texts(part.column(1).to_pylist(), _CACHES[key], pattern)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=["key", "ids"])

    return go


def encode(df: DataFrame, key: str, text: str, path: str, pattern: str = PATTERN) -> DataFrame:
    """``key, ids`` for every row of ``df``; a map without shuffle.

    Only the driver reads the rank file at ``path``; its bytes, as many as the vocabulary has, are broadcast.
    """
    content = df.sparkSession.sparkContext.broadcast(Path(path).read_bytes())
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = df.schema[key].dataType.simpleString()
    return rows.mapInArrow(_encode(content, pattern), f"key {kind}, ids array<int>").withColumnRenamed("key", key)
