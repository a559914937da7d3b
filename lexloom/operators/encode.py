"""Encode and decode with a trained merge table.

Encoding is one map without shuffle: the JVM splits a row into segments and chunks, a worker turns
each distinct chunk into ids once and keeps it (a bounded cache). Decoding joins bytes in a map. The
merge table is as large as the vocabulary, which bounds what is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.functions.pretok import PreTokenizer
from lexloom.functions.specials import SpecialTokens, segments
from lexloom.operators.merges import Merge, token_bytes

CACHE = 200_000


class ChunkEncoder(dict):
    """chunk -> ids: the lowest merge id first, leftmost first."""

    def __init__(self, merges: list[Merge]):
        super().__init__()
        self.ids = {(m.left_id, m.right_id): m.new_id for m in merges}

    def merge(self, raw: bytes) -> list[int]:
        ids, known = list(raw), self.ids
        if len(ids) > 64:
            return self.merge_long(ids)
        while len(ids) > 1:
            new = min((known.get(p, 1 << 30) for p in zip(ids, ids[1:])))
            if new == 1 << 30:
                break
            ids = self.replaced(ids, new)
        return ids

    def replaced(self, ids: list[int], new: int) -> list[int]:
        out, i, n, known = [], 0, len(ids), self.ids
        while i < n:
            if i + 1 < n and known.get((ids[i], ids[i + 1])) == new:
                out.append(new)
                i += 2
            else:
                out.append(ids[i])
                i += 1
        return out

    def merge_long(self, ids: list[int]) -> list[int]:
        """The same by a heap over linked positions: n log n for chunks of any length."""
        import heapq

        n, known = len(ids), self.ids
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(known[p], i) for i, p in enumerate(zip(ids, ids[1:])) if p in known]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            new, i = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or known.get((ids[i], ids[j])) != new:
                continue
            ids[i], alive[j] = new, False
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
                if (m := known.get((new, ids[after[j]]))) is not None:
                    heapq.heappush(heap, (m, i))
            if before[i] >= 0 and (m := known.get((ids[before[i]], new))) is not None:
                heapq.heappush(heap, (m, before[i]))
        return [x for x, a in zip(ids, alive) if a]

    def __missing__(self, chunk: str) -> list[int]:
        if len(self) > CACHE:
            self.clear()
        ids = self.merge(chunk.encode())
        if len(chunk) < 256:
            self[chunk] = ids
        return ids


def laid_out(pieces: list, index: np.ndarray, dtype) -> tuple[np.ndarray, np.ndarray]:
    """The arrays ``pieces[i] for i in index`` end to end, and where each ends."""
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    flat = np.concatenate([np.asarray(x, dtype) for x in pieces]) if len(pieces) else np.zeros(0, dtype)
    first = np.cumsum(sizes) - sizes
    ends = np.cumsum(sizes[index])
    at = np.repeat(first[index] - (ends - sizes[index]), sizes[index]) + np.arange(ends[-1] if len(ends) else 0)
    return flat[at], ends


def _encode(table, special_ids: dict[str, int]):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = ChunkEncoder(table.value)
        for b in batches:
            for k in range(0, b.num_rows, 2000):
                part = b.slice(k, 2000)
                parts = part.column(1)
                words = parts.flatten().dictionary_encode()
                # no ordinary chunk can be a special: those are cut out of texts before
                pieces = [[special_ids[w]] if w in special_ids else look[w] for w in words.dictionary.to_pylist()]
                flat, ends = laid_out(pieces, words.indices.to_numpy(), np.int32)
                offsets = parts.offsets.to_numpy() - parts.offsets[0].as_py()
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends])[offsets].astype(np.int32)), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=["key", "ids"])

    return go


def encode(df: DataFrame, key: str, text: str, merges: list[Merge], pretok: PreTokenizer, specials: SpecialTokens | None = None) -> DataFrame:
    """``key, ids``; null and empty texts have no ids."""
    specials = specials or SpecialTokens()
    parts = F.flatten(F.transform(segments(F.col(text), specials), lambda s: F.when(s["special"], F.array(s["seg"])).otherwise(pretok(s["seg"]))))
    table = df.sparkSession.sparkContext.broadcast(merges)
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("key"), F.coalesce(parts, F.array().cast("array<string>")).alias("parts"))
    return rows.mapInArrow(_encode(table, specials.ids(256 + len(merges))), f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def tokens(encoded: DataFrame, key: str) -> DataFrame:
    """``key, pos, token_id``: one row per id."""
    return encoded.select(key, F.posexplode("ids").alias("pos", "token_id"))


def decode_ids(ids: list[int], names: list[bytes]) -> str:
    for i in ids:
        if not 0 <= i < len(names):
            raise ValueError(f"Unknown token id: {i}")
    return b"".join([names[i] for i in ids]).decode("utf-8")


def _decode(names):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [np.frombuffer(n, np.uint8) for n in names.value]
        for b in batches:
            for k in range(0, b.num_rows, 2000):
                part = b.slice(k, 2000)
                lists = part.column(1)
                ids = lists.flatten()
                if ids.null_count:
                    raise ValueError("Unknown token id: None")
                ids = ids.to_numpy()
                wrong = ids[(ids < 0) | (ids >= len(known))]
                if len(wrong):
                    raise ValueError(f"Unknown token id: {wrong[0]}")
                flat, ends = laid_out(known, ids, np.uint8)
                # null lists have no ids of their own; they come back as null texts
                rows = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy())])
                offsets = np.concatenate([[0], ends])[rows]
                raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(flat)])
                texts = raw.cast(pa.large_string()).cast(pa.string())  # fails on bytes that aren't UTF-8
                texts = pa.compute.if_else(lists.is_valid(), texts, pa.scalar(None, pa.string()))
                yield pa.RecordBatch.from_arrays([part.column(0), texts], names=["key", "text"])

    return go


def decode(df: DataFrame, key: str, ids: str, merges: list[Merge], specials: SpecialTokens | None = None) -> DataFrame:
    """``key, text``. Unknown ids and bytes that aren't UTF-8 fail; specials are known only if given."""
    names = token_bytes(merges) + [t.encode() for t in (specials.tokens if specials else [])]
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("key"), F.col(ids).cast("array<int>").alias("ids"))
    return rows.mapInArrow(_decode(df.sparkSession.sparkContext.broadcast(names)), f"key {kind}, text string").withColumnRenamed("key", key)
