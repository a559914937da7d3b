"""Words of many texts at once, as arrays: positions, owners and 64-bit hashes.

Texts are lower-cased, composed (NFC) and laid end to end as code points; a lookup table says which
code points belong to words. Everything after that is array arithmetic, so the cost per word is a
few dozen nanoseconds and no Python object is made per word. Equal words have equal hashes; two
different words share one with probability 2**-64.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np

BLOCK_CHARS = 1_500_000
_ODD = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=4)
def char_table(kind: str) -> np.ndarray:
    """Which BMP code points are in words: ``letters`` or ``word`` (letters, digits and ``_``)."""
    test = str.isalpha if kind == "letters" else lambda c: c.isalnum() or c == "_"
    return np.fromiter((test(chr(c)) for c in range(0x10000)), bool, 0x10000)


@lru_cache(maxsize=1)
def _char_values() -> np.ndarray:
    return np.random.Generator(np.random.PCG64(20)).integers(1, 2**63, 0x10000, dtype=np.uint64) | np.uint64(1)


@lru_cache(maxsize=1)
def _powers() -> list[np.ndarray]:
    return [np.ones(1, np.uint64)]


def powers(n: int) -> np.ndarray:
    held = _powers()
    if len(held[0]) < n:
        base = np.full(max(n, BLOCK_CHARS + 4096), _ODD, np.uint64)
        base[0] = 1
        held[0] = np.multiply.accumulate(base)
    return held[0][:n]


def mix64(h: np.ndarray) -> np.ndarray:
    """Spread every bit of a hash over all bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


class Words(NamedTuple):
    hashes: np.ndarray  # uint64 per word
    starts: np.ndarray  # index of the word's first code point in ``chars``
    ends: np.ndarray
    owner: np.ndarray  # which text
    chars: np.ndarray  # uint32 code points of all texts, a line feed between texts
    offsets: np.ndarray  # where each text begins in chars; one more than texts


def lowered(text: str | None) -> str:
    if not text:
        return ""
    text = text.lower()
    return text if text.isascii() else unicodedata.normalize("NFC", text)


def codepoints(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    chars = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    return chars, offsets


def words(texts: list[str], kind: str) -> Words:
    """``texts`` must be lowered already (or kept as they are, where case matters)."""
    chars, offsets = codepoints(texts)
    table = char_table(kind)
    inside = table[np.minimum(chars, 0xFFFF)]
    high = np.flatnonzero(chars > 0xFFFF)
    if len(high):
        inside = inside.copy()
        inside[high] = [chr(c).isalpha() if kind == "letters" else chr(c).isalnum() for c in chars[high]]
    edge = np.diff(np.concatenate([[False], inside]).view(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    # the last code point is a line feed, hence every word ends
    if not len(starts):
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), none, none, none, chars, offsets)
    values = _char_values()[chars & 0xFFFF]
    if len(high):
        values[high] += chars[high].astype(np.uint64) * np.uint64(0x100000001B3)
    # Horner from the right inside each word: weight of a code point is base ** (distance to the word's start)
    at = np.arange(len(chars)) - np.repeat(np.concatenate([[0], starts]), np.diff(np.concatenate([[0], starts, [len(chars)]])))
    long = int((ends - starts).max())
    weight = powers(max(long, 1))[np.minimum(at, long - 1)]
    values *= weight
    values *= inside
    sums = np.add.reduceat(values, starts)
    hashes = mix64(sums)
    owner = np.searchsorted(offsets, starts, "right") - 1
    return Words(hashes, starts, ends, owner, chars, offsets)


def blocks(texts: list[str | None], limit: int = BLOCK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` characters; a longer text is a range by itself."""
    begin, held = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if held and held + n > limit:
            yield begin, i
            begin, held = i, 0
        held += n
    if begin < len(texts):
        yield begin, len(texts)


def grams(hashes: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words inside one text, and the index of each run's first word."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    last = len(hashes) - n + 1
    at = np.flatnonzero(owner[:last] == owner[n - 1 :])
    h = hashes[at].copy()
    for k in range(1, n):
        h *= np.uint64(0xD6E8FEB86659FD93)
        h += hashes[at + k]
    return mix64(h), at
