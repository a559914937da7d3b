"""Bytes as text: the printable byte alphabet, words of token ids as strings, sizes for people."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def byte_alphabet() -> list[str]:
    """The printable character of each byte: itself where printable, else U+0100 onwards in byte order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, spare = [], 0x100
    for b in range(256):
        out.append(chr(b) if b in plain else chr(spare))
        spare += b not in plain
    return out


def token_char(token_id: int) -> str:
    """A token id as one character, in id order: beyond the byte range, leaving out surrogates."""
    code = token_id + 0x100
    return chr(code if code < 0xD800 else code + 0x800)


def token_id(char: str) -> int:
    code = ord(char)
    return (code if code < 0xD800 else code - 0x800) - 0x100


def to_word(chunk: Column) -> Column:
    """A chunk as a string with one character per byte token."""
    latin = F.decode(F.encode(chunk, "UTF-8"), "ISO-8859-1")
    return F.translate(latin, "".join(map(chr, range(256))), "".join(token_char(b) for b in range(256)))


def parse_size(text: str) -> int | None:
    """``64GB``, ``1.5g``, ``1024``; None if it can't be read, is negative or isn't finite."""
    low = text.strip().lower()
    for unit, factor in (("gb", 1 << 30), ("g", 1 << 30), ("mb", 1 << 20), ("m", 1 << 20), ("kb", 1 << 10), ("k", 1 << 10), ("b", 1)):
        if low.endswith(unit):
            low = low[: -len(unit)]
            break
    else:
        factor = 1
    try:
        n = float(low.strip().replace("_", "x"))
    except ValueError:
        return None
    return int(n * factor) if 0 <= n < float("inf") else None


def format_bytes(n: int) -> str:
    for unit, size in (("GB", 1 << 30), ("MB", 1 << 20), ("KB", 1 << 10)):
        if n >= size:
            return f"{n / size:.2f} {unit}"
    return f"{n} B"


def format_bytes_column(n: Column) -> Column:
    out = F.concat(n.cast("string"), F.lit(" B"))
    for unit, size in (("KB", 1 << 10), ("MB", 1 << 20), ("GB", 1 << 30)):
        out = F.when(n >= size, F.concat(F.format_string("%.2f", F.bround(n / F.lit(float(size)), 2)), F.lit(f" {unit}"))).otherwise(out)
    return out
