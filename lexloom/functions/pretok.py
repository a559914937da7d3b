"""Pre-tokenizers as Column builders: text in, ARRAY<STRING> of chunks out, all inside the JVM."""

from __future__ import annotations

from typing import NamedTuple, Protocol

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the default pattern. "(?U)" gives Java's classes their Unicode meaning.
GPT4_PATTERN = r"'(?i:[sdmt]|ll|ve|re)|[^\r\n\p{L}\p{N}]?+\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]++[\r\n]*|\s*[\r\n]|\s+(?!\S)|\s+"


class PreTokenizer(Protocol):
    def __call__(self, text: Column) -> Column: ...


def by_regex(pattern: str) -> PreTokenizer:
    """All non-overlapping matches; unmatched text is dropped, and so are empty matches."""
    return lambda text: F.filter(F.regexp_extract_all(text, F.lit("(?U)" + pattern), F.lit(0)), lambda c: c != "")


def digits(text: Column) -> Column:
    """Each ASCII digit by itself, the runs between them whole."""
    return F.regexp_extract_all(text, F.lit("(?s)[0-9]|[^0-9]+"), F.lit(0))


def sequence(*steps: PreTokenizer) -> PreTokenizer:
    """Each step splits the chunks of the one before; no step leaves the text as it is."""

    def run(text: Column) -> Column:
        if not steps:
            return F.array(text)
        chunks = steps[0](text)
        for step in steps[1:]:
            chunks = F.flatten(F.transform(chunks, step))
        return chunks

    return run


class Spec(NamedTuple):
    build: PreTokenizer
    pattern: str
    canonical: str
    splits_digits: bool


def parse_spec(spec: str) -> Spec:
    """``gpt4``, ``gpt4+digits``, ``regex:<pattern>`` or ``regex+digits:<pattern>``."""
    kind, colon, pattern = spec.partition(":")
    if not colon and kind in ("gpt4", "gpt4+digits"):
        pattern = GPT4_PATTERN
    elif not (colon and kind in ("regex", "regex+digits")):
        raise ValueError(f"can't read the pre-tokenizer {spec!r}: write gpt4 or regex:PATTERN, with +digits before the colon to part digits")
    split = kind.endswith("+digits")
    return Spec(sequence(by_regex(pattern), digits) if split else by_regex(pattern), pattern, spec, split)


def resolve_spec(pre_tokenizer: str | None = None, pattern: str | None = None, default: str = "gpt4") -> Spec:
    if pre_tokenizer is not None and pattern is not None:
        raise ValueError("pass either pattern or pre_tokenizer, not both")
    return parse_spec(f"regex:{pattern}" if pattern is not None else pre_tokenizer or default)
