"""Token counts of several tokenizers over the same texts, for comparison by category.

A tokenizer is named by what a worker needs to load it: a ``tokenizer.json``, a rank file with its
pattern, a sentencepiece model, or a merge table of this package. Loading happens once per worker;
counting is one map over the texts, whatever the number of tokenizers.
"""

from __future__ import annotations

import base64
import time
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.operators.evaluate import chars_per_token


class Loader(NamedTuple):
    kind: str  # hf, ranks or piece
    path: str
    pattern: str = ""


def load(spec: Loader) -> tuple[Callable[[str], int], int]:
    """(text -> number of tokens, vocabulary size); special strings in texts are ordinary text."""
    if spec.kind == "hf":
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(spec.path)
        t.encode_special_tokens = True
        return lambda x: len(t.encode(x, add_special_tokens=False).ids), t.get_vocab_size()
    if spec.kind == "ranks":
        import tiktoken

        with open(spec.path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        e = tiktoken.Encoding("ranks", pat_str=spec.pattern, mergeable_ranks=ranks, special_tokens={})
        return lambda x: len(e.encode_ordinary(x)), len(ranks)
    if spec.kind == "piece":
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=spec.path)
        return lambda x: len(p.encode(x, num_threads=1)), p.get_piece_size()
    raise ValueError(f"unknown kind of tokenizer {spec.kind!r}")


_LOADED: dict[Loader, tuple[Callable[[str], int], int]] = {}


def _count(loaders: dict[str, Loader]):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, spec in loaders.items():
            if spec not in _LOADED:
                _LOADED[spec] = load(spec)
        for b in batches:
            texts, category = b.column(1).to_pylist(), b.column(0)
            for name, spec in loaders.items():
                count, size = _LOADED[spec]
                begun = time.perf_counter()
                tokens = [count(t) for t in texts]
                each = (time.perf_counter() - begun) / max(1, len(texts))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(texts), pa.string()), pa.array([size] * len(texts), pa.int32()), category, pa.array([len(t) for t in texts], pa.int64()), pa.array(tokens, pa.int64()), pa.array([each] * len(texts))],
                    names=["tokenizer", "vocab_size", "category", "n_chars", "n_tokens", "seconds"],
                )

    return go


def compare(df: DataFrame, category: str, text: str, loaders: dict[str, Loader], most_chars: int | None = None) -> DataFrame:
    """``tokenizer, vocab_size, category, n_chars, n_tokens, chars_per_tok, encode_seconds`` per tokenizer and category.

    ``most_chars`` cuts each text, for scorers that take no longer ones; null texts don't count.
    """
    value = F.substring(text, 1, most_chars) if most_chars else F.col(text)
    rows = df.where(F.col(text).isNotNull()).select(F.col(category).cast("string").alias("category"), value.alias("text"))
    counted = rows.mapInArrow(_count(loaders), "tokenizer string, vocab_size int, category string, n_chars long, n_tokens long, seconds double")
    sums = counted.groupBy("tokenizer", "vocab_size", "category").agg(F.sum("n_chars").alias("n_chars"), F.sum("n_tokens").alias("n_tokens"), F.sum("seconds").alias("encode_seconds"))
    return sums.select("tokenizer", "vocab_size", "category", "n_chars", "n_tokens", chars_per_token(F.col("n_chars"), F.col("n_tokens")).alias("chars_per_tok"), "encode_seconds")
