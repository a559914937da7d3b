"""Check a written tokenizer on texts: round trips, the first difference of failures, whitespace, specials.

The tokenizer is broadcast as the text of its ``tokenizer.json``, whose size is that of the vocabulary; texts are
encoded on the executors, and the driver gets sums and at most ``examples`` failures.

Defined results: null texts don't count; an empty text passes; special strings inside texts are encoded as specials.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.operators.evaluate import first_difference

# Runs of white space that code begins with.
WHITESPACE = ["    ", "        ", "\t", "\n    ", "\n        ", "\n\t", "\n\n"]
_LOADED: dict[int, object] = {}


def _tokenizer(content: str):
    from tokenizers import Tokenizer

    key = hash(content)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Tokenizer.from_str(content)
    return _LOADED[key]


def _round_trip(content):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _tokenizer(content.value)
        for b in batches:
            texts = b.column(0).to_pylist()
            found = [t.encode(x, add_special_tokens=False).ids for x in texts]
            back = [t.decode(ids, skip_special_tokens=False) for ids in found]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(back, pa.string()), pa.array([len(ids) for ids in found], pa.int64())], names=["text", "back", "n_tokens"])

    return go


def round_trips(df: DataFrame, text: str, content: str) -> DataFrame:
    """``text, back, n_tokens`` of every text that isn't null."""
    shared = df.sparkSession.sparkContext.broadcast(content)
    return df.where(F.col(text).isNotNull()).select(F.col(text).alias("text")).mapInArrow(_round_trip(shared), "text string, back string, n_tokens long")


def report(df: DataFrame, text: str, content: str, examples: int = 5) -> dict:
    """What a tokenizer does to the texts, and to white space and its own specials."""
    rows = round_trips(df, text, content)
    ok = F.col("text") == F.col("back")
    sums = rows.agg(F.count("*").alias("texts"), F.count_if(ok).alias("passed"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n_bytes"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n_chars"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n_tokens")).first().asDict()
    failures = []
    if sums["passed"] < sums["texts"]:
        found = rows.where(~ok).select("text", "back", first_difference(F.col("text"), F.col("back")).alias("at")).limit(examples).collect()
        failures = [{"at": r["at"], "text": r["text"][max(0, r["at"] - 10) : r["at"] + 10], "back": r["back"][max(0, r["at"] - 10) : r["at"] + 10]} for r in found]
    t = _tokenizer(content)
    specials = [x["content"] for x in json.loads(content).get("added_tokens", [])]
    one = lambda x: len(t.encode(x, add_special_tokens=False).ids)
    return sums | {
        "chars_per_token": sums["n_chars"] / sums["n_tokens"] if sums["n_tokens"] else 0.0, "failures": failures, "vocab_size": t.get_vocab_size(),
        "whitespace": {w: one(w) for w in WHITESPACE}, "specials": {s: one(s) for s in specials},
    }
