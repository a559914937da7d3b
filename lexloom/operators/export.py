"""Write a trained tokenizer in common file formats. All tables here are as small as the vocabulary."""

from __future__ import annotations

import base64
import csv
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions.bytetext import byte_alphabet
from lexloom.functions.specials import SpecialTokens
from lexloom.operators.merges import Merge, token_bytes


def ranks(merges: list[Merge]) -> list[tuple[bytes, int]]:
    """(token bytes, id) in id order; equal bytes under two ids can't be exported and fail."""
    names = token_bytes(merges)
    if len(set(names)) != len(names):
        raise ValueError("two tokens have the same bytes")
    return [(b, i) for i, b in enumerate(names)]


def rank_table(spark: SparkSession, merges: list[Merge]) -> DataFrame:
    return spark.createDataFrame([(bytearray(b), i) for b, i in ranks(merges)], "token binary, id int")


def rank_lines(table: DataFrame) -> DataFrame:
    return table.select("id", F.concat_ws(" ", F.base64("token"), F.col("id").cast("string")).alias("line"))


def printable(token: bytes) -> str:
    letters = byte_alphabet()
    return "".join(letters[b] for b in token)


def tokenizer_json(merges: list[Merge], pattern: str, specials: SpecialTokens, split_digits: bool) -> dict:
    """The content of ``tokenizer.json``: ids as trained, specials at the end."""
    names = [printable(b) for b, _ in ranks(merges)]
    special_ids = specials.ids(256 + len(merges))
    vocab = {n: i for i, n in enumerate(names)}
    if clash := set(vocab) & set(special_ids):
        raise ValueError(f"special tokens equal to ordinary ones: {sorted(clash)}")
    # The keys and settings of the file format.
    steps = [{"type": "Split", "pattern": {"Regex": pattern}, "behavior": "Isolated", "invert": False}]
    if split_digits:
        steps.append({"type": "Digits", "individual_digits": True})
    steps.append({"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False})
    flags = {"single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True}
    nothing = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix")
    return {
        "version": "1.0", "truncation": None, "padding": None,
        "added_tokens": [{"id": i, "content": t, **flags} for t, i in special_ids.items()],
        "normalizer": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": steps}, "post_processor": None,
        "decoder": {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True},
        "model": {"type": "BPE", **dict.fromkeys(nothing), "fuse_unk": False, "byte_fallback": False, "ignore_merges": False, "vocab": vocab | special_ids, "merges": [[names[m.left_id], names[m.right_id]] for m in merges]},
    }


def write_huggingface(folder: str, merges: list[Merge], pattern: str, specials: SpecialTokens, split_digits: bool, config: bool = True) -> None:
    """``split_digits=True`` whatever the pipeline was gives the files other exporters of this format write."""
    out = Path(folder)
    out.mkdir(parents=True, exist_ok=True)
    (out / "tokenizer.json").write_text(json.dumps(tokenizer_json(merges, pattern, specials, split_digits), indent=2, ensure_ascii=False), encoding="utf-8")
    if config:
        # The settings that loaders of this format expect.
        (out / "tokenizer_config.json").write_text(json.dumps({"backend": "tokenizers", "model_max_length": 1e30, "tokenizer_class": "TokenizersBackend"}, indent=2), encoding="utf-8")


def write_tiktoken(folder: str, merges: list[Merge], pattern: str, specials: SpecialTokens) -> None:
    out = Path(folder)
    out.mkdir(parents=True, exist_ok=True)
    (out / "tiktoken.bpe").write_text("".join(f"{base64.b64encode(b).decode()} {i}\n" for b, i in ranks(merges)))
    (out / "tiktoken.json").write_text(json.dumps({"pattern": pattern, "special_tokens": specials.ids(256 + len(merges))}, indent=2, ensure_ascii=False), encoding="utf-8")


def parse_formats(text: str) -> set[str]:
    known = {"hf": "hf", "huggingface": "hf", "tiktoken": "tiktoken"}
    names = [x.strip().lower() for x in text.split(",") if x.strip()]
    if unknown := [x for x in names if x not in known]:
        raise ValueError(f"files can't be written as {', '.join(unknown)}, only as {', '.join(known)}")
    if not names:
        raise ValueError("no format is named")
    return {known[x] for x in names}


def write_csv(columns: list[str], rows: list[tuple], path: str) -> None:
    """A report as one CSV file with header."""
    with open(path, "w", encoding="utf-8", newline="") as f:
        out = csv.writer(f)
        out.writerow(columns)
        out.writerows(rows)


def latex_table(columns: list[str], rows: list[tuple]) -> str:
    """A report as a LaTeX tabular; numbers are right-aligned."""
    escape = lambda x: "" if x is None else "".join({"&": "\\&", "%": "\\%", "_": "\\_", "#": "\\#", "$": "\\$"}.get(c, c) for c in (f"{x:.3f}" if isinstance(x, float) else str(x)))
    align = "".join("r" if all(isinstance(r[k], (int, float)) or r[k] is None for r in rows) and rows else "l" for k in range(len(columns)))
    body = "".join(" & ".join(map(escape, r)) + " \\\\\n" for r in rows)
    return f"\\begin{{tabular}}{{{align}}}\n\\toprule\n" + " & ".join(map(escape, columns)) + " \\\\\n\\midrule\n" + body + "\\bottomrule\n\\end{tabular}\n"
