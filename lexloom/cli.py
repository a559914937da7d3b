"""Command line: ``python -m lexloom.cli train ...``, ``validate ...`` and ``compare ...``."""

from __future__ import annotations

import argparse
import logging
import os
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lexloom.functions.bytetext import format_bytes, parse_size
from lexloom.functions.pretok import parse_spec
from lexloom.functions.specials import SpecialTokens
from lexloom.memory import MemoryMonitor
from lexloom.operators import compare, evaluate, export, validate
from lexloom.operators.export import parse_formats
from lexloom.operators.merges import parse_mode
from lexloom.session import discard, materialize, ship
from lexloom.sources.text import category_folders, from_lines, tokenizer_folders
from lexloom.tokenizer import Tokenizer


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lexloom")
    sub = p.add_subparsers(dest="command", required=True)
    t = sub.add_parser("train", help="count chunks of files and train merges")
    t.add_argument("--files", nargs="+", default=[])
    t.add_argument("--parquet", nargs="+", default=[], help="tables to read instead of line files")
    t.add_argument("--parquet-column", default="text")
    t.add_argument("--vocab-size", type=int)
    t.add_argument("--pre-tokenizer", default="gpt4+digits")
    t.add_argument("--special-tokens", nargs="+", default=[])
    t.add_argument("--special-preset")
    t.add_argument("--reserve", type=int, default=0)
    t.add_argument("--min-freq", type=int, default=2)
    t.add_argument("--merge-mode", default="auto")
    t.add_argument("--ram-limit")
    t.add_argument("--threads", type=int)
    t.add_argument("--format", default="hf,tiktoken")
    t.add_argument("--agg-file")
    t.add_argument("--output")
    t.add_argument("--buffer-size", type=int, default=8192, help="accepted for compatibility; reading is partitioned")
    t.add_argument("-v", "--verbose", action="store_true")
    v = sub.add_parser("validate", help="check a tokenizer's files and encode test files")
    v.add_argument("--tokenizer", required=True)
    v.add_argument("--test-files", nargs="+", default=[])
    v.add_argument("--check", action="store_true", help="encode and decode every line, too, and report what isn't as it should be")
    c = sub.add_parser("compare", help="compare the tokenizers of a folder on texts by category")
    c.add_argument("--tokenizers", required=True, help="folder with a folder per tokenizer")
    c.add_argument("--texts", required=True, help="folder with a folder of files per category")
    c.add_argument("--own", nargs="*", default=[], help="names that come first in the report")
    c.add_argument("--output", required=True)
    return p


def specials_of(args: argparse.Namespace) -> SpecialTokens:
    if args.special_tokens and args.special_preset:
        raise ValueError("--special-tokens and --special-preset exclude each other")
    out = SpecialTokens.preset(args.special_preset) if args.special_preset else SpecialTokens(args.special_tokens)
    out.add_reserved(args.reserve)
    return out


def session(threads: int | None) -> SparkSession:
    n = threads or max(1, int((os.cpu_count() or 1) * 0.8))
    return SparkSession.getActiveSession() or SparkSession.builder.master(os.environ.get("SPARK_MASTER", f"local[{n}]")).config("spark.ui.enabled", "false").getOrCreate()


def run_train(args: argparse.Namespace) -> int:
    formats, specials = parse_formats(args.format), specials_of(args)
    parse_spec(args.pre_tokenizer)
    parse_mode(args.merge_mode)
    limit = None
    if args.ram_limit is not None and (limit := parse_size(args.ram_limit)) is None:
        raise ValueError(f"can't read --ram-limit {args.ram_limit!r}")
    given = bool(args.files or args.parquet)
    if not given and not args.agg_file:
        raise ValueError("give --files or --parquet, or an existing --agg-file")
    if args.vocab_size is not None:
        if args.vocab_size < 256:
            raise ValueError("--vocab-size must be at least 256")
        if not args.output:
            raise ValueError("--vocab-size needs --output, a folder for the tokenizer")
    elif not args.agg_file:
        raise ValueError("neither --vocab-size nor --agg-file says what to make")
    spark = session(args.threads)
    tok = Tokenizer(spark)
    tok.on_round = (lambda done, of: print(f"{done} of {of} merges", file=sys.stderr)) if args.verbose else None
    with MemoryMonitor(limit) as monitor:
        if given:
            if args.parquet:
                df = spark.read.parquet(*args.parquet).select(F.col(args.parquet_column).alias("text"))
            else:
                df = from_lines(spark, args.files)
            if args.agg_file:
                stats = tok.aggregate_dataframe(df, "text", args.agg_file, None, args.pre_tokenizer, specials.tokens)
                print(f"counted {stats['unique_chunks']} distinct chunks of {format_bytes(stats['total_bytes'])}")
        if args.vocab_size is None:
            return 0
        if args.agg_file:
            # the counts' own pipeline and specials hold, whatever the flags say
            tok.train_from_aggregate(args.agg_file, args.vocab_size, args.min_freq, args.merge_mode)
        else:
            tok.train_from_dataframe(df, "text", args.vocab_size, args.min_freq, None, args.pre_tokenizer, specials.tokens, args.merge_mode)
    if "hf" in formats:
        tok.save_huggingface(args.output)
    if "tiktoken" in formats:
        tok.save_tiktoken(args.output)
    print(f"trained {len(tok.merges)} merges; peak memory of the driver {format_bytes(monitor.peak)}")
    return 0


def run_validate(args: argparse.Namespace) -> int:
    path = Path(args.tokenizer) / "tokenizer.json"
    if not path.exists():
        raise ValueError(f"{path} isn't there")
    spark = session(None)
    ship(spark)
    lines = from_lines(spark, args.test_files)
    total = lines.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()
    print(f"{path}: there; test files: {total['n']} lines, {format_bytes(total['b'])}")
    if not args.check:
        return 0
    got = validate.report(lines, "text", path.read_text(encoding="utf-8"))
    print(f"round trip: {got['passed']} of {got['texts']} lines, {got['chars_per_token']:.3f} characters a token, {got['vocab_size']} tokens in the vocabulary")
    for f in got["failures"]:
        print(f"  differs at character {f['at']}: {f['text']!r} came back as {f['back']!r}")
    for title, found in (("white space", got["whitespace"]), ("specials", got["specials"])):
        print(f"{title}: {sum(n == 1 for n in found.values())} of {len(found)} are one token" + "".join(f"; {k!r}: {n}" for k, n in found.items() if n != 1))
    return int(got["passed"] < got["texts"] or any(n != 1 for n in got["specials"].values()))


def run_compare(args: argparse.Namespace) -> int:
    found = tokenizer_folders(args.tokenizers)
    if not found:
        raise ValueError(f"no tokenizers under {args.tokenizers}")
    spark = session(None)
    ship(spark)
    texts = category_folders(spark, args.texts)
    rows = materialize(compare.compare(texts, "category", "text", {t["name"]: compare.Loader("hf", os.path.join(t["path"], "tokenizer.json")) for t in found}))
    per = rows.withColumnRenamed("chars_per_tok", "chars_per_token")
    order = [r["tokenizer"] for r in evaluate.macro(per).withColumn("own", F.col("tokenizer").isin(args.own)).orderBy(*evaluate.report_order(F.col("own"))).collect()]
    macro = {r["tokenizer"]: r["macro_chars_per_token"] for r in evaluate.macro(per).collect()}
    # tokenizers times categories rows
    listed = sorted((tuple(r) for r in rows.select("tokenizer", "vocab_size", "category", "n_chars", "n_tokens", "chars_per_tok", "encode_seconds").collect()), key=lambda r: (order.index(r[0]) if r[0] in order else len(order), r[2]))
    Path(args.output).mkdir(parents=True, exist_ok=True)
    export.write_csv(["tokenizer", "vocab_size", "category", "n_chars", "n_tokens", "chars_per_tok", "encode_seconds"], listed, f"{args.output}/results.csv")
    categories = sorted({r[2] for r in listed})
    cell = {(r[0], r[2]): r[5] for r in listed}
    table = [(t, *(cell.get((t, c)) for c in categories), macro[t]) for t in order]
    Path(f"{args.output}/results.tex").write_text(export.latex_table(["tokenizer", *categories, "macro"], table), encoding="utf-8")
    for t in order:
        print(f"{t}: {macro[t]:.4f} characters a token")
    discard(rows)
    return 0


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    logging.basicConfig(level=logging.INFO if getattr(args, "verbose", False) else logging.WARNING)
    try:
        return {"train": run_train, "validate": run_validate, "compare": run_compare}[args.command](args)
    except ValueError as e:
        print(f"error: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
