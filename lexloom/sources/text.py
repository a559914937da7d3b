"""Sources of text rows: iterables, tables, line files, HTML dumps, category folders, tokenizer folders."""

from __future__ import annotations

import glob
import itertools
import json
import logging
import os
import re
import uuid
from collections.abc import Iterable, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.operators.ordered import byte_budget, running_sum
from lexloom.session import file_system, shared_dir

log = logging.getLogger(__name__)

SEPARATOR = "\n<|endoftext|>\n"


def from_iterable(spark: SparkSession, texts: Iterable[str], buffer_size: int = 8192, part_chars: int = 64 << 20) -> DataFrame:
    """``seq, text`` of any iterable of str; other types raise TypeError, the iterable's errors pass through.

    The driver holds one part of about ``part_chars`` at a time; parts of longer iterables are
    written to the shared folder.
    """
    schema, path, seq = "seq long, text string", None, 0
    rows: list[tuple[int, str]] = []
    held, it = 0, iter(texts)
    while buffer := list(itertools.islice(it, buffer_size)):
        for t in buffer:
            if not isinstance(t, str):
                raise TypeError(f"expected str, got {type(t).__name__}")
            rows.append((seq, t))
            seq, held = seq + 1, held + len(t)
        if held >= part_chars:
            if path is None:
                path = f"{shared_dir(spark)}/rows-{uuid.uuid4().hex}"
                fs, at = file_system(spark, path)
                fs.deleteOnExit(at)
            log.info("%d texts read", seq)
            spark.createDataFrame(rows, schema).write.mode("append").parquet(path)
            rows, held = [], 0
    if path is None:
        return spark.createDataFrame(rows, schema)
    spark.createDataFrame(rows, schema).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def from_lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """``text``: the lines of files, split at line feeds, less one trailing carriage return each.

    Files that don't exist are skipped with a warning, and so are lines that aren't UTF-8. A blank
    line is a row; a lone carriage return stays in its line.
    """
    there = []
    for p in paths:
        fs, at = file_system(spark, p)
        if fs.exists(at):
            there.append(p)
        else:
            log.warning("can't open %s; skipped", p)
    if not there:
        return spark.createDataFrame([], "text string")
    rows = spark.read.option("lineSep", "\n").text(there)  # paths of any file system the executors share
    return rows.where(F.is_valid_utf8("value")).select(F.regexp_replace("value", "\r$", "").alias("text"))


def from_parquet(spark: SparkSession, path: str, text: str, keep: Sequence[str] = (), report: bool = True) -> DataFrame:
    """Only the text column and those to filter by; unreadable files are skipped and, with ``report``, logged one by one."""
    rows = spark.read.option("ignoreCorruptFiles", True).parquet(path)
    if report:
        for name in silent_files(rows, path):
            log.warning("no rows from %s: unreadable or empty; skipped", name)
    return rows.select(text, *keep)


def silent_files(rows: DataFrame, path: str) -> list[str]:
    """Data files under ``path`` from which ``rows`` has no row. Executors read footers only; the driver gets the names that are missing."""
    spark = rows.sparkSession
    fs, at = file_system(spark, path)
    names, it = [], fs.listFiles(at, True)
    while it.hasNext():
        p = it.next().getPath()
        if not p.getName().startswith(("_", ".")):
            names.append((p.getName(), p.toString()))
    seen = rows.select(F.col("_metadata.file_name").alias("name")).distinct()
    return sorted(r["path"] for r in spark.createDataFrame(names, "name string, path string").join(seen, "name", "left_anti").collect())


def html_documents(df: DataFrame, key: str, text: str, least_bytes: int = 100) -> DataFrame:
    """``key, part, html``: dumps cut in front of every doctype, pieces under ``least_bytes`` left out."""
    pieces = df.select(key, F.posexplode(F.split(F.col(text), "(?i)(?=<!doctype)")).alias("part", "html"))
    return pieces.where(F.octet_length("html") >= least_bytes)


def corpus(df: DataFrame, text: str, condition: Column | None = None, least_bytes: int = 100) -> DataFrame:
    """Rows with text that pass a condition on another column and have at least ``least_bytes``."""
    rows = df.where(F.col(text).isNotNull() & (F.octet_length(text) >= least_bytes))
    return rows if condition is None else rows.where(condition)


def seed_condition(seed_filter: str | None, seed: Column) -> Column:
    """``= value`` or ``!= value`` on a column; case and outer blanks don't matter, a null differs from every value."""
    if seed_filter is None or not seed_filter.strip():
        return F.lit(True)
    m = re.fullmatch(r"\s*(!=|<>|==?)\s*['\"]?(.*?)['\"]?\s*", seed_filter)
    if not m:
        raise ValueError(f"can't read the seed filter {seed_filter!r}")
    same = F.coalesce(F.lower(F.trim(seed)) == F.lit(m[2].strip().lower()), F.lit(False))
    return ~same if m[1] in ("!=", "<>") else same


def budgeted(df: DataFrame, text: str, order: Sequence[Column], target_bytes: int, separator: str = SEPARATOR, key: Sequence[str] = ()) -> DataFrame:
    """Rows in order up to a byte target, the separator counted."""
    return byte_budget(df, text, order, target_bytes, separator, key)


class Job(NamedTuple):
    """What a corpus takes of one table: rows whose ``source`` it is (None: all) and that pass the filter, up to a target."""

    name: str
    table: DataFrame
    key: str
    text: str
    target_bytes: int
    source: str | None = None
    seed_filter: str | None = None


def build_corpus(jobs: Sequence[Job], least_bytes: int = 100, separator: str = SEPARATOR, seed: int = 42) -> DataFrame:
    """``job, key, written, text``: every job's rows in shuffled order up to its byte target, each with the separator behind it.

    Only keys and lengths are ordered, those of all jobs together; texts are joined back for the accepted rows.
    A key that occurs twice in a job counts once, with its longer text.
    """
    parts = []
    for j in jobs:
        rows = j.table
        if j.source is not None:
            rows = rows.where(F.lower(F.trim("source")) == j.source.strip().lower())
        if j.seed_filter is not None:
            rows = rows.where(seed_condition(j.seed_filter, F.col("seed_data") if "seed_data" in rows.columns else F.lit(None).cast("string")))
        rows = rows.select(F.lit(j.name).alias("job"), F.col(j.key).cast("long").alias("key"), F.col(j.text).alias("text")).where("key is not null")
        parts.append(corpus(rows, "text", least_bytes=least_bytes))
    rows = reduce(DataFrame.unionByName, parts)
    sizes = rows.groupBy("job", "key").agg(F.max(F.octet_length("text")).alias("n_bytes"))
    placed = running_sum(sizes, F.col("n_bytes") + len(separator.encode()), shuffled_order("key", seed), group="job", name="written")
    targets = F.broadcast(rows.sparkSession.createDataFrame([(j.name, j.target_bytes) for j in jobs], "job string, target long"))  # as many rows as jobs
    kept = placed.join(targets, "job").where("written < target").select("job", "key", "n_bytes", "written")
    texts = rows.withColumn("n_bytes", F.octet_length("text")).join(kept, ["job", "key", "n_bytes"]).dropDuplicates(["job", "key"])
    return separated(texts, "text", separator).select("job", "key", "written", "text")


def write_corpus(rows: DataFrame, path: str) -> DataFrame:
    """Write a corpus as Parquet, a folder per job, and return bytes and rows of each job, counted from what was written."""
    rows.write.mode("overwrite").partitionBy("job").parquet(path)
    written = rows.sparkSession.read.schema("key long, written long, text string, job string").parquet(path)
    return written.groupBy("job").agg(F.count("*").alias("rows"), F.sum(F.octet_length("text")).cast("long").alias("n_bytes"))


def shuffled_order(key: str, seed: int = 42) -> list[Column]:
    """An order that looks random and is the same in every run."""
    return [F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))), F.col(key)]


def separated(df: DataFrame, text: str, separator: str = SEPARATOR) -> DataFrame:
    return df.withColumn(text, F.concat(F.col(text), F.lit(separator)))


def category_layout(df: DataFrame, category: str, order: str, text: str, separator: str = "\n\n") -> DataFrame:
    """Where each text begins in its category's concatenation, in characters, without building it in one place."""
    rows = df.where(F.col(text).isNotNull() & F.col(category).isNotNull())
    sized = rows.select(category, order, (F.length(text) + len(separator)).alias("_chars"))  # no text is moved
    return running_sum(sized, F.col("_chars"), [F.col(order)], group=category, name="begins").drop("_chars")


def category_folders(spark: SparkSession, root: str, skip: Iterable[str] = ("results", ".git", "__pycache__")) -> DataFrame:
    """``category, path, text``: one category per subdirectory, files in path order, bad UTF-8 replaced."""
    skipped, rows = set(skip), []
    for name in sorted(os.listdir(root)):
        folder = os.path.join(root, name)
        if not os.path.isdir(folder) or name in skipped or name.startswith("."):
            continue
        files = sorted(p for p in glob.glob(os.path.join(folder, "**", "*"), recursive=True) if os.path.isfile(p))
        rows += [(name, p) for p in files]
    if not rows:
        return spark.createDataFrame([], "category string, path string, text string")
    names = spark.createDataFrame([(c, os.path.relpath(p, root)) for c, p in rows], "category string, path string")
    texts = spark.read.format("binaryFile").load([p for _, p in rows]).select("path", "content")
    base = "file:" + os.path.abspath(root) + "/"
    decoded = texts.select(F.substring("path", len(base) + 1, 1 << 20).alias("path"), F.decode(F.encode(F.make_valid_utf8(F.col("content").cast("string")), "UTF-8"), "UTF-8").alias("text"))
    return names.join(decoded, "path").select("category", "path", "text")


def tokenizer_folders(root: str) -> list[dict]:
    """Folders up to two levels down with a ``tokenizer.json`` and another file, the largest vocabulary first."""
    seen, out = set(), []
    for depth in ("", "*/", "*/*/"):
        for path in sorted(glob.glob(os.path.join(root, depth + "tokenizer.json"))):
            folder = os.path.realpath(os.path.dirname(path))
            if folder in seen or len(os.listdir(folder)) < 2:
                continue
            seen.add(folder)
            try:
                with open(path, encoding="utf-8") as f:
                    size = len(json.load(f)["model"]["vocab"])
            except (OSError, ValueError, KeyError, TypeError):
                continue
            out.append({"name": os.path.basename(folder), "path": folder, "vocab_size": size})
    return sorted(out, key=lambda x: (-x["vocab_size"], x["name"]))

