"""From text to counted chunks: segments, chunks, the count of every distinct chunk, and their artifact."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions.pretok import PreTokenizer
from lexloom.functions.specials import SpecialTokens, segments
from lexloom.session import file_system

MAGIC, VERSION = "lexloom-chunks", 1


class ArtifactError(ValueError):
    """A folder that can't be read as a chunk artifact."""


class ArtifactMissing(ArtifactError):
    """Nothing is there."""


class ArtifactMarkWrong(ArtifactError):
    """Something else is there."""


class ArtifactVersionUnknown(ArtifactError):
    """It was written in another version."""


class ArtifactBroken(ArtifactError):
    """Its parts don't fit together: a column or the description is missing, or counts are."""


def text_chunks(text: Column, pretok: PreTokenizer, specials: SpecialTokens | None = None) -> Column:
    """All chunks of a text's ordinary segments, in order; null text has none."""
    if specials is None or not specials.tokens:
        return F.coalesce(pretok(text), F.array().cast("array<string>"))
    ordinary = F.filter(segments(text, specials), lambda s: ~s["special"])
    return F.coalesce(F.flatten(F.transform(ordinary, lambda s: pretok(s["seg"]))), F.array().cast("array<string>"))


def placed_chunks(df: DataFrame, key: str, text: str, pretok: PreTokenizer, specials: SpecialTokens | None = None) -> DataFrame:
    """``key, seg_pos, chunk_pos, special, chunk``: every chunk with its place; a special is a chunk by itself."""
    segs = df.select(key, F.posexplode(segments(F.col(text), specials or SpecialTokens())).alias("seg_pos", "s"))
    parts = F.when(F.col("s.special"), F.array(F.col("s.seg"))).otherwise(pretok(F.col("s.seg")))
    return segs.select(key, "seg_pos", F.col("s.special").alias("special"), F.posexplode(parts).alias("chunk_pos", "chunk"))


def chunk_counts(df: DataFrame, text: str, pretok: PreTokenizer, specials: SpecialTokens | None = None) -> DataFrame:
    """``chunk, cnt``: counted map-side first, then by chunk; one shuffle of distinct chunks per task."""
    return df.select(F.explode(text_chunks(F.col(text), pretok, specials)).alias("chunk")).groupBy("chunk").agg(F.count("*").alias("cnt"))


def ingest_stats(df: DataFrame, text: str, pretok: PreTokenizer, specials: SpecialTokens | None = None) -> DataFrame:
    """One row: sequences, bytes and chunks with multiplicity (null texts aren't sequences)."""
    rows = df.where(F.col(text).isNotNull())
    return rows.agg(
        F.count("*").alias("total_sequences"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).cast("long").alias("total_bytes"),
        F.coalesce(F.sum(F.size(text_chunks(F.col(text), pretok, specials))), F.lit(0)).cast("long").alias("total_chunks"),
    )


def canonical_order() -> list[Column]:
    """Most frequent first; ties in byte order, which is Spark's order of strings."""
    return [F.col("cnt").desc(), F.col("chunk").asc()]


def at_least(counts: DataFrame, min_frequency: int) -> DataFrame:
    return counts.where(F.col("cnt") >= min_frequency) if min_frequency > 1 else counts


def write_artifact(counts: DataFrame, path: str, spec: str, pattern: str, specials: SpecialTokens, stats: dict) -> None:
    """Chunks in canonical order as Parquet beside a one-row table that says what they are."""
    spark = counts.sparkSession
    counts.select(F.col("chunk").cast("binary").alias("chunk"), "cnt").orderBy("cnt", "chunk", ascending=[False, True]).write.mode("overwrite").parquet(f"{path}/chunks")
    meta = [(MAGIC, VERSION, spec, pattern, specials.tokens, int(stats["total_bytes"]), int(stats["total_chunks"]), int(stats["total_sequences"]))]
    spark.createDataFrame(
        meta, "magic string, version int, pre_tokenizer_config string, pattern string, special_tokens array<string>, total_bytes long, total_chunks long, total_sequences long"
    ).coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def read_artifact(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """(chunk, cnt) and what ``write_artifact`` noted about them."""
    fs, at = file_system(spark, path)
    if not fs.exists(at):
        raise ArtifactMissing(f"nothing at {path}")
    try:
        table = spark.read.parquet(f"{path}/meta")
        meta = table.first() if "magic" in table.columns else None
    except AnalysisException as e:  # a part isn't there or isn't Parquet; other errors pass through
        raise ArtifactMarkWrong(f"{path} isn't a chunk artifact") from e
    if meta is None or meta["magic"] != MAGIC:
        raise ArtifactMarkWrong(f"{path} isn't a chunk artifact")
    if meta["version"] != VERSION:
        raise ArtifactVersionUnknown(f"{path} has version {meta['version']}; this is {VERSION}")
    try:
        counts = spark.read.parquet(f"{path}/chunks")
    except AnalysisException as e:
        raise ArtifactBroken(f"{path} has no chunks") from e
    if not {"chunk", "cnt"} <= set(counts.columns) or counts.where("chunk is null or cnt is null").limit(1).count():
        raise ArtifactBroken(f"{path} lacks chunks or counts")
    return counts.select(F.decode("chunk", "UTF-8").alias("chunk"), "cnt"), meta.asDict()


def merge_counts(*parts: DataFrame) -> DataFrame:
    """Counts of several corpora as one; addition is exact in any order."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("chunk").agg(F.sum("cnt").alias("cnt"))

