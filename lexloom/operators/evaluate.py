"""Compression and fidelity of tokenizers, by category."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def by_category(rows: DataFrame, *keys: str) -> DataFrame:
    """Sums of ``n_chars`` and ``n_tokens`` per key, with chars_per_token (0 without tokens)."""
    sums = rows.groupBy(*keys).agg(F.sum("n_chars").cast("long").alias("n_chars"), F.sum("n_tokens").cast("long").alias("n_tokens"))
    return sums.withColumn("chars_per_token", chars_per_token(F.col("n_chars"), F.col("n_tokens")))


def chars_per_token(chars: Column, tokens: Column) -> Column:
    return F.when(tokens > 0, chars / tokens).otherwise(F.lit(0.0))


def with_totals(rows: DataFrame, tokenizer: str = "tokenizer", category: str = "category") -> DataFrame:
    """Tokens per tokenizer and category with a total per tokenizer (category null)."""
    return rows.rollup(tokenizer, category).agg(F.sum("n_tokens").cast("long").alias("n_tokens")).where(F.col(tokenizer).isNotNull())


def geometric_mean(x: Column) -> Column:
    """exp(mean(ln x)) over an aggregate; 0 without rows."""
    return F.coalesce(F.exp(F.avg(F.ln(x))), F.lit(0.0))


def macro(per_category: DataFrame, tokenizer: str = "tokenizer") -> DataFrame:
    return per_category.where("chars_per_token > 0").groupBy(tokenizer).agg(geometric_mean(F.col("chars_per_token")).alias("macro_chars_per_token"), F.sum("n_tokens").cast("long").alias("total_tokens"))


def best(per_category: DataFrame, category: str = "category") -> DataFrame:
    return per_category.groupBy(category).agg(F.max("chars_per_token").alias("best_chars_per_token"), F.min("n_tokens").alias("fewest_tokens"))


def ranked(per_category: DataFrame, category: str = "category", tokenizer: str = "tokenizer") -> DataFrame:
    """Place of each tokenizer in each category, the best compression first."""
    return per_category.withColumn("place", F.row_number().over(W.partitionBy(category).orderBy(F.col("chars_per_token").desc(), F.col(tokenizer))))


def report_order(own: Column, tokenizer: str = "tokenizer") -> list[Column]:
    """The order of a report: one's own tokenizers first, then by macro compression."""
    return [own.desc(), F.col("macro_chars_per_token").desc(), F.col(tokenizer)]


def round_trip(rows: DataFrame, text: str = "text", back: str = "back", n_tokens: str = "n_tokens") -> DataFrame:
    """One row: texts, how many came back as they were, and characters per token of those."""
    same = F.col(text) == F.col(back)
    chars, tokens = F.sum(F.when(same, F.length(text))), F.sum(F.when(same, F.col(n_tokens)))
    return rows.agg(F.count("*").alias("texts"), F.count_if(same).alias("passed"), F.round(F.coalesce(chars_per_token(chars, tokens), F.lit(0.0)), 6).alias("chars_per_token"))


def failures(rows: DataFrame, key: str, text: str = "text", back: str = "back") -> DataFrame:
    """``key, first_difference`` of the texts that came back changed."""
    return rows.where(~F.col(text).eqNullSafe(F.col(back))).select(key, first_difference(F.col(text), F.col(back)).alias("first_difference"))


def first_difference(a: Column, b: Column) -> Column:
    """Position (from 0) of the first differing character; null if equal. Both are cut into characters once."""
    same = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x.eqNullSafe(y))
    return F.when(a == b, F.lit(None)).otherwise(F.array_position(same, False) - 1).cast("int")
