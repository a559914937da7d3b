"""Queries of the operators for training text over the driver's tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexloom.llm import authored, credentials, encoding, heavy_hitters, leakage, mixing, repetition, subjects
from lexloom.session import table


def tokenizer_dir() -> str:
    """Where the public tokenizers' files are: LEXLOOM_TOKENIZERS, or else the installed folder."""
    return os.environ.get("LEXLOOM_TOKENIZERS", "/opt/tokenizers")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials.find(table(spark, sf_dir, "code_files"))


def p1_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file as delivered, with its secrets masked."""
    return credentials.redact(table(spark, sf_dir, "code_files"))


def p1_intact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What redaction leaves as it was: each delivered file's lines, and whether it has text."""
    return p1_redacted(spark, sf_dir).select("file_id", F.length(F.regexp_replace("content", "[^\n]", "")).cast("long").alias("line_feeds"), (F.length("content") > 0).alias("has_text"))


def _frequent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heavy_hitters.frequent_items(table(spark, sf_dir, "agg_chunks"), "chunk", "cnt", per=500)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frequent(spark, sf_dir).select(F.decode("item", "UTF-8").alias("chunk"))


def p2_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same items with exact counts, and whether the summary's bounds hold."""
    return _frequent(spark, sf_dir).select(F.decode("item", "UTF-8").alias("chunk"), F.col("exact").alias("cnt"), (F.col("approx") - F.col("error") <= F.col("exact")).alias("above_lower"), (F.col("exact") <= F.col("approx")).alias("below_upper"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return authored.judge(table(spark, sf_dir, "code_files")).where(F.col("kind").isNotNull()).select("file_id")


def p3_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file with its kind; null means hand-written."""
    return authored.judge(table(spark, sf_dir, "code_files"))


def _repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    synthetic = repetition.measure(table(spark, sf_dir, "cosmopedia_v2"), "cosmopedia_v2", "row_id", "text", "source")
    web = repetition.measure(table(spark, sf_dir, "fineweb_edu_dedup"), "fineweb_edu_dedup", "row_id", "text", "site")
    return repetition.judge(synthetic.unionByName(web))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _repetition(spark, sf_dir).where("found").select("tbl", "row_id")


def p4_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row's share of repeated content with its host's record."""
    return _repetition(spark, sf_dir).withColumn("share", F.round("share", 6)).withColumn("host_rate", F.round("host_rate", 6))


MIX_SHARE, MIX_ENTROPY = 1.25, 2.2  # p5_tempered: the size asked for as a multiple of all bytes that the jobs have, and the least entropy of the weights in nats


def _mix(spark: SparkSession, sf_dir: str, **how):
    t = lambda n: table(spark, sf_dir, n)
    return mixing.mix(t("jobs"), {"code_files": (t("code_files"), "file_id", "content"), "cosmopedia_v2": (t("cosmopedia_v2"), "row_id", "text"), "fineweb_edu_dedup": (t("fineweb_edu_dedup"), "row_id", "text")}, **how)


def p5_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each use of each record, with its pass and its slot in the mixed stream."""
    return _mix(spark, sf_dir)[1].drop("block")


def p5_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = mixing.share_report(*_mix(spark, sf_dir))
    return report.select("job", F.round("requested_share", 9).alias("requested_share"), "available_bytes", "records", "max_repeats", "budget_bytes", "passes", "rest_bytes", "mixed_bytes", "records_used", "most_uses", F.round("reached_share", 9).alias("reached_share"))


def p5_tempered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of a mix of a size in proportion to the tables whose exponent is bisected to the entropy and within the repeat caps."""
    report = mixing.share_report(*_mix(spark, sf_dir, total_share=MIX_SHARE, min_entropy=MIX_ENTROPY, within_caps=True))
    return report.select("job", F.round("exponent", 6).alias("exponent"), F.round("weight", 6).alias("weight"), "budget_bytes", "mixed_bytes", "most_uses", F.round("reached_share", 6).alias("reached_share"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.encode(table(spark, sf_dir, "documents"), "doc_id", "text", f"{tokenizer_dir()}/byte_bpe_50k.tiktoken")


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_texts"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir).select("doc_id", "item_id")


def p7_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per item: how many documents hold it, and the longest passage in words."""
    return _leaks(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("documents"), F.max("words").alias("most_words"))


def _subject_tables(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    return [table(spark, sf_dir, n) for n in ("documents", "doc_labels", "subjects")]


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects.find(*_subject_tables(spark, sf_dir))


def p8_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus by subject: documents devoted to it by a quarter or more, and its share of all that has a subject."""
    s = subjects.shares(*_subject_tables(spark, sf_dir))
    per = s.groupBy("subject").agg(F.count_if(F.col("share") >= subjects.ACCEPT).alias("documents"), F.sum("share").alias("weight"))
    return per.withColumn("corpus_share", F.round(F.col("weight") / F.sum("weight").over(W.partitionBy()), 6)).drop("weight")


QUERIES = {"p1_found": p1_found, "p1_redacted": p1_redacted, "p1_intact": p1_intact, "p2_found": p2_found, "p2_counts": p2_counts, "p5_mix": p5_mix, "p5_shares": p5_shares, "p5_tempered": p5_tempered, "p3_found": p3_found, "p3_kinds": p3_kinds, "p4_found": p4_found, "p4_shares": p4_shares, "p6_ids": p6_ids, "p7_found": p7_found, "p7_items": p7_items, "p8_found": p8_found, "p8_composition": p8_composition}

# Words and runs of five as another engine counts them.
_P4 = """WITH texts AS (
  SELECT 'cosmopedia_v2' AS tbl, row_id, coalesce(source, '') AS host, text FROM cosmopedia_v2 UNION ALL SELECT 'fineweb_edu_dedup', row_id, coalesce(site, ''), text FROM fineweb_edu_dedup),
listed AS (SELECT tbl, row_id, host, coalesce(regexp_extract_all(lower(nfc_normalize(text)), '\\p{L}+'), []) AS w FROM texts),
runs AS (SELECT tbl, row_id, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT tbl, row_id, w, unnest(range(1, len(w) - 3)) AS i FROM listed)),
later AS (SELECT tbl, row_id, i FROM (SELECT *, row_number() OVER (PARTITION BY tbl, row_id, g ORDER BY i) AS n FROM runs) WHERE n > 1),
covered AS (SELECT tbl, row_id, count(DISTINCT i + k) AS n FROM later, (SELECT unnest(range(0, 5)) AS k) GROUP BY tbl, row_id),
shares AS (SELECT l.tbl, l.row_id, host, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_repeated, CASE WHEN len(w) > 0 THEN coalesce(n, 0) / len(w) ELSE 0.0 END AS share FROM listed l LEFT JOIN covered c ON l.tbl = c.tbl AND l.row_id = c.row_id),
hosts AS (SELECT tbl, host, count(*) AS n_docs, count(*) FILTER (WHERE share >= 0.2) AS n_failed FROM shares GROUP BY tbl, host),
sums AS (SELECT tbl, sum(n_docs)::DOUBLE AS n, sum(n_failed) / sum(n_docs) AS p, sum(n_failed * n_failed / n_docs) AS sq, sum(n_docs * n_docs)::DOUBLE AS sz, count(*) - 1 AS k FROM hosts GROUP BY tbl),
prior AS (SELECT tbl, p, 1 / least(greatest(CASE WHEN p > 0 AND p < 1 AND n - sz / n - k > 0 THEN (sq - n * p * p - p * (1 - p) * k) / (p * (1 - p) * (n - sz / n - k)) ELSE 0.001 END, 0.001), 0.5) - 1 AS w FROM sums),
rates AS (SELECT h.*, (n_failed + p * w) / (n_docs + w) AS host_rate FROM hosts h JOIN prior USING (tbl))"""
_HEAVY = "WHERE chunk IS NOT NULL AND cnt > 0"
_FREQUENT = f"FROM agg_chunks {_HEAVY} GROUP BY chunk HAVING sum(cnt) * 500 >= (SELECT sum(cnt) FROM agg_chunks {_HEAVY})"
# Jobs that hold, their records, and the largest size at which every job keeps its share within its cap.
_MIX = """WITH cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job ORDER BY updated_at DESC NULLS LAST, target_bytes DESC NULLS LAST) AS n FROM jobs WHERE job IS NOT NULL) WHERE n = 1 AND target_bytes > 0),
rows_ AS (SELECT 'code_files' AS tbl, file_id AS id, source, NULL AS seed, content AS t FROM code_files UNION ALL SELECT 'cosmopedia_v2', row_id, source, seed_data, text FROM cosmopedia_v2 UNION ALL SELECT 'fineweb_edu_dedup', row_id, source, NULL, text FROM fineweb_edu_dedup),
own AS (SELECT c.job, r.tbl, r.id AS record_id, max(octet_length(encode(r.t))) AS n_bytes FROM rows_ r JOIN cur c ON lower(trim(r.source)) = lower(trim(c.source))
  AND (c.seed_filter IS NULL OR (starts_with(c.seed_filter, '=') AND lower(trim(r.seed)) = lower(trim(substr(c.seed_filter, 2)))) OR (starts_with(c.seed_filter, '!=') AND lower(trim(r.seed)) IS DISTINCT FROM lower(trim(substr(c.seed_filter, 3)))))
  WHERE r.t <> '' AND r.id IS NOT NULL GROUP BY ALL),
have AS (SELECT c.job, c.target_bytes AS t, coalesce(c.max_repeats, 1) AS reps, count(o.record_id) AS records, coalesce(sum(o.n_bytes), 0)::HUGEINT AS b FROM cur c LEFT JOIN own o ON c.job = o.job GROUP BY ALL),
plan AS (SELECT p.*, CASE WHEN p.b * p.reps > 0 THEN (SELECT min(h.b * h.reps * p.t // h.t) FROM have h WHERE h.b * h.reps > 0) ELSE 0 END AS budget FROM have p),
steps AS (SELECT *, CASE WHEN b > 0 THEN budget // b ELSE 0 END AS passes, CASE WHEN b > 0 THEN budget % b ELSE 0 END AS rest FROM plan),
uses AS (SELECT job, tbl, record_id, n_bytes, pass, passes, rest, CAST(('0x' || substr(md5('7|' || pass || '|' || job || '|' || tbl || '|' || record_id), 1, 15)) AS BIGINT) AS slot
  FROM (SELECT o.*, s.passes, s.rest, unnest(range(0, CAST(s.passes AS BIGINT) + 1)) AS pass FROM own o JOIN steps s ON o.job = s.job)),
used AS (SELECT job, tbl, record_id, CAST(n_bytes AS BIGINT) AS n_bytes, CAST(pass AS INTEGER) AS pass, slot FROM (SELECT *, sum(n_bytes) OVER (PARTITION BY job, pass ORDER BY slot, tbl, record_id) AS upto FROM uses) WHERE pass < passes OR upto <= rest)"""
_SHARES = f"""{_MIX}, got AS (SELECT job, sum(n_bytes) AS m, count(*) FILTER (WHERE pass = 0) AS n, max(pass) + 1 AS u FROM used GROUP BY job)
SELECT s.job, round(s.t / sum(s.t) OVER (), 9) AS requested_share, CAST(b AS BIGINT) AS available_bytes, records, CAST(reps AS INTEGER) AS max_repeats, CAST(budget AS BIGINT) AS budget_bytes, CAST(passes AS INTEGER) AS passes, CAST(rest AS BIGINT) AS rest_bytes,
CAST(coalesce(m, 0) AS BIGINT) AS mixed_bytes, coalesce(n, 0) AS records_used, CAST(coalesce(u, 0) AS INTEGER) AS most_uses, round(coalesce(m, 0) / (SELECT sum(m) FROM got), 9) AS reached_share FROM steps s LEFT JOIN got g ON s.job = g.job"""
SQL: dict[str, str] = {
    "p1_intact": "SELECT file_id, CAST(length(content) - length(replace(content, chr(10), '')) AS BIGINT) AS line_feeds, length(content) > 0 AS has_text FROM code_files",
    "p2_found": f"SELECT decode(chunk) AS chunk {_FREQUENT}",
    "p2_counts": f"SELECT decode(chunk) AS chunk, CAST(sum(cnt) AS BIGINT) AS cnt, true AS above_lower, true AS below_upper {_FREQUENT}",
    "p4_found": f"{_P4} SELECT tbl, row_id FROM shares WHERE share >= 0.2",
    "p4_shares": f"{_P4} SELECT tbl, s.row_id, host, n_words, n_repeated, round(share, 6) AS share, n_docs, n_failed, round(host_rate, 6) AS host_rate, host_rate >= 0.5 AS host_verdict, share >= 0.2 AS found FROM shares s JOIN rates USING (tbl, host)",
    "p5_mix": f"{_MIX} SELECT * FROM used",
    "p5_shares": _SHARES,
}
