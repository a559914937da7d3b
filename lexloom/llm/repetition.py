"""Repetition inside a document, judged with its host.

A word is repeated when it lies in a run of ``run`` (five) or more words that already stood earlier
in the same text; words are runs of letters, case and digits and punctuation and spacing don't
matter. ``share`` is repeated words over words. A document fails the rule when the share is at
least ``limit`` (a fifth).

Hosts: failures are counted per host, and the hosts' failure rates are shrunk with a beta prior, so that a
host with two pages isn't condemned by one. Each table has a prior of its own, as its hosts are of their own
kind; it is fitted to the hosts, weighted by their documents, by the method of moments: the spread of the rates beyond
what chance makes of equal rates gives the correlation ``rho`` inside hosts, and ``1 / rho - 1`` the prior's weight in documents.
``host_rate`` is the posterior mean, ``host_verdict`` says whether it reaches ``host_limit``; both
are joined back to the documents. ``found`` is the document's own rule: a host's record never turns
an innocent document into a case, it ranks and explains.

Defined results: null, empty and wordless texts have 0 words, share 0 and aren't found; a null
host is a host of its own (the empty name); texts of any length are judged whole; rows repeated in the input with
the same id yield one row (the larger share); an empty table yields no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm import wordstream as ws
from lexloom.session import materialize


def repeated_words(texts: list[str | None], run: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Words and repeated words of each text."""
    n_words, n_repeated = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    for a, b in ws.blocks(texts):
        w = ws.words([ws.lowered(t) for t in texts[a:b]], "letters")
        n_words[a:b] = np.bincount(w.owner, minlength=b - a)
        h, at = ws.grams(w.hashes, w.owner, run)
        if not len(h):
            continue
        h = h ^ ws.mix64(w.owner[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))  # equal only within a text
        order = np.argsort(h, kind="stable")
        again = np.zeros(len(h), bool)
        again[order[1:]] = h[order[1:]] == h[order[:-1]]
        edge = np.zeros(len(w.hashes) + 1, np.int64)
        np.add.at(edge, at[again], 1)
        np.add.at(edge, at[again] + run, -1)
        covered = np.cumsum(edge[:-1]) > 0
        n_repeated[a:b] = np.bincount(w.owner[covered], minlength=b - a)
    return n_words, n_repeated


def _measure(run: int):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total, again = repeated_words(b.column(3).to_pylist(), run)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(total), pa.array(again)], names=["tbl", "row_id", "host", "n_words", "n_repeated"])

    return go


def measure(df: DataFrame, tbl: str, key: str, text: str, host: str | None, run: int = 5) -> DataFrame:
    """``tbl, row_id, host, n_words, n_repeated, share`` of each row of one table."""
    name = F.coalesce(F.col(host).cast("string"), F.lit("")) if host else F.lit(tbl)
    rows = df.select(F.lit(tbl).alias("tbl"), F.col(key).cast("long").alias("row_id"), name.alias("host"), F.col(text).alias("text"))
    out = rows.mapInArrow(_measure(run), "tbl string, row_id long, host string, n_words long, n_repeated long")
    return out.withColumn("share", F.when(F.col("n_words") > 0, F.col("n_repeated") / F.col("n_words")).otherwise(F.lit(0.0)))


RHO = (0.001, 0.5)


def host_verdicts(measured: DataFrame, limit: float = 0.2, host_limit: float = 0.5) -> DataFrame:
    """``tbl, host, n_docs, n_failed, host_rate, host_verdict``, the rates shrunk towards their table's mean."""
    n, rate, mean = F.col("n_docs"), F.col("n_failed") / F.col("n_docs"), F.col("_failed") / F.col("_docs")
    per = measured.groupBy("tbl", "host").agg(F.count("*").alias("n_docs"), F.sum((F.col("share") >= limit).cast("long")).alias("n_failed"))
    # sums of n, n rate, n rate^2 and n^2 per table: as many rows as tables
    sums = per.groupBy("tbl").agg(F.sum(n).alias("_docs"), F.sum("n_failed").alias("_failed"), F.sum(n * rate * rate).alias("_squares"), F.sum(n.cast("double") * n).alias("_sizes"), F.count("*").alias("_hosts"))
    pq, free = mean * (1 - mean), F.col("_hosts") - 1
    spread = F.col("_squares") - F.col("_docs") * mean * mean
    room = F.col("_docs") - F.col("_sizes") / F.col("_docs") - free
    rho = F.when((pq > 0) & (room > 0), (spread - pq * free) / F.nullif(pq * room, F.lit(0.0))).otherwise(F.lit(RHO[0]))
    prior = sums.select("tbl", mean.alias("_mean"), (1 / F.least(F.greatest(rho, F.lit(RHO[0])), F.lit(RHO[1])) - 1).alias("_weight"))
    posterior = (F.col("n_failed") + F.col("_mean") * F.col("_weight")) / (n + F.col("_weight"))
    return per.join(F.broadcast(prior), "tbl").withColumn("host_rate", posterior).withColumn("host_verdict", F.col("host_rate") >= host_limit).drop("_mean", "_weight")


def joined_back(measured: DataFrame, hosts: DataFrame, broadcast_hosts: int = 200_000, salts: int = 32) -> DataFrame:
    """Every document with its host's record: the hosts are broadcast after a check of their number; more of them are
    joined by shuffle with a salt, so that the documents of a hot host go to ``salts`` tasks."""
    if hosts.count() <= broadcast_hosts:
        return measured.join(F.broadcast(hosts), ["tbl", "host"])
    salted = measured.withColumn("_salt", F.pmod(F.xxhash64("row_id"), F.lit(salts)).cast("int"))
    copies = hosts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, ["tbl", "host", "_salt"]).drop("_salt")


def judge(measured: DataFrame, limit: float = 0.2, host_limit: float = 0.5, broadcast_hosts: int = 200_000) -> DataFrame:
    """Every document with its share, its host's record and ``found``."""
    measured = materialize(measured.groupBy("tbl", "row_id").agg(F.max_by(F.struct("host", "n_words", "n_repeated", "share"), F.struct("share", "host")).alias("m")).select("tbl", "row_id", "m.*"))
    hosts = materialize(host_verdicts(measured, limit, host_limit))
    return joined_back(measured, hosts, broadcast_hosts).withColumn("found", F.col("share") >= limit)
