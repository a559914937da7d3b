"""Mix records of several sources to target byte shares, with a cap on repeats.

Shares. Each job ``j`` has a requested share ``t_j`` (its target_bytes over the sum of all) of a
mix of ``total_bytes``. Temperature mixing starts from the exponentiated shares
``w_j(a) proportional to t_j ** a``; ``a = 1`` asks for the targets themselves. A job can give at most
``max_repeats_j * available_bytes_j``. When a total is given, a job whose wish exceeds that gives its
whole capacity and the rest is spread over the others in proportion to their weights (water
filling), so the mix keeps its size while any capacity is left; with ``within_caps`` the exponent is
first lowered until no wish exceeds its cap, if some exponent does that. The total may be given as a
multiple of the bytes that all jobs have (``total_share``). When no total is given, the size is
the largest one at which no job with records breaks its cap. ``min_entropy`` (nats) or ``max_epochs`` bisect the
exponent: lowering ``a`` from 1 to 0 evens the weights out until their entropy reaches the target,
or until the most-repeated job needs no more than ``max_epochs`` passes.

Realisation. A job that needs ``q`` whole passes and a rest uses each record ``q`` times and fills
the rest with records in pseudo-random order up to the budget: a *budgeted block permutation*. Every
pass of a job has its own permutation, keyed by the number of the pass: each use of a record is a row with its
pass, its block and its slot, a place in the mixed stream that holds all uses of all jobs, so that every stretch
of it has the mix's shares. The running byte sum of the last pass is computed in two levels (bytes per
block of slots, then inside the block), so the largest job is never one task: only block totals, at
most ``MAX_BLOCKS`` per job, are ordered globally and broadcast.

Defined results: a null or non-positive target takes no part; of jobs listed twice the later
updated_at holds (ties: larger target); sources compare case-insensitively and trimmed; a record
with null or empty text has no bytes and is never used; a record whose seed_data is null passes
``!=`` and fails ``=``; a record listed twice (same table and id) is one record; a source without
records, or a job without capacity, reaches share 0. An empty mix has no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from lexloom.session import materialize
from lexloom.sources.text import seed_condition

MAX_BLOCKS = 4096
SLOT_BITS = 60
PLAN = T.StructType(
    [
        T.StructField("job", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("requested_share", T.DoubleType()),
        T.StructField("available_bytes", T.LongType()),
        T.StructField("records", T.LongType()),
        T.StructField("max_repeats", T.IntegerType()),
        T.StructField("exponent", T.DoubleType()),
        T.StructField("weight", T.DoubleType()),
        T.StructField("budget_bytes", T.LongType()),
        T.StructField("passes", T.IntegerType()),
        T.StructField("rest_bytes", T.LongType()),
    ]
)


def current_jobs(jobs: DataFrame) -> DataFrame:
    """The job rows that hold: one per job, the latest, with a positive target."""
    latest = W.partitionBy("job").orderBy(F.col("updated_at").desc_nulls_last(), F.col("target_bytes").desc_nulls_last())
    return jobs.where(F.col("job").isNotNull()).withColumn("_n", F.row_number().over(latest)).where("_n = 1").drop("_n")


def weights(shares: list[float], exponent: float) -> list[float]:
    raw = [s**exponent if s > 0 else 0.0 for s in shares]
    total = sum(raw)
    return [r / total if total else 0.0 for r in raw]


def entropy(ws: list[float]) -> float:
    return -sum(w * math.log(w) for w in ws if w > 0)


def bisect_exponent(shares: list[float], fits, steps: int = 60) -> float:
    """The largest exponent in [0, 1] at which ``fits(weights)`` holds; 0 if it never does."""
    if fits(weights(shares, 1.0)):
        return 1.0
    low, high = 0.0, 1.0
    for _ in range(steps):
        mid = (low + high) / 2
        if fits(weights(shares, mid)):
            low = mid
        else:
            high = mid
    return low


def largest_exponent(shares: list[float], fits, top: float = 1.0, steps: int = 1000) -> float | None:
    """The largest exponent in [0, top] at which ``fits(weights)`` holds, or None; what fits needn't be an interval from 0."""
    if fits(weights(shares, top)):
        return top
    for k in range(steps - 1, -1, -1):
        low, high = top * k / steps, top * (k + 1) / steps
        if fits(weights(shares, low)):
            for _ in range(60):
                mid = (low + high) / 2
                low, high = (mid, high) if fits(weights(shares, mid)) else (low, mid)
            return low
    return None


def plan_mix(jobs: list[dict], total_bytes: int | None = None, min_entropy: float | None = None, max_epochs: float | None = None, within_caps: bool = False) -> list[dict]:
    """Budgets from one dict per job (job, source, target_bytes, max_repeats, available_bytes, records)."""
    jobs = [j for j in jobs if (j["target_bytes"] or 0) > 0]
    asked = sum(j["target_bytes"] for j in jobs)
    shares = [j["target_bytes"] / asked for j in jobs]
    # a null max_repeats allows one use
    caps = [max(0, 1 if j["max_repeats"] is None else j["max_repeats"]) * (j["available_bytes"] or 0) for j in jobs]
    exponent = 1.0
    if min_entropy is not None:
        exponent = min(exponent, bisect_exponent(shares, lambda ws: entropy(ws) >= min_entropy))
    if max_epochs is not None:
        size = total_bytes or sum(j["available_bytes"] or 0 for j in jobs)
        ok = lambda ws: all(w * size <= max_epochs * (j["available_bytes"] or 0) or not j["available_bytes"] for w, j in zip(ws, jobs))
        exponent = min(exponent, bisect_exponent(shares, ok))
    if within_caps and total_bytes:
        fitting = largest_exponent(shares, lambda ws: all(w * total_bytes <= c or not c for w, c in zip(ws, caps)), exponent)
        exponent = exponent if fitting is None else fitting
    ws = weights(shares, exponent)
    # jobs without records keep the others' proportions as they are
    able = [(c, j["target_bytes"]) for j, c in zip(jobs, caps) if c > 0]
    if total_bytes is None and exponent == 1.0:
        sizes = [min(c * j["target_bytes"] // t for c, t in able) if cap > 0 else 0 for j, cap in zip(jobs, caps)]
        return [_budget(j, share, exponent, w, size) for j, share, w, size in zip(jobs, shares, ws, sizes)]
    if total_bytes is None:
        total_bytes = int(min((c * sum(w for c, w in zip(caps, ws) if c > 0) / w for c, w in zip(caps, ws) if c > 0 and w > 0), default=0))
    budgets, open_jobs, left = [0.0] * len(jobs), [i for i, c in enumerate(caps) if c > 0], float(min(total_bytes, sum(caps)))
    while open_jobs and left > 1e-9:
        scale = sum(ws[i] for i in open_jobs)
        wish = {i: left * ws[i] / scale for i in open_jobs}
        full = [i for i in open_jobs if wish[i] >= caps[i]]
        for i in full or open_jobs:
            budgets[i] = float(caps[i]) if full else wish[i]
            left -= budgets[i]
        open_jobs = [i for i in open_jobs if i not in full] if full else []
    return [_budget(j, share, exponent, w, int(round(b))) for j, share, w, b in zip(jobs, shares, ws, budgets)]


def _budget(j: dict, share: float, exponent: float, weight: float, size: int) -> dict:
    have = j["available_bytes"] or 0
    return {
        "job": j["job"], "source": j["source"], "requested_share": share, "available_bytes": have, "records": j["records"] or 0,
        "max_repeats": 1 if j["max_repeats"] is None else j["max_repeats"], "exponent": exponent, "weight": weight, "budget_bytes": size,
        "passes": size // have if have else 0, "rest_bytes": size % have if have else 0,
    }


def job_records(tables: dict[str, tuple[DataFrame, str, str]], jobs: list[dict]) -> DataFrame:
    """``job, tbl, record_id, n_bytes``: the records of each job.

    ``tables`` maps a name to (DataFrame, id column, text column). Only the length of a text is kept.
    """
    parts = []
    for name, (df, key, text) in tables.items():
        seed = F.col("seed_data") if "seed_data" in df.columns else F.lit(None).cast("string")
        rows = df.select(
            F.lit(name).alias("tbl"), F.col(key).cast("long").alias("record_id"), F.lower(F.trim(F.col("source"))).alias("_source"), seed.alias("_seed"),
            F.octet_length(F.col(text)).cast("long").alias("n_bytes"),
        ).where((F.col("n_bytes") > 0) & F.col("record_id").isNotNull())
        parts.append(rows)
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    rules = F.array_compact(
        F.array(*[F.when((F.col("_source") == j["source"].strip().lower()) & seed_condition(j["seed_filter"], F.col("_seed")), F.lit(j["job"])) for j in jobs if j["source"]])
    )
    rows = rows.select("tbl", "record_id", "n_bytes", F.explode(rules).alias("job"))
    return rows.groupBy("job", "tbl", "record_id").agg(F.max("n_bytes").alias("n_bytes"))


def slot(seed: int, number: Column) -> Column:
    """The place of a use in the mixed stream: the leading bits of a digest of the seed, the number of the pass and the record."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), number.cast("string"), "job", "tbl", F.col("record_id").cast("string")))
    return F.conv(F.substring(digest, 1, SLOT_BITS // 4), 16, 10).cast("long")


def realise(records: DataFrame, plan: list[dict], seed: int = 7, blocks: int = 256) -> DataFrame:
    """``job, tbl, record_id, n_bytes, pass, block, slot``: a row for each use of each record.

    Whole passes use every record; the last pass those whose place in its permutation lies inside the
    rest budget (the record that crosses the budget isn't used).
    """
    spark = records.sparkSession
    bits = min(blocks, MAX_BLOCKS).bit_length() - 1
    block = F.shiftright("slot", SLOT_BITS - bits).cast("int")
    small = F.broadcast(spark.createDataFrame([(p["job"], p["passes"], p["rest_bytes"]) for p in plan], "job string, passes int, rest long"))
    planned = records.join(small, "job")
    whole = planned.where("passes > 0").withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("passes") - 1))).withColumn("slot", slot(seed, F.col("pass")))
    placed = materialize(planned.where("rest > 0").withColumn("pass", F.col("passes")).withColumn("slot", slot(seed, F.col("pass"))).withColumn("block", block))
    totals = placed.groupBy("job", "block").agg(F.sum("n_bytes").alias("_b"))  # jobs x blocks rows
    before = W.partitionBy("job").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select("job", "block", F.coalesce(F.sum("_b").over(before), F.lit(0)).alias("_before"))
    # blocks behind the budget needn't be sorted
    reached = placed.join(F.broadcast(totals), ["job", "block"]).where(F.col("_before") < F.col("rest"))
    inside = W.partitionBy("job", "block").orderBy("slot", "tbl", "record_id").rowsBetween(W.unboundedPreceding, 0)
    rest = reached.withColumn("_end", F.col("_before") + F.sum("n_bytes").over(inside)).where(F.col("_end") <= F.col("rest"))
    names = ["job", "tbl", "record_id", "n_bytes", "pass", "block", "slot"]
    return whole.withColumn("block", block).select(*names).unionByName(rest.select(*names))


def mix(jobs: DataFrame, tables: dict[str, tuple[DataFrame, str, str]], total_bytes: int | None = None, min_entropy: float | None = None, max_epochs: float | None = None, within_caps: bool = False, seed: int = 7, block_records: int = 1_000_000, total_share: float | None = None):
    """(plan as list of dicts, a row for each use as DataFrame). The job table is small by nature and is collected."""
    listed = [r.asDict() for r in current_jobs(jobs).select("job", "target_bytes", "source", "seed_filter", "max_repeats").orderBy("job").collect()]
    records = materialize(job_records(tables, listed)) if any(j["source"] for j in listed) else None
    have = {r["job"]: r for r in records.groupBy("job").agg(F.sum("n_bytes").alias("b"), F.count("*").alias("n")).collect()} if records is not None else {}
    for j in listed:
        j["available_bytes"], j["records"] = (have[j["job"]]["b"], have[j["job"]]["n"]) if j["job"] in have else (0, 0)
    if total_share is not None:
        total_bytes = int(total_share * sum(j["available_bytes"] for j in listed if (j["target_bytes"] or 0) > 0))
    plan = plan_mix(listed, total_bytes, min_entropy, max_epochs, within_caps)
    if records is None or not plan:
        records = jobs.sparkSession.createDataFrame([], "job string, tbl string, record_id long, n_bytes long")
    blocks = 1 << max(6, (-(-max((j["records"] for j in listed), default=0) // block_records) - 1).bit_length())
    return plan, realise(records, plan or [{"job": None, "passes": 0, "rest_bytes": 0}], seed, blocks)


def share_report(plan: list[dict], used: DataFrame) -> DataFrame:
    """Per job: requested share, budget, bytes and share reached, records used, most uses of one record."""
    spark = used.sparkSession
    jobs = spark.createDataFrame([tuple(p[f.name] for f in PLAN.fields) for p in plan], PLAN)
    got = used.groupBy("job").agg(F.sum("n_bytes").alias("mixed_bytes"), F.count_if(F.col("pass") == 0).alias("records_used"), (F.max("pass") + 1).cast("int").alias("most_uses"))
    out = jobs.join(F.broadcast(got), "job", "left").fillna(0, ["mixed_bytes", "records_used", "most_uses"])
    whole = F.sum("mixed_bytes").over(W.partitionBy())  # as many rows as jobs
    return out.withColumn("reached_share", F.when(whole > 0, F.col("mixed_bytes") / whole).otherwise(F.lit(0.0)))
