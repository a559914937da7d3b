"""Most frequent items of a column too large to group: counter summaries, then an exact second pass.

Pass one runs a weighted space-saving summary over every partition. It holds at most ``counters``
counters; an item without a counter that needs one replaces the smallest and starts from its count, which is
its possible error. So a counter's ``count`` is an upper bound of its item's weight, ``count - error``
a lower one, and no item without a counter weighs more than ``floor``, the largest count replaced so far. Items
come in batches, whose new items take over the smallest counters at once. All counts are kept less
the floor (``gain``): then replacing is dropping the smallest gains, and summaries merge by adding gains,
lower bounds and floors, in any order, which keeps ``floor <= weight / (counters + 1)``.
The merge runs as a tree of ``fan_in`` summaries per task, so
no task and not the driver ever sees more than ``fan_in * counters`` items.

Every item whose weight is at least ``share`` of the total survives pass one when
``counters >= 1 / share``. Pass two counts the survivors (at most ``counters`` of them, hence a
bounded broadcast) exactly, with map-side combination, so that one hot value is no hot task.

Rows with a null item, a null weight or a weight below one count nowhere; repeated rows count as
often as they occur. An empty table has no frequent items. Items compare byte for byte.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SUMMARY = "slot long, item binary, gain long, lower long, total long"


class SpaceSaving:
    """A weighted counter summary of bounded size: per item its count less the floor, and a lower bound."""

    def __init__(self, counters: int):
        self.counters, self.gain, self.lower, self.floor, self.total = counters, {}, {}, 0, 0

    def add(self, items: Iterable[bytes], gains: Iterable[int], lowers: Iterable[int]) -> None:
        """Rows of a batch (their weight is gain and lower bound alike) or of another summary."""
        gain, lower = self.gain, self.lower
        for item, g, low in zip(items, gains, lowers):
            gain[item] = gain.get(item, 0) + g
            lower[item] = lower.get(item, 0) + low
        self.replace()

    def replace(self) -> None:
        """Let the smallest counters go; the largest of them is the new floor."""
        over = len(self.gain) - self.counters
        if over <= 0:
            return
        values = np.fromiter(self.gain.values(), np.int64, len(self.gain))
        cut = int(np.partition(values, over - 1)[over - 1])  # the largest count that has no counter of its own
        self.gain = {k: v - cut for k, v in self.gain.items() if v > cut}
        self.lower = {k: self.lower[k] for k in self.gain}
        self.floor += cut

    def bounds(self) -> dict[bytes, tuple[int, int]]:
        """Lower and upper bound of every counter's item."""
        return {k: (self.lower[k], g + self.floor) for k, g in self.gain.items()}

    def to_batch(self, slot: int) -> pa.RecordBatch:
        # a marker row with a null item keeps floor and total when no counter is left
        n = len(self.gain)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([slot] * (n + 1), pa.int64()),
                pa.array([None, *self.gain], pa.binary()),
                pa.array([self.floor, *self.gain.values()], pa.int64()),
                pa.array([0, *self.lower.values()], pa.int64()),
                pa.array([self.total] + [0] * n, pa.int64()),
            ],
            names=["slot", "item", "gain", "lower", "total"],
        )


def _summarise(counters: int, slots: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        s, pending, held = SpaceSaving(counters), [], 0

        def flush() -> None:
            t = pa.Table.from_batches(pending).group_by("item").aggregate([("cnt", "sum")])
            weights = t["cnt_sum"].to_pylist()
            s.add(t["item"].to_pylist(), weights, weights)
            s.total += sum(weights)

        for b in batches:
            if b.num_rows:
                pending.append(b)
                held += b.num_rows
            if held >= 32 * counters:
                flush()
                pending, held = [], 0
        if pending:
            flush()
        yield s.to_batch(TaskContext.get().partitionId() % slots)

    return run


def _merge(counters: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merged: dict[int, SpaceSaving] = {}
        for b in batches:
            slots = b.column(0).to_numpy()
            for slot in np.unique(slots):
                part = b.filter(pc.equal(b.column(0), int(slot)))
                s = merged.setdefault(int(slot), SpaceSaving(counters))
                head = part.filter(pc.is_null(part.column(1)))
                s.floor += pc.sum(head.column(2)).as_py() or 0
                s.total += pc.sum(head.column(4)).as_py() or 0
                body = part.filter(pc.is_valid(part.column(1)))
                s.add(*(body.column(k).to_pylist() for k in (1, 2, 3)))
        for slot, s in merged.items():
            yield s.to_batch(slot)

    return run


def _counted(df: DataFrame, item: str, weight: str | None) -> DataFrame:
    w = F.col(weight).cast("long") if weight else F.lit(1).cast("long")
    return df.select(F.col(item).cast("binary").alias("item"), w.alias("cnt")).where(F.col("item").isNotNull() & (F.col("cnt") > 0))


def summaries(df: DataFrame, item: str, weight: str | None, counters: int, fan_in: int = 16) -> DataFrame:
    """Pass one: one merged summary as rows; the rows with a null item carry the floor (as gain) and the total weight.

    ``item`` is a binary or string column, ``weight`` a count column (None: every row weighs one).
    The first level of the tree is as wide as spark.sql.shuffle.partitions, each further one
    ``fan_in`` times narrower; a merging task holds one summary, however many it reads.
    """
    width = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    level = _counted(df, item, weight).mapInArrow(_summarise(counters, width), SUMMARY)
    while True:
        level = level.repartition(width, "slot").mapInArrow(_merge(counters), SUMMARY)
        if width == 1:
            return level
        width = -(-width // fan_in)
        level = level.withColumn("slot", F.col("slot") % width)


def frequent_items(df: DataFrame, item: str, weight: str | None = None, per: int = 500, counters: int | None = None, fan_in: int = 16) -> DataFrame:
    """Items with at least one ``per``-th of the whole weight.

    Columns: ``item BINARY, approx BIGINT, error BIGINT, exact BIGINT, total BIGINT``; ``approx`` is
    the counter, an upper bound for ``exact``, and ``approx - error`` a lower one.
    """
    counters = counters or 4 * per
    if counters < per:
        raise ValueError("counters must be at least per, else frequent items can be lost")
    rows = summaries(df, item, weight, counters, fan_in).collect()  # at most counters + 1 rows
    floor, total = (sum(r[k] for r in rows if r["item"] is None) for k in ("gain", "total"))
    kept = [(bytes(r["item"]), r["gain"] + floor, r["gain"] + floor - r["lower"], total) for r in rows if r["item"] is not None and (r["gain"] + floor) * per >= total]
    small = df.sparkSession.createDataFrame(kept, "item binary, approx long, error long, total long").coalesce(1)
    exact = _counted(df, item, weight).join(F.broadcast(small.select("item")), "item", "left_semi").groupBy("item").agg(F.sum("cnt").alias("exact"))
    out = small.join(exact, "item").where(F.col("exact") * F.lit(per) >= F.col("total"))
    return out.select("item", "approx", "error", "exact", "total")
