"""Global order without one global task: running sums and row numbers over a whole table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexloom.session import materialize


def running_sum(df: DataFrame, size: Column, order: Sequence[Column], group: str | None = None, name: str = "offset", partitions: int | None = None, below: int | None = None) -> DataFrame:
    """Adds ``name``: the sum of ``size`` over the rows before this one in ``order`` (per ``group``).

    ``df`` should hold keys and sizes only, as all of it is shuffled and written. With ``below``, rows whose sum
    isn't under it are left out, whole ranges at a time where possible. Rows are range-partitioned by group and order, written once, summed per range, and only the
    ranges' sums (one row per partition and group) are put in order globally.
    """
    partitions = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ([F.col(group)] if group else []) + list(order)
    sized = df.withColumn("_size", size.cast("long")).repartitionByRange(partitions, *keys).withColumn("_part", F.spark_partition_id())
    kept = materialize(sized)
    g = [group] if group else []
    sums = kept.groupBy("_part", *g).agg(F.sum("_size").alias("_sum"))
    # ranges are ordered by number; there are as many rows as ranges (and groups within them)
    before = (W.partitionBy(*g) if g else W.partitionBy(F.lit(0))).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    sums = sums.withColumnsRenamed({"_part": "_p", **({group: "_g"} if group else {})})
    same = F.col("_part") == F.col("_p")
    if group:  # groups may be many: let the planner choose how to join
        joined = kept.join(sums, same & F.col(group).eqNullSafe(F.col("_g")))
    else:
        joined = kept.join(F.broadcast(sums), same)
    if below is not None:
        joined = joined.where(F.col("_before") < below)
    inside = W.partitionBy("_part", *g).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    out = joined.withColumn(name, F.col("_before") + F.coalesce(F.sum("_size").over(inside), F.lit(0)))
    out = out.drop("_size", "_part", "_p", "_before", "_g")
    return out if below is None else out.where(F.col(name) < below)


def row_numbers(df: DataFrame, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """Adds ``name``: 0, 1, 2 ... in ``order``."""
    return running_sum(df, F.lit(1), order, name=name)


def byte_budget(df: DataFrame, text: str, order: Sequence[Column], target: int, separator: str = "", key: Sequence[str] = ()) -> DataFrame:
    """Rows in order until ``target`` bytes are reached; the row that crosses the target is the last one in.

    With a unique ``key``, only keys and lengths are ordered and written; ranges behind the one that crosses the
    target aren't looked at row by row, and texts are joined back for the accepted rows.
    """
    cost = F.octet_length(F.col(text)) + len(separator.encode())
    if not key:
        return running_sum(df, cost, order, name="written").where(F.col("written") < target)
    slim = df.select(*key, cost.cast("long").alias("_cost"), *[o.alias(f"_o{k}") for k, o in enumerate(order)])
    placed = running_sum(slim, F.col("_cost"), [F.col(f"_o{k}") for k in range(len(order))], name="written", below=target)
    return df.join(placed.select(*key, "written"), list(key))
