"""Global ranking without a single-partition window.

``row_number() OVER (ORDER BY ...)`` with no PARTITION BY moves every row to
one task.  Here the frame is range-partitioned on the sort key, sorted inside
each partition and frozen in the reliable checkpoint folder (so a recomputed
partition cannot change its boundaries); each row's global number is its
partition's offset (prefix sum of per-partition counts, a table of one row per
partition) plus its position inside the partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agora.session import cut_lineage


def global_row_number(df: DataFrame, order: list[Column], name: str = "rank",
                      num_partitions: int | None = None) -> DataFrame:
    # without an explicit count the range exchange may be coalesced by AQE
    ranged = df.repartitionByRange(num_partitions, *order) if num_partitions else df.repartitionByRange(*order)
    sorted_df = ranged.sortWithinPartitions(*order)
    sorted_df = sorted_df.withColumn("_pid", F.spark_partition_id()).withColumn(
        "_mid", F.monotonically_increasing_id()
    )
    sorted_df = cut_lineage(sorted_df)
    counts = sorted_df.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_first"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = counts.select("_pid", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1).alias("_rank_offset"))
    return sorted_df.join(F.broadcast(offsets), "_pid").withColumn(name, (F.col("_mid") + F.col("_rank_offset")).cast("long")).drop(
        "_pid", "_mid", "_rank_offset"
    )


def running_total(df: DataFrame, order: list[Column], amount: str, name: str) -> DataFrame:
    """``name``: the sum of ``amount`` over all rows before a row in the given
    order, without a single-partition window (as ``global_row_number``)."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = cut_lineage(ranged.withColumn("_pid", F.spark_partition_id()).withColumn("_mid", F.monotonically_increasing_id()))
    sums = ranged.groupBy("_pid").agg(F.sum(amount).alias("_rank_sum"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = sums.select("_pid", F.coalesce(F.sum("_rank_sum").over(before), F.lit(0)).alias("_rank_offset"))
    inside = Window.partitionBy("_pid").orderBy("_mid").rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.withColumn(name, F.coalesce(F.sum(amount).over(inside), F.lit(0)))
    return out.join(F.broadcast(offsets), "_pid").withColumn(name, F.col(name) + F.col("_rank_offset")).drop("_pid", "_mid", "_rank_offset")
