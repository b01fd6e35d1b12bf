"""Positions in a total order.

One entity may own a third of all rows, so nothing nested or concatenated is built per entity: long outputs are ordered
rows, and their positions come from range partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.session import cut_lineage


def global_row_number(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """1-based position in a total order without moving all rows into one task.

    Rows are range-partitioned and sorted locally; the per-partition counts (one row per partition)
    give the offsets. The order must end in a unique column.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slot = F.monotonically_increasing_id()
    placed = cut_lineage(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_slot", slot))
    pid = F.shiftright("_slot", 33)
    local = F.col("_slot").bitwiseAND(F.lit((1 << 33) - 1))
    counts = placed.groupBy(pid.alias("_pid")).agg(F.count("*").alias("_n"))
    # `counts` has one row per range partition, so this window is a fixed small size.
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return (
        placed.withColumn("_pid", pid)
        .join(F.broadcast(offsets), "_pid")
        .withColumn(name, local + F.col("_before") + 1)
        .drop("_pid", "_slot", "_before")
    )
