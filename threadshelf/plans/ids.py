"""Row ids without a sequence: dense numbers above a high-water mark."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadshelf.plans.lineage import cut

# `monotonically_increasing_id` has the partition above so many bits of the row's place in it.
PLACE_BITS = 33


def number_rows(df: DataFrame, order_by: list[str], start_after: int, name: str = "id") -> DataFrame:
    """Number rows 1, 2, ... above `start_after`, in the order of the given columns.

    The rows are range-partitioned once, numbered inside their sorted partition as they are
    written, and shifted by the count of the partitions before it; nothing passes through a
    single task.
    """
    ranged = cut(
        cut(df)
        .repartitionByRange(*order_by)
        .sortWithinPartitions(*order_by)
        .withColumn("_place", F.monotonically_increasing_id())
    )
    placed = ranged.withColumn("_part", F.shiftright("_place", PLACE_BITS))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition
    offsets = (
        placed.groupBy("_part")
        .agg(F.count("*").alias("_n"))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .select("_part", "_offset")
    )
    row = F.col("_place").bitwiseAND(F.lit((1 << PLACE_BITS) - 1)) + 1
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn(name, (F.lit(start_after) + F.col("_offset") + row).cast("long"))
        .drop("_part", "_place", "_offset")
    )


def high_water_mark(table: DataFrame, column: str = "id") -> int:
    """Largest id given out so far. Keep it with the table: ids of deleted rows are not reused."""
    return table.agg(F.max(column)).first()[0] or 0
