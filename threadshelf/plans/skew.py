"""Joins and lists that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadshelf.plans.lineage import cut
from threadshelf.plans.sizes import MAX_BROADCAST_ROWS, cut_and_fits


def lookup_join(
    facts: DataFrame,
    lookup: DataFrame,
    on: list[str],
    how: str = "left",
    wide: bool = False,
    max_broadcast_rows: int = MAX_BROADCAST_ROWS,
) -> DataFrame:
    """Join facts to a lookup that has one row per key.

    The lookup is written down, so that its plan runs once and its size can be measured. One
    of checked size is broadcast. Beyond that both sides are plain exchanges, and adaptive
    execution splits the partitions of a frequent key and copies its few lookup rows. Rows of
    a `wide` lookup hold texts of any length and are never broadcast.
    """
    if wide:
        return facts.join(cut(lookup), on, how)
    written, small = cut_and_fits(lookup, max_broadcast_rows)
    return facts.join(F.broadcast(written) if small else written, on, how)


def numbered_lists(rows: DataFrame, key: str, order_id: str, value: Column, name: str) -> DataFrame:
    """Ordered lists as rows: (key, position, value), position counting from 1.

    `order_id` is unique within the key; ties are broken by the value. A list of any length is
    sorted in one run that can spill, and nothing of it is held in one cell.
    """
    members = rows.select(key, F.col(order_id).alias("_order"), value.alias(name))
    order = Window.partitionBy(key).orderBy("_order", name)
    return members.withColumn("position", F.row_number().over(order)).select(key, "position", name)
