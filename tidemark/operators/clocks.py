"""Hybrid clocks as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def now(events: DataFrame, node: str, order: str, physical: Column, start: int = 0) -> DataFrame:
    """``events`` with ``packed``: the stamp that each gets from its node's clock, [63:16] physical, [15:0] counter.

    A clock takes the physical time if that is later than its own, else counts on; a full counter carries over. As a packed number
    that is max(physical, last + 1), so a running maximum gives it without a fold. Clocks begin at the packed ``start``.
    """
    w = Window.partitionBy(node).orderBy(order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    numbered = events.withColumn("__i", F.row_number().over(w).cast("bigint")).withColumn("__at", F.shiftleft(physical.cast("bigint"), 16) - F.col("__i"))
    return numbered.withColumn("packed", F.col("__i") + F.greatest(F.lit(start).cast("bigint"), F.max("__at").over(upto))).drop("__i", "__at")
