"""Global order without a global sort in one task.

Row numbers, running sums and separator counts over a whole table are computed in two levels: rows are
cut into ranges of the order key (``key div width``), each range is summed, a window over the small table
of ranges gives each range its offset, and windows inside ranges do the rest. The width follows the key's density, and a
table of many ranges is summed the same way again. Rows of one key stay in one range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Rows aimed at in a range, and ranges that one task may order.
ROWS, RANGES = 5000, 1_000_000


def running(df: DataFrame, order: str, amount: Column, name: str, width: int | None = None, extra: list[str] | None = None, ranges: int = RANGES) -> DataFrame:
    """``df`` with the running sum ``name`` of ``amount`` in the order of the bigint column ``order`` (then ``extra``)."""
    low, high, n = df.agg(F.min(order), F.max(order), F.count(order)).first()
    span = (high or 0) - (low or 0) + 1
    width = width or max(1, span * ROWS // max(1, n))
    rows = df.withColumns({"__range": F.expr(f"{order} div {width}"), "__amount": amount})
    sums = rows.groupBy("__range").agg(F.sum("__amount").alias("__sum"))
    if span // width > ranges:
        upto = running(sums.select(F.col("__range").alias("__at"), F.col("__sum").alias("__part")), "__at", F.col("__part"), "__upto", ranges=ranges)
        offsets = upto.select(F.col("__at").alias("__range"), (F.col("__upto") - F.col("__part")).alias("__offset"))
    else:
        offset = F.coalesce(F.sum("__sum").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        offsets = sums.select("__range", offset.alias("__offset"))
    within = Window.partitionBy("__range").orderBy(order, *(extra or [])).rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(offsets, "__range").withColumn(name, F.col("__offset") + F.sum("__amount").over(within)).select(*df.columns, name)


def numbered(df: DataFrame, order: str, name: str, width: int | None = None, extra: list[str] | None = None) -> DataFrame:
    """``df`` with its row number ``name`` from 1."""
    return running(df, order, F.lit(1).cast("bigint"), name, width, extra)


def separators_up_to(df: DataFrame, key: str, separators: DataFrame, name: str, width: int | None = None) -> DataFrame:
    """``df`` with the number of separators at or below its key (an equal key goes right)."""
    marks = separators.select(F.col(key).alias(key), F.lit(1).cast("bigint").alias("__mark"), F.lit(0).alias("__row"))
    for c in df.columns:
        if c != key:
            marks = marks.withColumn(c, F.lit(None).cast(df.schema[c].dataType))
    both = df.withColumns({"__mark": F.lit(0).cast("bigint"), "__row": F.lit(1)}).unionByName(marks)
    return running(both, key, F.col("__mark"), name, width, ["__row"]).where("__row = 1").select(*df.columns, name)
