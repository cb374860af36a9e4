"""Consecutive numbers for tables of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coursemill.session import stash


def numbered(df: DataFrame, name: str, order: list[Column | str], copies: str | None = None) -> DataFrame:
    """``df`` with the numbers 1, 2, ... in a stated order in column ``name``. copies: a column of whole numbers above 0; a row takes so many numbers, and ``name`` has its first.

    Rows are dealt by ranges of the order and each range is sorted where it is; only the counts of
    the ranges, one row for each task, are summed up in one place. ``df`` is computed twice, to draw
    the ranges and to deal the rows, so it should be cheap to read.
    """
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    if copies:
        rows = rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), copies)))
    rows = rows.withColumn("_id", F.monotonically_increasing_id())
    if copies:
        rows = rows.filter("_copy = 1").drop("_copy")
    rows = stash(rows, "numbered")
    part = F.shiftright("_id", 33)
    counts = rows.groupBy(part.alias("_part")).agg((F.sum(copies) if copies else F.count("*")).alias("_rows"))
    before = counts.select("_part", F.coalesce(F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    within = F.col("_id") - F.shiftleft(part, 33)
    out = rows.withColumn("_part", part).join(F.broadcast(before), "_part")  # one row for each task
    return out.withColumn(name, F.col("_before") + within + 1).drop("_id", "_part", "_before")
