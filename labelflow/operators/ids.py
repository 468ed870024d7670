"""Dense row numbers without sorting everything in one task.

Rows are sorted by ranges; a row's number is its partition's offset plus its
place in the partition. The sorted rows are stored with both, so a lost task
cannot renumber them; offsets are prefix sums over one count per partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import store

#: ``monotonically_increasing_id`` holds the place in the partition in its low bits.
PLACE_BITS = 33


def running_total(sizes: DataFrame, order: Sequence[str], size: str = "n", out: str = "offset") -> DataFrame:
    """The sum of ``size`` over the rows before each row of a small table (one row per partition or file)."""
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn(out, F.coalesce(F.sum(size).over(before), F.lit(0)))


def dense_ids(df: DataFrame, order: Sequence[Column], out: str = "id", start: int = 0) -> DataFrame:
    """The rows with ``out``, a gapless long from ``start`` in the given order.

    Ties in the order are numbered in any order, each row its own number; no
    group of equal leading columns is gathered in a task unless whole keys are
    equal. An empty table gives an empty table."""
    placed = store(df.repartitionByRange(*order).sortWithinPartitions(*order)
                   .withColumn("_at", F.monotonically_increasing_id()), "sorted")
    part, place = F.shiftright("_at", PLACE_BITS), F.col("_at").bitwiseAND((1 << PLACE_BITS) - 1)
    placed = placed.withColumn("_part", part)
    offsets = running_total(placed.groupBy("_part").agg(F.count("*").alias("n")), ["_part"]).select("_part", "offset")
    return placed.join(offsets, "_part").select(*df.columns, (F.lit(start) + F.col("offset") + place).cast("long").alias(out))
