"""Order over tables of any size: global ranks and gap segments without a task that sees a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from slotwise.storage import cut


def row_numbers(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """0-based global row numbers by ``order``, which must be total.

    Rows are range-partitioned and sorted; one row a partition goes through the window that adds up the
    partitions' sizes.  The sorted table is cut from its lineage, as both passes must see the same partitions.
    """
    sorted_rows = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_pos", F.monotonically_increasing_id()))
    numbered = sorted_rows.withColumn("_pid", F.shiftright("_pos", 33))
    sizes = numbered.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.select("_pid", F.coalesce(F.sum("_n").over(W.orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    return numbered.join(F.broadcast(starts), "_pid").withColumn(name, F.col("_start") + F.col("_pos").bitwiseAND((1 << 33) - 1)).drop("_pid", "_pos", "_start")


def gap_segments(rows: DataFrame, group: list[str], us: str, gap_us: int, inclusive: bool) -> DataFrame:
    """(group, _cell, segment, from_us, to_us): which gap segment each time cell of a group belongs to.

    A segment ends where the next time is ``gap_us`` or more later (``inclusive``), or more than that.
    Times in one cell of that width are closer than the gap, so they never part: rows are first reduced
    to one row a cell, on the map side too, and only cells go through windows.  ``from_us`` and
    ``to_us`` are the segment's bounds; ``segment`` counts from 0.
    """
    cells = rows.groupBy(*group, F.floor(F.col(us) / gap_us).alias("_cell")).agg(F.min(us).alias("_lo"), F.max(us).alias("_hi"))
    by = W.partitionBy(*group).orderBy("_cell")
    step = F.col("_lo") - F.lag("_hi").over(by)
    breaks = F.coalesce((step >= gap_us) if inclusive else (step > gap_us), F.lit(False))
    cells = cells.withColumn("_break", breaks.cast("int")).withColumn("segment", F.sum("_break").over(by.rowsBetween(W.unboundedPreceding, 0)).cast("int"))
    of = W.partitionBy(*group, "segment")
    return cells.select(*group, "_cell", "segment", F.min("_lo").over(of).alias("from_us"), F.max("_hi").over(of).alias("to_us"))


def cell_of(us: Column, gap_us: int) -> Column:
    return F.floor(us / gap_us)
