"""Interval and nearest joins of times against intervals, as equi-joins over time cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Width of a time cell where none is given.
CELL_US = 3_600_000_000
#: Cells that one interval may span before its middle is split off as a row of its own kind.
WIDE_CELLS = 1024


def interval_join(points: DataFrame, intervals: DataFrame, on: list[str], at: str, start: str, end: str, cell_us: int = CELL_US) -> DataFrame:
    """Each point with every interval of its key that contains it, both ends included.

    Intervals are copied to the cells they touch and points go to their cell, so the join is an
    equi-join that spreads one key's rows over its cells; a key that holds most rows is split as well.
    Intervals over more than WIDE_CELLS cells are copied to coarser cells, which points join too.
    Open intervals contain nothing.
    """
    closed = intervals.filter(F.col(start).isNotNull() & F.col(end).isNotNull() & (F.col(start) <= F.col(end)))
    span = F.floor(F.col(end) / cell_us) - F.floor(F.col(start) / cell_us)
    level = F.greatest(F.lit(0), F.ceil(F.log(F.greatest(span, F.lit(1)) / WIDE_CELLS) / F.log(F.lit(WIDE_CELLS)))).cast("int")
    width = F.pow(F.lit(float(WIDE_CELLS)), F.col("_level")).cast("long") * cell_us
    cells = closed.withColumn("_level", level).withColumn("_w", width)
    cells = cells.withColumn("_cell", F.explode(F.sequence(F.floor(F.col(start) / F.col("_w")), F.floor(F.col(end) / F.col("_w"))))).drop("_w")
    levels = sorted(r["_level"] for r in cells.select("_level").distinct().collect()) or [0]  # a few numbers
    widths = F.array(*[F.struct(F.lit(n).alias("_level"), F.floor(F.col(at) / (WIDE_CELLS**n * cell_us)).alias("_cell")) for n in levels])
    keyed = points.select("*", F.inline(widths))
    return keyed.join(cells, [*on, "_level", "_cell"]).filter(F.col(at).between(F.col(start), F.col(end))).drop("_level", "_cell")


def first_interval(points: DataFrame, intervals: DataFrame, key: list[str], on: list[str], at: str, start: str, end: str, order: list[str], cell_us: int = CELL_US) -> DataFrame:
    """(key, the first containing interval by ``order`` as struct ``hit``) of the points that have one."""
    names = [c for c in intervals.columns if c not in on]
    hits = interval_join(points.select(*key, *on, at), intervals, on, at, start, end, cell_us)
    return hits.groupBy(*key).agg(F.min_by(F.struct(*names), F.struct(*order)).alias("hit"))


def gaps(intervals: DataFrame, on: list[str], start: str, end: str) -> DataFrame:
    """(on, lo, hi, before, after): stretches that no interval of the key covers, with the ends of the intervals at either side.

    The first and last stretch are open; ``before`` is the largest end up to the stretch, ``after`` the
    least start behind it, null where there is none.  Neighbours of a time are so found by containment.
    """
    closed = intervals.filter(F.col(start).isNotNull() & F.col(end).isNotNull())
    by = W.partitionBy(*on).orderBy(start, end)
    seen = closed.select(*on, F.col(start).alias("_s"), F.col(end).alias("_e"), F.max(end).over(by.rowsBetween(W.unboundedPreceding, -1)).alias("_before"))
    inner = seen.filter(F.col("_before").isNull() | (F.col("_s") > F.col("_before"))).select(*on, F.col("_before").alias("before"), F.col("_s").alias("after"))
    last = closed.groupBy(*on).agg(F.max(end).alias("before")).select(*on, "before", F.lit(None).cast("long").alias("after"))
    return inner.unionByName(last)


def nearest(points: DataFrame, intervals: DataFrame, key: list[str], on: list[str], at: str, start: str, end: str) -> DataFrame:
    """Each point outside all intervals of its key with the nearest ones: every interval at the least distance.

    A point is joined with the one stretch between intervals that it lies in, and looks only at the two
    bounds of that, so the work does not grow with points times intervals.  Adds ``distance_us``.
    """
    far = 1 << 61
    free = gaps(intervals, on, start, end).select(*on, F.coalesce("before", F.lit(-far)).alias("_lo"), F.coalesce("after", F.lit(far)).alias("_hi"))
    free = free.withColumn("_from", F.col("_lo") + 1).withColumn("_to", F.col("_hi") - 1)
    rows = interval_join(points, free, on, at, "_from", "_to").drop("_from", "_to")
    down, up = F.col(at) - F.col("_lo"), F.col("_hi") - F.col(at)
    rows = rows.withColumn("distance_us", F.least(down, up))
    sides = F.array_compact(F.array(F.when(down == F.col("distance_us"), F.struct(F.lit("end").alias("side"), F.col("_lo").alias("bound"))), F.when(up == F.col("distance_us"), F.struct(F.lit("start").alias("side"), F.col("_hi").alias("bound")))))
    rows = rows.select("*", F.inline(sides)).drop("_lo", "_hi")
    bounds = intervals.withColumn("_b", F.explode(F.array(F.struct(F.lit("end").alias("side"), F.col(end).alias("bound")), F.struct(F.lit("start").alias("side"), F.col(start).alias("bound")))))
    bounds = bounds.select("*", "_b.side", "_b.bound").drop("_b")
    return rows.join(bounds, [*on, "side", "bound"]).drop("side", "bound").dropDuplicates([*key, *[c for c in intervals.columns if c not in on]])


def nearest_few(points: DataFrame, cycles: DataFrame, key: list[str], on: list[str], at: str, order: str, n: int = 3) -> DataFrame:
    """Up to ``n`` nearest cycles of each point outside all of them, with ``distance_us`` and ``place`` from 1; ties by ``order``.

    Cycles must not overlap.  A point's stretch tells how many cycles lie before it, so it is joined with
    n cycles to either side and no others.
    """
    by, far = W.partitionBy(*on).orderBy("start_us"), 1 << 61
    numbered = cycles.withColumn("_i", F.row_number().over(by))
    behind = numbered.select(*on, "_i", (F.col("end_us") + 1).alias("_from"), (F.coalesce(F.lead("start_us").over(by), F.lit(far)) - 1).alias("_to"))
    front = numbered.filter("_i = 1").select(*on, F.lit(0).alias("_i"), F.lit(-far).alias("_from"), (F.col("start_us") - 1).alias("_to"))
    placed = interval_join(points, behind.unionByName(front), on, at, "_from", "_to").drop("_from", "_to")
    sides = placed.withColumn("_i", F.explode(F.sequence(F.col("_i") - n + 1, F.col("_i") + n)))
    rows = sides.join(numbered, [*on, "_i"]).drop("_i").withColumn("distance_us", F.greatest(F.col("start_us") - F.col(at), F.col(at) - F.col("end_us")))
    rows = rows.withColumn("place", F.row_number().over(W.partitionBy(*key).orderBy("distance_us", order)))
    return rows.filter(F.col("place") <= n)


def half_gap_limits(cycles: DataFrame, on: list[str], order: list[str]) -> DataFrame:
    """Adds lower_us and upper_us: the middles of the gaps to the cycles before and behind, in list order; null where there is no gap.

    The lower limit is a microsecond behind the middle, so that neighbours never share an instant.  Cycles
    without any bound have no place in the order and no limits.
    """
    from slotwise.functions.times import midpoint_us

    known = F.col("start_us").isNotNull() | F.col("end_us").isNotNull()
    by = W.partitionBy(*on, known).orderBy(*order)
    before, after = F.lag("end_us").over(by), F.lead("start_us").over(by)
    lower = F.when(known & (F.col("start_us") > before), midpoint_us(before, F.col("start_us")) + 1)
    upper = F.when(known & (after > F.col("end_us")), midpoint_us(F.col("end_us"), after))
    return cycles.select("*", lower.alias("lower_us"), upper.alias("upper_us"))


def clamped(start: Column, end: Column, lower: Column, upper: Column, base_start: Column, base_end: Column) -> Column:
    """struct(start_us, end_us) within the limits; the base bounds if nothing would be left."""
    lo, hi = F.greatest(start, lower), F.least(end, upper)
    none = start.isNull() | end.isNull()
    good = F.struct(lo.alias("start_us"), hi.alias("end_us"))
    base = F.struct(base_start.alias("start_us"), base_end.alias("end_us"))
    return F.when(none, F.lit(None)).when(lo > hi, base).otherwise(good)
