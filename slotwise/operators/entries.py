"""Operators on entries: order, dedup, zone fill, canonical names, filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotwise.functions import text, times

#: What makes two entries the same: all but where they were read.
IDENTITY = ["module_key", "_iso", "slot", "cpu_id", "process_name", "pid", "context", "sequence", "is_active_signal", "raw"]
#: Order of entries in lifecycles; entries without a time come first.
ORDER = ["ts_us", "sequence", "source_file", "raw"]


def flat(entries: DataFrame) -> DataFrame:
    """The stamp's parts as columns."""
    return entries.select("*", "stamp.ts_local", "stamp.tz_offset_s", "stamp.ts_us").drop("stamp")


def deduplicated(entries: DataFrame) -> DataFrame:
    """The first entry, by file and line, of those with the same content; equal instants of different offsets differ.

    ``min_by`` over a total order combines on the map side, so content that comes very often is reduced
    before it is shuffled.
    """
    rows = entries.withColumn("_iso", times.iso(F.col("stamp.ts_local"), F.col("stamp.tz_offset_s")))
    rest = [c for c in entries.columns if c not in IDENTITY and c != "stamp"]
    first = F.min_by(F.struct("stamp", *rest), F.struct("file_ord", "line_no"))
    out = rows.groupBy(*IDENTITY).agg(first.alias("_first"))
    return out.select(*[c for c in IDENTITY if c != "_iso"], "_first.*").select(*entries.columns)


def first_offset(entries: DataFrame, order: list[str], stamp: str = "stamp") -> int | None:
    """The offset of the first stamp that has one: one row, taken to the driver."""
    found = entries.filter(F.col(f"{stamp}.tz_offset_s").isNotNull()).agg(F.min_by(F.col(f"{stamp}.tz_offset_s"), F.struct(*order)).alias("o")).first()
    return None if found is None else found["o"]


def zone_filled(entries: DataFrame) -> DataFrame:
    """Journals without an offset take the first of the diagnostics; then all without one take the first of any."""
    rows = entries
    journal = first_offset(rows.filter(F.col("source") == "diagnostic"), ["file_ord", "line_no"])
    if journal is not None:
        filled = times.filled(F.col("stamp"), F.lit(journal))
        rows = rows.withColumn("stamp", F.when(F.col("source") == "journal", filled).otherwise(F.col("stamp")))
    return offset_filled(rows, first_offset(rows, ["file_ord", "line_no"]))


def offset_filled(entries: DataFrame, offset_s: int | None) -> DataFrame:
    return entries if offset_s is None else entries.withColumn("stamp", times.filled(F.col("stamp"), F.lit(offset_s)))


def canonical(entries: DataFrame, mapping: dict[str, list[str]]) -> DataFrame:
    """Aliases (case folded) as their canonical process name, cpu '0' and null as ''.  The mapping is configuration, so small."""
    pairs = {a.casefold(): name for name, aliases in mapping.items() for a in (name, *aliases)}
    name = F.col("process_name")
    if pairs:
        table = F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])
        name = F.coalesce(F.try_element_at(table, text.folded(name)), name)
    return entries.withColumn("process_name", name).withColumn("cpu_id", text.plain_cpu(F.col("cpu_id")))


def timed(entries: DataFrame) -> DataFrame:
    return entries.filter(F.col("ts_us").isNotNull())


def total_order() -> list[Column]:
    return [F.col("ts_us").asc_nulls_first(), F.col("sequence"), F.col("source_file"), F.col("raw"), F.col("file_ord"), F.col("line_no")]


def with_ordinals(entries: DataFrame) -> DataFrame:
    """``entry_ord``: a global rank by file and line, without gathering the rows in one task."""
    from slotwise.operators.ordering import row_numbers

    return row_numbers(entries, ["file_ord", "line_no"], "entry_ord")
