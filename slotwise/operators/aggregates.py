"""Aggregations over files, times, entries, cycles and stages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def coverage(files: DataFrame, stamps: DataFrame) -> DataFrame:
    """One row: scopes and files by family, times, and the first and last time (without offset: as UTC, shown as they are)."""
    f = files.agg(
        F.countDistinct(F.when(F.col("family") == "diagnostic", F.col("scope"))).alias("diagnostic_scopes"),
        F.countDistinct(F.when(F.col("family") == "journal", F.struct("scope", F.coalesce("cpu", F.lit(""))))).alias("private_scopes"),
        F.countDistinct(F.when(F.col("family") == "diagnostic", F.struct("scope", "name"))).alias("diagnostic_files"), F.count_if(F.col("family") == "journal").alias("journal_files"),
    )
    t = stamps.agg(F.count(F.lit(1)).alias("timestamps"), F.min_by("ts_local", "ts_us").alias("first_time"), F.max_by("ts_local", "ts_us").alias("last_time"))
    return f.join(F.broadcast(t))  # one row each


def slot_table(files: DataFrame, periods: DataFrame, active: DataFrame | None) -> DataFrame:
    """A row a diagnostic slot: has_logs, n_periods, is_active."""
    slots = files.filter("family = 'diagnostic'").groupBy(F.col("scope").alias("slot")).agg(F.lit(True).alias("has_logs"))
    counts = periods.groupBy(F.col("scope").alias("slot")).agg(F.count(F.lit(1)).alias("n_periods"))
    out = slots.join(counts, "slot", "left").fillna(0, ["n_periods"])
    if active is None:
        return out.withColumn("is_active", F.lit(False))
    return out.join(active.distinct().withColumn("is_active", F.lit(True)), "slot", "left").fillna(False, ["is_active"])


def run_counters(files: DataFrame, lines: DataFrame, entries: DataFrame) -> DataFrame:
    """One row: discovered files, lines, and entries by module as a map."""
    by = entries.groupBy("module_key").count().agg(F.map_from_entries(F.collect_list(F.struct("module_key", "count"))).alias("entries"))
    return files.agg(F.count(F.lit(1)).alias("files")).join(F.broadcast(lines.agg(F.count(F.lit(1)).alias("lines")))).join(F.broadcast(by))


def counts_by_source(entries: DataFrame) -> DataFrame:
    return entries.groupBy("module_key").agg(F.count_if(F.col("source") == "diagnostic").alias("diagnostic"), F.count_if(F.col("source") == "journal").alias("journal"))


def time_bounds(entries: DataFrame, by: list[str]) -> DataFrame:
    return entries.groupBy(*by).agg(F.min("ts_us").alias("start_us"), F.max("ts_us").alias("end_us"))


def module_summary(cycles: DataFrame, processes: DataFrame) -> DataFrame:
    """(module_key, slots, processes)."""
    joined = cycles.join(processes, cycles["id"] == processes["cycle_id"], "left")
    return joined.groupBy("module_key").agg(F.countDistinct("slot").alias("slots"), F.count("process_name").alias("processes"))


def cycle_totals(processes: DataFrame) -> DataFrame:
    return processes.groupBy("cycle_id").agg(F.count(F.lit(1)).alias("n_processes"), F.sum("total_count").alias("total_count"))


def distinct_members(entries: DataFrame, by: list[str]) -> DataFrame:
    """Sorted sets of slots, processes and pids; pids sort as text."""
    return entries.groupBy(*by).agg(*[F.sort_array(F.collect_set(c)).alias(f"{c}s") for c in ("slot", "process_name", "pid")])


def stage_tree(stages: DataFrame) -> DataFrame:
    """Dotted stage names rolled up: a stage's seconds count for each of its ancestors, its metrics only for itself."""
    parts = F.split("name", r"\.")
    depths = F.sequence(F.lit(1), F.size(parts))
    each = stages.withColumn("_d", F.explode(depths)).withColumn("path", F.array_join(F.slice(parts, 1, F.col("_d")), "."))
    own = F.col("_d") == F.size(parts)
    return each.groupBy("path").agg(F.sum("seconds").alias("seconds"), F.count_if(own).alias("calls"), F.sum(F.when(own, F.col("items"))).alias("items"))


def performance_summary(stages: DataFrame, top: int = 5, most: int = 10) -> tuple[DataFrame, DataFrame]:
    """The slowest stages, and at most ``most`` stages whose status is not good."""
    slow = stages.orderBy(F.desc("seconds"), "name").limit(top)
    return slow, stages.filter("status not in ('success', 'skipped')").orderBy("name").limit(most)


def issue_counts(issues: DataFrame) -> DataFrame:
    """One row: issues by severity; anything unheard of is a warning."""
    severity = F.when(F.lower("severity").isin("error", "info", "warning"), F.lower("severity")).otherwise("warning")
    return issues.agg(*[F.count_if(severity == s).alias(f"{s}s") for s in ("error", "warning", "info")])


def unknown_count(final: DataFrame) -> DataFrame:
    """Entries of which the board or the CPU cycle is not known."""
    return final.agg(F.count_if(F.col("board_id").isNull() | ((F.col("cpu_id") != "") & F.col("own_id").isNull())).alias("unknown"))


def best_by_count(rows: DataFrame, by: list[str], value: str, count: str, order: str) -> DataFrame:
    """The value of the largest count, the earliest of equal ones."""
    return rows.groupBy(*by).agg(F.max_by(value, F.struct(F.col(count), -F.col(order))).alias(value))


def first_seen(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """Distinct keys in order of first occurrence."""
    return rows.groupBy(*key).agg(F.min(order).alias(order)).orderBy(order)


# -- lines ------------------------------------------------------------------------------------------


def line_window(lines: DataFrame, at_us: int, before: int = 24, size: int = 48, by: list[str] | None = None) -> DataFrame:
    """Per file: up to ``size`` lines around the one nearest in time, ``before`` of them in front.

    Of equally near lines the first is the target.  A file without any time gives its first and last
    ``before`` lines.  ``lines`` has line_no, line and ts_us (null without a time).
    """
    by = by or ["path"]
    near = lines.groupBy(*by).agg(F.min_by("line_no", F.when(F.col("ts_us").isNotNull(), F.struct(F.abs(F.col("ts_us") - at_us), F.col("line_no")))).alias("_at"), F.min("line_no").alias("_lo"), F.max("line_no").alias("_hi"))
    rows = lines.join(near, by)
    start = F.greatest(F.col("_at") - before, F.col("_lo"))
    inside = (F.col("line_no") >= start) & (F.col("line_no") < start + size)
    ends = (F.col("line_no") < F.col("_lo") + before) | (F.col("line_no") > F.col("_hi") - before)
    return rows.filter(F.when(F.col("_at").isNull(), ends).otherwise(inside)).withColumn("is_target", F.coalesce(F.col("line_no") == F.col("_at"), F.lit(False))).drop("_at", "_lo", "_hi")


def line_ranges(lines: DataFrame, by: list[str]) -> DataFrame:
    """Consecutive line numbers as (first_line, last_line)."""
    number = F.row_number().over(W.partitionBy(*by).orderBy("line_no"))
    return lines.select(*by, "line_no").distinct().withColumn("_g", F.col("line_no") - number).groupBy(*by, "_g").agg(F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line")).drop("_g")


def within_bytes(lines: DataFrame, by: list[str], budget: int) -> DataFrame:
    """Lines, in order, until ``budget`` UTF-8 bytes with their line ends are used; the last is cut between characters."""
    size = F.octet_length("line") + 1
    used = F.sum(size).over(W.partitionBy(*by).orderBy("line_no").rowsBetween(W.unboundedPreceding, 0))
    rows = lines.withColumn("_left", budget - (used - size)).filter("_left > 0")
    data, left = F.col("line").cast("binary"), F.col("_left").cast("int")
    # A cut before a continuation byte (80 to BF) goes back to the start of its character.
    inside = lambda k: F.hex(F.substring(data, left - k + 1, F.lit(1))).between("80", "BF")
    n = left - F.when(~inside(0), 0).when(~inside(1), 1).when(~inside(2), 2).otherwise(3)
    whole = F.octet_length("line") <= left
    return rows.withColumn("line", F.when(whole, F.col("line")).otherwise(F.decode(F.substring(data, F.lit(1), F.when(whole, 0).otherwise(n)), "UTF-8"))).drop("_left")
