"""Restart-to-restart lifecycles of boards and CPUs from time gaps and process evidence.

A silent gap of 30 s ends a candidate segment.  Neighbouring candidates belong to one lifecycle unless
evidence speaks for a restart: a reliable process's sequence numbers start over, or it changes its pid.
Each piece of evidence is an interval of candidates (j, i]: some boundary in it must be kept.  Taking
candidates from left to right and keeping a boundary only where an interval would end without one is
the same as folding segments together, but needs only the intervals, of which there are as many as
restarts, and not the rows.

``entries`` have the flat columns of ``entries.flat`` after ``entries.canonical``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from slotwise.functions import times
from slotwise.operators.entries import timed
from slotwise.operators.ordering import cell_of, gap_segments
from slotwise.storage import cut

SILENT_GAP_US = 30_000_000


@dataclass
class Lifecycles:
    """Results by table; ``placed`` are the timed entries with lifecycle_id and cpu_lifecycle_id."""

    candidates: DataFrame
    decisions: DataFrame
    lifecycles: DataFrame
    evidence: DataFrame
    issues: DataFrame
    placed: DataFrame


def active_periods(stamps: DataFrame, group: list[str], us: str, gap_seconds: int) -> DataFrame:
    """(group, period, start_us, end_us): a new period only where the gap is larger than the threshold."""
    cells = gap_segments(stamps, group, us, gap_seconds * 1_000_000, inclusive=False)
    return cells.groupBy(*group, F.col("segment").alias("period")).agg(F.first("from_us").alias("start_us"), F.first("to_us").alias("end_us"))


def candidate_segments(rows: DataFrame, scope: list[str], gap_us: int = SILENT_GAP_US) -> tuple[DataFrame, DataFrame]:
    """The scope's segments (candidate_index, start_us, end_us, log_count), and the rows with their candidate_index."""
    cells = cut(gap_segments(rows, scope, "ts_us", gap_us, inclusive=True))
    placed = rows.withColumn("_cell", cell_of(F.col("ts_us"), gap_us)).join(cells.select(*scope, "_cell", F.col("segment").alias("candidate_index")), [*scope, "_cell"]).drop("_cell")
    counts = placed.groupBy(*scope, "candidate_index").agg(F.min("ts_us").alias("start_us"), F.max("ts_us").alias("end_us"), F.count(F.lit(1)).alias("log_count"))
    return cut(counts), placed


def _by(entry: str = "ts_us") -> Column:
    return F.struct(entry, "sequence", "source_file", "raw", "file_ord", "line_no")


def restart_intervals(placed: DataFrame, scope: list[str], reliable: list[str], multi: list[str], evidence: Column) -> DataFrame:
    """(scope, i, after, reason, process_name, old, new): some boundary behind candidate ``after``, up to that before ``i``, is one.

    Only rows under ``evidence`` of reliable processes count.  They are reduced to one row a candidate and
    process before anything is compared.
    """
    rows = placed.filter(evidence & F.col("process_name").isin(reliable)) if reliable else placed.limit(0)
    numbered = F.col("sequence") > 0
    summary = cut(rows.groupBy(*scope, "candidate_index", "process_name").agg(
        F.min_by("sequence", F.when(numbered, _by())).alias("first"), F.max_by("sequence", F.when(numbered, _by())).alias("last"), F.count(F.when(numbered, 1)).alias("n"),
        F.array_sort(F.collect_set(F.when(F.col("pid") != "", F.col("pid")))).alias("pids"),
    ))
    i = F.col("candidate_index")
    before = W.partitionBy(*scope, "process_name").orderBy("candidate_index")

    def seen(rows: DataFrame, value: str) -> DataFrame:
        return rows.withColumn("_at", F.lag("candidate_index").over(before)).withColumn("_old", F.lag(value).over(before))

    keep = [*scope, "i", "after", "reason", "process_name", "old", "new"]
    wraps = seen(summary.filter("n > 0"), "last").filter(F.col("first") < F.col("_old"))
    wraps = wraps.select(*scope, i.alias("i"), F.col("_at").alias("after"), F.lit("journal_wrap").alias("reason"), "process_name", F.col("_old").cast("string").alias("old"), F.col("first").cast("string").alias("new"))
    pids = seen(summary.filter((F.size("pids") > 0) & (~F.col("process_name").isin(multi) if multi else F.lit(True))), "pids")
    text = lambda c: F.concat_ws(",", c)
    moved = pids.filter(F.size(F.array_union("_old", "pids")) > 1).select(*scope, i.alias("i"), F.col("_at").alias("after"), F.lit("reliable_pid_conflict").alias("reason"), "process_name", text("_old").alias("old"), text("pids").alias("new"))
    # Two pids in one candidate keep it apart from either neighbour.
    inside = pids.filter(F.size("pids") > 1).withColumn("i", F.explode(F.array(i, i + 1)))
    inside = inside.select(*scope, "i", (F.col("i") - 1).alias("after"), F.lit("reliable_pid_conflict").alias("reason"), "process_name", text("pids").alias("old"), text("pids").alias("new"))
    return wraps.select(*keep).unionByName(moved.select(*keep)).unionByName(inside.select(*keep))


def kept_boundaries(intervals: DataFrame, scope: list[str]) -> DataFrame:
    """(scope, i, last): boundaries before candidate ``i`` that stay, and the one kept before (0: none)."""
    marks = intervals.filter("i > 0").groupBy(*scope, "i").agg(F.max("after").alias("after"))
    each = F.array_sort(F.collect_list(F.struct("i", "after")))
    none = F.array().cast("array<struct<i:int,last:int>>")

    def step(state: Column, mark: Column) -> Column:
        cut = F.struct(mark["i"].alias("i"), state["last"].alias("last"))
        more = F.struct(mark["i"].alias("last"), F.concat(state["cuts"], F.array(cut)).alias("cuts"))
        return F.when(mark["after"] >= state["last"], more).otherwise(state)

    start = F.struct(F.lit(0).alias("last"), none.alias("cuts"))
    cuts = marks.groupBy(*scope).agg(F.aggregate(each, start, step, lambda s: s["cuts"]).alias("cuts"))
    return cuts.select(*scope, F.explode("cuts").alias("c")).select(*scope, "c.i", "c.last")


def _scope_lifecycles(rows: DataFrame, scope: list[str], name: str, reliable: list[str], multi: list[str], evidence: Column, gap_us: int) -> tuple:
    """candidates, decisions, evidence, lifecycles and placed rows of one kind of scope.

    Only tables of cells, segments and restarts are cut from their lineage, never the entries.
    """
    candidates, placed = candidate_segments(rows, scope, gap_us)
    intervals = restart_intervals(placed, scope, reliable, multi, evidence)
    cuts = kept_boundaries(intervals, scope)
    at = W.partitionBy(*scope).orderBy("candidate_index")
    marked = candidates.join(cuts.withColumnRenamed("i", "candidate_index"), [*scope, "candidate_index"], "left")
    marked = marked.withColumn("lifecycle_index", F.count("last").over(at.rowsBetween(W.unboundedPreceding, 0)).cast("int"))
    marked = cut(marked)
    gap = (F.col("start_us") - F.lag("end_us").over(at)) / 1_000_000
    reasons = intervals.join(cuts, [*scope, "i"]).filter("after >= last")
    why = reasons.groupBy(*scope, F.col("i").alias("candidate_index")).agg(F.min("reason").alias("reason"))  # journal_wrap goes first
    decided = marked.withColumn("gap_seconds", gap).join(why, [*scope, "candidate_index"], "left").filter("candidate_index > 0")
    decisions = decided.select(F.lit(name).alias("scope"), *scope, (F.col("candidate_index") - 1).alias("left_index"), F.col("candidate_index").alias("right_index"), F.when(F.col("last").isNull(), "merged").otherwise("kept_split").alias("decision"), "reason", "gap_seconds")
    proof = reasons.filter(F.col("reason") == "journal_wrap").select(F.lit(name).alias("scope"), *scope, F.col("i").alias("right_index"), "process_name", F.col("old").cast("int").alias("old_sequence"), F.col("new").cast("int").alias("new_sequence"))
    lives = marked.groupBy(*scope, "lifecycle_index").agg(F.array_sort(F.collect_list("candidate_index")).alias("candidate_indices"), F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.sum("log_count").alias("log_count"))
    named = placed.join(marked.select(*scope, "candidate_index", "lifecycle_index"), [*scope, "candidate_index"]).drop("candidate_index")
    return candidates.select(F.lit(name).alias("scope"), "*"), decisions, proof, lives.select(F.lit(name).alias("scope"), "*"), named


def board_lifecycles(entries: DataFrame, reliable: tuple[str, ...] = (), multi: tuple[str, ...] = (), gap_us: int = SILENT_GAP_US) -> DataFrame:
    """(slot, lifecycle_index, candidate_indices, start_us, end_us, log_count) where CPUs are of no interest."""
    return _scope_lifecycles(timed(entries), ["slot"], "board", list(reliable), list(multi), F.col("cpu_id") == "", gap_us)[3]


def lifecycle_id(scope: str, slot: Column, cpu: Column, parent: Column, index: Column) -> Column:
    return F.concat_ws(":", F.lit(scope), slot, cpu, parent, F.lit("lifecycle"), index.cast("string"))


def split(entries: DataFrame, reliable: tuple[str, ...] = (), multi: tuple[str, ...] = (), gap_us: int = SILENT_GAP_US) -> Lifecycles:
    """Board lifecycles of every slot, over all its rows, and CPU lifecycles inside each of them.

    Boards are judged by rows without a cpu only, CPUs by all their rows.  Entries without a time take no
    part.  A process can't be both reliable and multi-instance.
    """
    both = sorted({r.casefold() for r in reliable} & {m.casefold() for m in multi})
    if both:
        raise ValueError(f"processes are both reliable and multi-instance: {both}")
    reliable, multi, rows = list(reliable), list(multi), timed(entries)
    board = _scope_lifecycles(rows, ["slot"], "board", reliable, multi, F.col("cpu_id") == "", gap_us)
    boards = board[3].withColumn("cpu_id", F.lit(None).cast("string")).withColumn("parent_lifecycle_id", F.lit(""))
    boards = boards.withColumn("id", lifecycle_id("board", F.col("slot"), F.lit("board"), F.lit("root"), F.col("lifecycle_index")))
    placed = board[4].withColumn("lifecycle_id", lifecycle_id("board", F.col("slot"), F.lit("board"), F.lit("root"), F.col("lifecycle_index"))).drop("lifecycle_index")

    inner = placed.filter(F.col("cpu_id") != "").withColumn("parent_lifecycle_id", F.col("lifecycle_id"))
    scope = ["slot", "cpu_id", "parent_lifecycle_id"]
    cpu = _scope_lifecycles(inner, scope, "cpu", reliable, multi, F.lit(True), gap_us)
    own = lifecycle_id("cpu", F.col("slot"), F.col("cpu_id"), F.col("parent_lifecycle_id"), F.col("lifecycle_index"))
    cpus = cpu[3].withColumn("id", own)
    cpu_rows = cpu[4].withColumn("cpu_lifecycle_id", own).drop("lifecycle_index", "parent_lifecycle_id")
    placed = placed.filter(F.col("cpu_id") == "").unionByName(cpu_rows, allowMissingColumns=True)

    def with_scope(df: DataFrame) -> DataFrame:
        return df.withColumn("cpu_id", F.lit(None).cast("string")).withColumn("parent_lifecycle_id", F.lit(""))

    lives = boards.unionByName(cpus)
    lives, issues = cut(lives), cut(reliability_issues(placed, lives, reliable, multi))
    bad = issues.filter(F.col("severity") == "error").select(F.explode("affected").alias("id")).distinct()
    lives = lives.join(bad.withColumn("_bad", F.lit(True)), "id", "left").withColumn("lifecycle_reliable", F.col("_bad").isNull()).drop("_bad")
    return Lifecycles(
        with_scope(board[0]).unionByName(cpu[0]), with_scope(board[1]).unionByName(cpu[1]), lives, with_scope(board[2]).unionByName(cpu[2]), issues, placed,
    )


def process_pids(placed: DataFrame) -> DataFrame:
    """(id, process_name, pid): what each lifecycle is judged by."""
    boards = placed.filter(F.col("cpu_id") == "").select(F.col("lifecycle_id").alias("id"), "process_name", "pid")
    cpus = placed.filter(F.col("cpu_id") != "").select(F.col("cpu_lifecycle_id").alias("id"), "process_name", "pid")
    return boards.unionByName(cpus).filter(F.col("pid") != "").distinct()


def reliability_issues(placed: DataFrame, lives: DataFrame, reliable: list[str], multi: list[str]) -> DataFrame:
    """Errors: a reliable process with several pids in a lifecycle.  Warnings: one process and pid on both sides of a boundary."""
    pids = process_pids(placed)
    single = pids.filter(~F.col("process_name").isin(multi)) if multi else pids
    key = ["scope", "slot", "cpu_id", "parent_lifecycle_id"]
    named = lives.select("id", *key, "lifecycle_index")
    certain = single.filter(F.col("process_name").isin(reliable)) if reliable else single.limit(0)
    many = certain.groupBy("id", "process_name").agg(F.array_sort(F.collect_set("pid")).alias("pids")).filter(F.size("pids") > 1).join(named, "id")
    errors = many.select(F.lit("reliable_process_multiple_pid_in_lifecycle").alias("type"), F.lit("error").alias("severity"), *key, F.col("process_name").alias("related_process"), F.col("pids").alias("observed_pids"), F.array("id").alias("affected"))
    by = W.partitionBy(*key, "process_name", "pid").orderBy("lifecycle_index")
    again = single.join(named, "id").withColumn("_at", F.lag("lifecycle_index").over(by)).withColumn("_id", F.lag("id").over(by)).filter("_at = lifecycle_index - 1")
    warnings = again.select(F.lit("pid_reuse_assumption_violation").alias("type"), F.lit("warning").alias("severity"), *key, F.col("process_name").alias("related_process"), F.array("pid").alias("observed_pids"), F.array("_id", "id").alias("affected"))
    return errors.unionByName(warnings)


def merged_pidless(placed: DataFrame, cycle: list[str]) -> DataFrame:
    """Journal rows without a pid take the only pid that their process and cpu have in the cycle; with none or several they stay apart."""
    key = [*cycle, "process_name", "cpu_id"]
    only = placed.filter(F.col("pid") != "").groupBy(*key).agg(F.min("pid").alias("_least"), F.max("pid").alias("_most"))
    rows = placed.join(only, key, "left")
    takes = (F.col("pid") == "") & (F.col("source") == "journal") & (F.col("_least") == F.col("_most"))
    return rows.withColumn("pid", F.when(takes, F.col("_least")).otherwise(F.col("pid"))).drop("_least", "_most")


def missing_sequences(sequences: Column) -> Column:
    """Numbers between the least and the largest of a set of positive ones that are not in it."""
    some = F.filter(sequences, lambda s: s > 0)
    return F.when(F.size(some) > 1, F.array_except(F.sequence(F.array_min(some), F.array_max(some)), some)).otherwise(F.array().cast("array<int>"))


def processes(placed: DataFrame, cycle: list[str]) -> DataFrame:
    """(cycle, process_name, pid, cpu_id, total_count, missing_sequences), after pid-less journals found their process."""
    rows = merged_pidless(placed, cycle)
    groups = rows.groupBy(*cycle, "process_name", "pid", "cpu_id")
    return groups.agg(F.count(F.lit(1)).alias("total_count"), missing_sequences(F.collect_set("sequence")).alias("missing_sequences"))


def cycles(lives: Lifecycles) -> DataFrame:
    """(id, scope, slot, cpu_id, parent_id, cycle_ord, start_us, end_us, dir_name) of all board and CPU cycles."""
    at = W.partitionBy("slot").orderBy("scope", F.col("cpu_id").asc_nulls_first(), "start_us")
    rows = lives.lifecycles.withColumn("cycle_ord", (F.row_number().over(at) - 1).cast("int"))
    folder = times.cycle_dir(times.from_us(F.col("start_us")), times.from_us(F.col("end_us")))
    return rows.select("id", "scope", "slot", "cpu_id", F.col("parent_lifecycle_id").alias("parent_id"), "cycle_ord", "start_us", "end_us", folder.alias("dir_name"))


def cycle_processes(lives: Lifecycles) -> DataFrame:
    """(cycle_id, process_name, pid, total_count, missing_sequences): boards by rows without a cpu, CPUs by their own."""
    boards = processes(lives.placed.filter(F.col("cpu_id") == "").withColumn("cycle_id", F.col("lifecycle_id")), ["cycle_id"])
    cpus = processes(lives.placed.filter(F.col("cpu_id") != "").withColumn("cycle_id", F.col("cpu_lifecycle_id")), ["cycle_id"])
    return boards.unionByName(cpus).select("cycle_id", "process_name", "pid", "total_count", "missing_sequences")


def cycle_identity(start: Column, end: Column) -> Column:
    """interval:<start>..<end> to the microsecond, open sides as ``open``."""
    return F.concat(F.lit("interval:"), F.coalesce(times.iso_us(start), F.lit("open")), F.lit(".."), F.coalesce(times.iso_us(end), F.lit("open")))


def scope_reference(slot: Column, cpu: Column) -> Column:
    return F.concat(F.lit("slot:"), slot, F.when(F.coalesce(cpu, F.lit("")) == "", "").otherwise(F.concat(F.lit("/cpu:"), cpu)))


def roles(slots: DataFrame) -> DataFrame:
    """``role`` of slots with has_logs, n_periods and is_active (an active signal).

    Any active slot makes the others with logs standby.  Without one, the only slot with active periods is
    active and the others with logs are standby; with several nothing is known; with none, slots with
    logs are standby.  The table has a row a slot.
    """
    every = W.partitionBy()
    known, periods = F.max(F.col("is_active").cast("int")).over(every) == 1, F.count_if(F.col("n_periods") > 0).over(every)
    standby = F.when(F.col("has_logs"), "standby").otherwise("unknown")
    fallback = F.when(periods == 1, F.when(F.col("n_periods") > 0, "active").otherwise(standby)).when(periods > 1, "unknown").otherwise(standby)
    return slots.withColumn("role", F.when(F.col("is_active"), "active").when(known, standby).otherwise(fallback))


def active_slots(entries: DataFrame) -> DataFrame:
    return entries.filter("is_active_signal").select("slot").distinct()
