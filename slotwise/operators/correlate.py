"""Correlation of a second log family to the cycles of the first.

``entries`` have the flat entry columns and entry_ord; ``cycles`` and ``processes`` are those of
``lifecycle``.  An entry goes to the cycle that contains its time; else its pid may tell which of the
nearest cycles it belongs to; else it is unknown, and is assigned once more by process or nearness.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from slotwise.functions import text, times
from slotwise.operators.intervals import first_interval, half_gap_limits, nearest, nearest_few
from slotwise.storage import cut

OPEN = "unknown"


@dataclass
class Upstream:
    """Board and CPU cycles with their half-gap limits, and the pids of their processes."""

    boards: DataFrame  # slot, board_id, ord, start_us, end_us, lower_us, upper_us
    cpus: DataFrame  # the same with cpu_id and own_id
    pids: DataFrame  # cycle_id, process_name, pid


def upstream(cycles: DataFrame, processes: DataFrame) -> Upstream:
    """Limits of a CPU cycle lie also within those of its board."""
    boards = cycles.filter(F.col("scope") == "board").select("slot", F.col("id").alias("board_id"), F.col("cycle_ord").alias("ord"), "start_us", "end_us")
    boards = half_gap_limits(boards, ["slot"], ["ord"])
    cpus = cycles.filter(F.col("scope") == "cpu").select("slot", F.col("parent_id").alias("board_id"), "cpu_id", F.col("id").alias("own_id"), F.col("cycle_ord").alias("ord"), "start_us", "end_us")
    cpus = half_gap_limits(cpus, ["slot", "board_id", "cpu_id"], ["ord"])
    limits = boards.select("slot", "board_id", F.col("lower_us").alias("_l"), F.col("upper_us").alias("_u"))
    cpus = cpus.join(limits, ["slot", "board_id"], "left").withColumn("lower_us", F.greatest("lower_us", "_l")).withColumn("upper_us", F.least("upper_us", "_u")).drop("_l", "_u")
    return Upstream(cut(boards), cut(cpus), cut(processes.select("cycle_id", "process_name", "pid").distinct()))


def time_matches(entries: DataFrame, up: Upstream) -> DataFrame:
    """(entry_ord, board_id, own_id): the first board cycle that contains the entry, and in it the first of its CPU's."""
    at = entries.filter("ts_us is not null").select("entry_ord", "slot", "cpu_id", "ts_us")
    board = first_interval(at, up.boards.select("slot", "board_id", "ord", "start_us", "end_us"), ["entry_ord", "slot", "cpu_id", "ts_us"], ["slot"], "ts_us", "start_us", "end_us", ["ord"])
    board = board.select("entry_ord", "slot", "cpu_id", "ts_us", "hit.board_id")
    inner = board.filter("cpu_id <> ''")
    cpu = first_interval(inner, up.cpus.select("slot", "board_id", "cpu_id", "own_id", "ord", "start_us", "end_us"), ["entry_ord"], ["slot", "board_id", "cpu_id"], "ts_us", "start_us", "end_us", ["ord"])
    return board.join(cpu.select("entry_ord", "hit.own_id"), "entry_ord", "left").select("entry_ord", "board_id", "own_id")


def pid_matches(entries: DataFrame, up: Upstream) -> DataFrame:
    """(entry_ord, board_id, own_id) for entries outside all board cycles whose pid occurs in exactly one best of the nearest.

    Cycles where the pid has the entry's process name beat those where it has another.  Of several, the
    only one that contains the time counts, else the only nearest one.
    """
    lost = entries.filter("ts_us is not null and pid <> ''").select("entry_ord", "slot", "cpu_id", "process_name", "pid", "ts_us")
    near = nearest(lost, up.boards.select("slot", "board_id", "ord", "start_us", "end_us"), ["entry_ord"], ["slot"], "ts_us", "start_us", "end_us")
    near = near.select("entry_ord", "slot", "cpu_id", "process_name", "pid", "ts_us", "board_id", F.col("start_us").alias("_s"), F.col("end_us").alias("_e"))
    own = near.filter("cpu_id = ''").select("*", F.lit(None).cast("string").alias("own_id"), F.col("board_id").alias("cycle_id"))
    cpus = up.cpus.select("slot", "board_id", "cpu_id", "own_id", F.col("start_us").alias("_cs"), F.col("end_us").alias("_ce"))
    inner = near.filter("cpu_id <> ''").join(cpus, ["slot", "board_id", "cpu_id"]).withColumn("_s", F.col("_cs")).withColumn("_e", F.col("_ce")).withColumn("cycle_id", F.col("own_id")).drop("_cs", "_ce")
    both = own.unionByName(inner.select(*own.columns))
    named = up.pids.withColumnRenamed("process_name", "_name")
    hits = both.join(named, ["cycle_id", "pid"]).withColumn("_same", F.col("_name") == F.col("process_name"))
    hits = hits.groupBy("entry_ord", "board_id", "own_id", "ts_us", "_s", "_e").agg(F.max("_same").alias("_same"))
    every = W.partitionBy("entry_ord")
    hits = hits.withColumn("_any", F.max("_same").over(every)).filter(F.col("_same") == F.col("_any"))
    inside, far = times.contains_closed(F.col("_s"), F.col("_e"), F.col("ts_us")), times.distance_closed_us(F.col("_s"), F.col("_e"), F.col("ts_us"))
    hits = hits.withColumn("_in", inside).withColumn("_far", F.coalesce(far, F.lit(1 << 62)))
    hits = hits.withColumn("_ins", F.count_if("_in").over(every)).withColumn("_n", F.count(F.lit(1)).over(every)).withColumn("_least", F.min("_far").over(every))
    best = F.when(F.col("_n") == 1, True).when(F.col("_ins") > 0, F.col("_in")).otherwise(F.col("_far") == F.col("_least"))
    best = hits.filter(best).withColumn("_left", F.count(F.lit(1)).over(every)).filter("_left = 1")
    return best.select("entry_ord", "board_id", "own_id")


def pid_elsewhere(matched: DataFrame, up: Upstream) -> DataFrame:
    """(entry_ord): entries placed by time whose pid also occurs in another cycle of their slot (and CPU)."""
    boards = up.boards.select("slot", F.lit("").alias("cpu_id"), "board_id", F.col("board_id").alias("cycle_id"))
    cpus = up.cpus.select("slot", "cpu_id", "board_id", F.col("own_id").alias("cycle_id"))
    where = boards.unionByName(cpus).join(up.pids.select("cycle_id", "pid").distinct(), "cycle_id").withColumnRenamed("cycle_id", "_other")
    rows = matched.filter("pid <> '' and board_id is not null").select("entry_ord", "slot", "cpu_id", "pid", F.when(F.col("cpu_id") == "", F.col("board_id")).otherwise(F.coalesce("own_id", F.lit(""))).alias("_own"))
    return rows.join(where, ["slot", "cpu_id", "pid"]).filter("_other <> _own").select("entry_ord").distinct()


def matches(entries: DataFrame, up: Upstream) -> DataFrame:
    """``entries`` with board_id, own_id (CPU cycle), status and reason of their first match.

    No slot upstream, no time, a cycle that contains it, the pid, or nothing, in this order.
    """
    slots = up.boards.select("slot").distinct().withColumn("_known", F.lit(True))
    rows = entries.join(slots, "slot", "left")
    by_time = time_matches(entries, up)
    lost = entries.join(by_time.select("entry_ord"), "entry_ord", "left_anti")
    by_pid = pid_matches(lost, up).select("entry_ord", F.col("board_id").alias("_pb"), F.col("own_id").alias("_po"))
    rows = rows.join(by_time, "entry_ord", "left").join(by_pid, "entry_ord", "left")
    hit = F.col("board_id").isNotNull()
    reason = (
        F.when(F.col("_known").isNull(), "no_upstream_slot").when(F.col("ts_us").isNull(), "missing_timestamp")
        .when(hit & (F.col("cpu_id") != "") & F.col("own_id").isNull(), "no_cpu_cycle_contains_timestamp").when(hit, "matched_by_time")
        .when(F.col("_pb").isNotNull(), "matched_by_pid").otherwise("no_board_cycle_contains_timestamp")
    )
    rows = rows.withColumn("reason", reason).withColumn("board_id", F.coalesce("board_id", "_pb")).withColumn("own_id", F.coalesce("own_id", "_po"))
    status = F.when(F.col("board_id").isNull(), "unknown").otherwise("assigned")
    rows = rows.withColumn("status", status).drop("_known", "_pb", "_po")
    other = pid_elsewhere(rows.filter(F.col("reason").isin("matched_by_time", "no_cpu_cycle_contains_timestamp")), up)
    return rows.join(other.withColumn("pid_fallback_blocked_by_time_cycle", F.lit(True)), "entry_ord", "left").fillna(False, ["pid_fallback_blocked_by_time_cycle"])


def unknown_details(matched: DataFrame, up: Upstream) -> DataFrame:
    """(entry_ord, detail): for rows without a board, its three nearest cycles and how far they are."""
    lost = matched.filter("board_id is null and ts_us is not null").select("entry_ord", "slot", "ts_us")
    near = nearest_few(lost, up.boards.filter("start_us is not null and end_us is not null").select("slot", "board_id", "ord", "start_us", "end_us"), ["entry_ord"], ["slot"], "ts_us", "ord")
    one = F.format_string("%s:%.6fs", F.col("board_id"), F.col("distance_us") / 1_000_000)
    return near.groupBy("entry_ord").agg(F.concat(F.lit("nearest=["), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", one.alias("t")))), lambda x: x["t"]), ","), F.lit("]")).alias("detail"))


def decisions(matched: DataFrame) -> DataFrame:
    """One row an entry about its first match; what is assigned later does not change it."""
    ref = text.reference(*[F.col(c) for c in ("module_key", "ts_us", "source", "source_file", "slot", "cpu_id", "process_name", "pid", "sequence", "raw")])
    return matched.select(ref.alias("entry_ref"), "status", "board_id", "own_id", "reason", "pid_fallback_blocked_by_time_cycle", "ts_us", "source_file", "process_name", "pid")


def specificity(board_id: str = "board_id", cpu: str = "bucket_cpu", own: str = "own_id"):
    """0: unknown board, 1: known board but not which CPU cycle, 2: all known."""
    return F.when(F.col(board_id).isNull(), 0).when((F.col(cpu) != "") & F.col(own).isNull(), 1).otherwise(2)


def reassigned(matched: DataFrame, up: Upstream) -> DataFrame:
    """``matched`` with final board_id and own_id of entries whose first match left something unknown.

    Rows of one process, pid and CPU pull the row to the bucket they are in; then any cycle may.  A target
    must admit the time by its half-gap limits; of several the nearest counts, none on a tie.  In the
    first pass a target's range grows with each row it takes, so rows must be taken one after another.
    Only the unknown rows of a slot and a summary of its known buckets come to that fold.
    """
    rows = matched.withColumn("bucket_cpu", F.col("cpu_id")).withColumn("_spec", specificity())
    known = rows.filter("_spec > 0").groupBy("slot", "board_id", "own_id", "bucket_cpu", "process_name", "pid", "cpu_id").agg(F.min("ts_us").alias("lo"), F.max("ts_us").alias("hi"), F.min("entry_ord").alias("first"))
    columns = "slot string, kind string, entry_ord long, board_id string, own_id string, cpu_id string, process_name string, pid string, ts long, lo long, hi long, lower long, upper long, spec int"

    def shaped(df: DataFrame, kind: str, **values) -> DataFrame:
        names = [c.split() for c in columns.split(", ")]
        values = {"kind": F.lit(kind), "slot": F.col("slot"), **values}
        return df.select(*[values.get(n, F.lit(None)).cast(t).alias(n) for n, t in names])

    c = F.col
    parts = [
        shaped(up.boards, "board", board_id=c("board_id"), entry_ord=c("ord"), lo=c("start_us"), hi=c("end_us"), lower=c("lower_us"), upper=c("upper_us")),
        shaped(up.cpus, "cpu", board_id=c("board_id"), own_id=c("own_id"), cpu_id=c("cpu_id"), entry_ord=c("ord"), lo=c("start_us"), hi=c("end_us"), lower=c("lower_us"), upper=c("upper_us")),
        shaped(known, "known", board_id=c("board_id"), own_id=c("own_id"), cpu_id=c("bucket_cpu"), process_name=c("process_name"), pid=c("pid"), lo=c("lo"), hi=c("hi"), entry_ord=c("first")),
        shaped(rows.filter("_spec < 2"), "row", entry_ord=c("entry_ord"), board_id=c("board_id"), own_id=c("own_id"), cpu_id=c("bucket_cpu"), process_name=c("process_name"), pid=c("pid"), ts=c("ts_us"), spec=c("_spec")),
    ]
    table = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    moved = table.groupBy("slot").applyInPandas(_fold, "entry_ord long, new_board string, new_own string, moved_by string")
    out = rows.join(moved, "entry_ord", "left")
    return out.withColumn("board_id", F.coalesce("new_board", "board_id")).withColumn("own_id", F.when(F.col("moved_by").isNotNull(), F.col("new_own")).otherwise(F.col("own_id"))).drop("_spec", "bucket_cpu", "new_board", "new_own")


class _Target:
    """A bucket: its limits, its frozen base range, and the range that grows."""

    def __init__(self, board, own, cpu, lo, hi, lower, upper, order):
        self.board, self.own, self.cpu, self.base, self.lower, self.upper, self.order = board, own, cpu, (lo, hi), lower, upper, order
        self.seen: tuple = (lo, hi)

    @property
    def spec(self) -> int:
        return 0 if self.board is None else 1 if self.cpu and self.own is None else 2

    def admits(self, ts) -> bool:
        return (self.lower is None or ts >= self.lower) and (self.upper is None or ts <= self.upper)

    def take(self, lo, hi) -> None:
        known = [v for v in (*self.seen, lo, hi) if v is not None]
        self.seen = (min(known), max(known)) if known else (None, None)

    def range(self) -> tuple:
        lo, hi = self.seen
        if lo is None or hi is None:
            return None, None
        lo, hi = lo if self.lower is None else max(lo, self.lower), hi if self.upper is None else min(hi, self.upper)
        return self.base if lo > hi else (lo, hi)

    def distance(self, ts) -> float:
        lo, hi = self.range()
        return float("inf") if lo is None or hi is None else max(lo - ts, ts - hi, 0)


def _pick(ts, targets: list[_Target]) -> _Target | None:
    open_to = [t for t in targets if t.admits(ts)] if ts is not None else []
    if len(open_to) < 2:
        return open_to[0] if open_to else None
    far = [t.distance(ts) for t in open_to]
    least = min(far)
    return open_to[far.index(least)] if far.count(least) == 1 else None


class _Frozen:
    """Targets whose ranges no longer change: the few that admit a time are found over arrays."""

    def __init__(self, targets: list[_Target]):
        self.targets = targets
        self.lower = np.array([-np.inf if t.lower is None else t.lower for t in targets])
        self.upper = np.array([np.inf if t.upper is None else t.upper for t in targets])

    def pick(self, ts) -> _Target | None:
        if ts is None or not self.targets:
            return None
        return _pick(ts, [self.targets[i] for i in np.flatnonzero((self.lower <= ts) & (ts <= self.upper))])


def _fold(table: pd.DataFrame) -> pd.DataFrame:
    """New places of one slot's unknown rows."""
    table = table.astype(object).where(table.notna(), None)

    def of(kind: str) -> Iterator:
        return table[table["kind"] == kind].sort_values("entry_ord", kind="stable").itertuples(index=False)

    boards = {r.board_id: r for r in of("board")}
    cpus = {r.own_id: r for r in of("cpu")}
    buckets: dict[tuple, _Target] = {}
    holders: dict[tuple, list[_Target]] = {}

    def bucket(board, own, cpu) -> _Target:
        key = (board, own, cpu or "")
        if key not in buckets:
            base = cpus.get(own) or boards.get(board)
            buckets[key] = _Target(board, own, cpu or "", *((base.lo, base.hi, base.lower, base.upper) if base else (None,) * 4), len(buckets))
        return buckets[key]

    for r in of("known"):
        b = bucket(r.board_id, r.own_id, r.cpu_id)
        b.take(r.lo, r.hi)
        held = holders.setdefault((r.process_name, r.pid, r.cpu_id or ""), [])
        if b not in held:
            held.append(b)
    rows, moved = list(of("row")), {}
    for spec in (1, 0):
        # Who holds a process is judged before the pass.
        targets = {k: sorted((b for b in v if b.spec > spec), key=lambda b: b.order) for k, v in holders.items()}
        for r in rows:
            if r.spec == spec and r.entry_ord not in moved:
                to = _pick(r.ts, targets.get((r.process_name, r.pid, r.cpu_id or ""), []))
                if to is not None:
                    to.take(r.ts, r.ts)
                    moved[r.entry_ord] = (to.board, to.own, "process")
                    held = holders.setdefault((r.process_name, r.pid, r.cpu_id or ""), [])
                    if to not in held:
                        held.append(to)
    left = [r for r in rows if r.spec == 0 and r.entry_ord not in moved]
    # Ranges are frozen now.  A board spans all its buckets' rows.
    spans: dict[str, _Target] = {}
    for (board, own, cpu), b in buckets.items():
        if board is not None:
            base = boards[board]
            span = spans.setdefault(board, _Target(board, None, "", base.lo, base.hi, base.lower, base.upper, base.entry_ord))
            span.take(*(b.seen if b.seen[0] is not None else (None, None)))
    boards_only, by_cpu = _Frozen(list(spans.values())), {}
    for b in buckets.values():
        if b.own is not None:
            by_cpu.setdefault(b.cpu, []).append(b)
    by_cpu = {cpu: _Frozen(held) for cpu, held in by_cpu.items()}
    for r in left:
        to = (by_cpu.get(r.cpu_id, boards_only) if r.cpu_id else boards_only).pick(r.ts)
        place = to and (to.board, to.own)
        if place:
            moved[r.entry_ord] = (*place, "nearness")
    return pd.DataFrame([(k, *v) for k, v in moved.items()], columns=["entry_ord", "new_board", "new_own", "moved_by"])


def correlated_cycles(final: DataFrame, up: Upstream) -> DataFrame:
    """(slot, board_id, own_id, cpu_id, start_us, end_us, dir_name): cycles widened by their rows within their limits.

    A board is widened by the rows of all its buckets.  Rows without a board make the cycle ``unknown``.
    """
    placed = final.withColumn("own_id", F.when(F.col("board_id").isNotNull(), F.col("own_id")))
    key = ["slot", "board_id"]
    boards = placed.groupBy(*key).agg(F.min("ts_us").alias("lo"), F.max("ts_us").alias("hi")).join(up.boards, key, "left")
    boards = boards.withColumn("own_id", F.lit(None).cast("string")).withColumn("cpu_id", F.lit(""))
    inner = placed.filter("own_id is not null").groupBy(*key, "own_id", "cpu_id").agg(F.min("ts_us").alias("lo"), F.max("ts_us").alias("hi"))
    inner = inner.join(up.cpus.drop("ord"), [*key, "cpu_id", "own_id"], "left")
    open_cpu = placed.filter("cpu_id <> '' and own_id is null").groupBy(*key, "cpu_id").agg(F.lit(None).cast("string").alias("own_id"))
    open_cpu = open_cpu.select(*key, "own_id", "cpu_id", *[F.lit(None).cast("long").alias(c) for c in ("start_us", "end_us")])
    rows = boards.drop("ord").unionByName(inner.select(*boards.drop("ord").columns))
    lo, hi = F.least("start_us", "lo", "end_us"), F.greatest("end_us", "hi", "start_us")
    bounds = F.struct(F.greatest(lo, F.col("lower_us")).alias("s"), F.least(hi, F.col("upper_us")).alias("e"))
    rows = rows.withColumn("_b", F.when(F.col("start_us").isNull() & F.col("end_us").isNull(), F.struct(F.lit(None).cast("long").alias("s"), F.lit(None).cast("long").alias("e"))).otherwise(bounds))
    good = F.col("_b.s") <= F.col("_b.e")
    rows = rows.select(*key, "own_id", "cpu_id", F.when(good, F.col("_b.s")).otherwise(F.col("start_us")).alias("start_us"), F.when(good, F.col("_b.e")).otherwise(F.col("end_us")).alias("end_us"))
    rows = rows.unionByName(open_cpu)
    return rows.withColumn("dir_name", times.cycle_dir(times.from_us(F.col("start_us")), times.from_us(F.col("end_us")), "T"))


def correlated_processes(final: DataFrame) -> DataFrame:
    """(slot, board_id, own_id, cpu_id, process_name, pid, total_count) of every bucket; no pid-less merge, no missing sequences."""
    out = final.groupBy("slot", "board_id", "own_id", "cpu_id", "process_name", "pid").agg(F.count(F.lit(1)).alias("total_count"))
    return out.withColumn("missing_sequences", F.array().cast("array<int>"))
