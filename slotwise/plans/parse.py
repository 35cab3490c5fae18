"""The parse plan: package to entries, lifecycles, correlated cycles, roles and coverage, as DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotwise.functions import times
from slotwise.operators import correlate, entries, extract, lifecycle
from slotwise.operators.aggregates import coverage, slot_table
from slotwise.plans.plugins import MechanismRunner, load
from slotwise.sources.archive import read_package
from slotwise.sources.config import KINDS, Mechanism, Product, execution_order
from slotwise.sources.discovery import discovered, log_lines
from slotwise.storage import cut, stored


@dataclass
class MechanismResult:
    """What one mechanism found; ``status`` is success, empty, failed or skipped."""

    key: str
    status: str
    reason: str = ""
    entries: DataFrame | None = None
    cycles: DataFrame | None = None
    processes: DataFrame | None = None
    lifecycles: lifecycle.Lifecycles | None = None
    decisions: DataFrame | None = None
    placed: DataFrame | None = None


@dataclass
class ParseResult:
    files: DataFrame
    lines: DataFrame
    stamps: DataFrame
    periods: DataFrame
    slots: DataFrame
    coverage: DataFrame
    mechanisms: dict[str, MechanismResult] = field(default_factory=dict)
    diagnostics: DataFrame | None = None


def content_times(lines: DataFrame, timestamp_regex: str) -> DataFrame:
    """All diagnostic times, those without an offset under the first known one."""
    found = extract.content_stamps(lines, timestamp_regex)
    return entries.flat(entries.offset_filled(found, entries.first_offset(found, ["file_ord", "line_no", "pos"])))


def run_lifecycle(lines: DataFrame, m: Mechanism) -> MechanismResult:
    """Diagnostic and journal entries of the module, its lifecycles, cycles and processes."""
    both = extract.diagnostic_entries(lines, m.module).unionByName(extract.journal_entries(lines, m.module))
    unique = entries.deduplicated(entries.zone_filled(both))
    rows = cut(entries.canonical(entries.flat(unique), m.module.process_name_mapping))
    lives = lifecycle.split(rows, m.module.reliable_processes, m.module.multi_instance_processes)
    lives.placed = cut(lives.placed)
    status = "success" if rows.limit(1).count() else "empty"
    return MechanismResult(m.key, status, "", rows, cut(lifecycle.cycles(lives)), cut(lifecycle.cycle_processes(lives)), lives, None, lives.placed)


def run_correlation(lines: DataFrame, m: Mechanism, base: MechanismResult, base_offset: int | None) -> MechanismResult:
    """Entries of the second family, each in a cycle of the first or unknown."""
    found = extract.keyword_entries(lines, m.module)
    own = entries.first_offset(found, ["file_ord", "line_no"])
    unique = entries.deduplicated(entries.offset_filled(found, own if own is not None else base_offset))
    rows = cut(entries.with_ordinals(entries.canonical(entries.flat(unique), {})))
    up = correlate.upstream(base.cycles, base.processes)
    matched = cut(correlate.matches(rows, up))
    final = cut(correlate.reassigned(matched, up))
    status = "success" if rows.limit(1).count() else "empty"
    return MechanismResult(m.key, status, "", rows, correlate.correlated_cycles(final, up), correlate.correlated_processes(final), None, correlate.decisions(matched), final)


def parse(spark: SparkSession, package: str | DataFrame, product: Product) -> ParseResult:
    """Everything of a package; a mechanism that fails, or whose base failed, does not stop the others."""
    raw = stored(read_package(spark, package) if isinstance(package, str) else package)
    files = cut(discovered(raw, product.discovery))
    lines = stored(log_lines(raw, files))
    stamps = cut(content_times(lines, product.timestamp_regex))
    periods = cut(lifecycle.active_periods(stamps, ["scope"], "ts_us", product.active_gap_seconds))
    out: dict[str, MechanismResult] = {}
    for m in execution_order(product.mechanisms):
        missing = [d for d in m.depends_on if out[d].status in ("failed", "skipped")]
        if missing:
            out[m.key] = MechanismResult(m.key, "skipped", f"dependencies without result: {missing}")
            continue
        try:
            if m.kind not in KINDS:
                runner = load(m.kind, MechanismRunner)
                runner.validate(m)
                out[m.key] = runner.run(lines, m, {d: out[d] for d in m.depends_on})
            elif m.kind == "lifecycle":
                out[m.key] = run_lifecycle(lines, m)
            else:
                base = out[m.depends_on[0]]
                out[m.key] = run_correlation(lines, m, base, entries.first_offset(base.entries.withColumn("stamp", F.struct("tz_offset_s")), ["file_ord", "line_no"]))
        except Exception as e:  # noqa: BLE001  a mechanism is an extension: its errors are its result
            out[m.key] = MechanismResult(m.key, "failed", f"{type(e).__name__}: {e}")
    active = None
    for r in out.values():
        if r.lifecycles is not None:
            one = lifecycle.active_slots(r.entries)
            active = one if active is None else active.union(one)
    slots = lifecycle.roles(slot_table(files, periods, active))
    diagnostics = raw.filter("error is not null").select(F.split("error", ":")[0].alias("code"), F.col("error").alias("message"), F.lit("warning").alias("severity"), F.lit("scan").alias("stage"), F.create_map(F.lit("path"), F.col("path")).alias("detail"))
    return ParseResult(files, lines, stamps, periods, slots, coverage(files, stamps), out, diagnostics)


def readable(cycles: DataFrame) -> DataFrame:
    """Cycles with their bounds as local times."""
    return cycles.withColumn("start", times.from_us(F.col("start_us"))).withColumn("end", times.from_us(F.col("end_us")))
