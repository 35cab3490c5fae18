"""Log lines to entries: regex extraction as column expressions over ``lines``.

Input columns: file_ord, line_no, line, family ('diagnostic' or 'journal'), scope (the folder's slot),
cpu (of the folder, journals only) and name (of the file).  Output: the entry columns, unset stamps null.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotwise.functions import text, times
from slotwise.functions.patterns import Pattern, portable, without_sequence

ENTRY = ["module_key", "file_ord", "line_no", "stamp", "source", "source_file", "slot", "cpu_id", "process_name", "pid", "context", "sequence", "is_active_signal", "raw"]
TIMESTAMP = r"(\d{4}-\d{1,2}-\d{1,2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?)([+-]\d{2}:\d{2})?"


@dataclass(frozen=True)
class ModuleConfig:
    """What a mechanism module extracts; patterns in Python's dialect."""

    key: str
    module_name: str
    diag_pattern: str
    sequence_pattern: str = r"No\[(\d+)\]"
    active_master_keyword: str = ""
    identifying_keyword: str = ""
    line_pattern: str | None = None
    line_pattern2: str | None = None
    required_substrings: tuple[str, ...] = ()
    timestamp_regex: str = TIMESTAMP
    process_name_mapping: dict = field(default_factory=dict, hash=False)
    reliable_processes: tuple[str, ...] = ()
    multi_instance_processes: tuple[str, ...] = ()


def sequence_of(line: Column, pattern: Pattern) -> Column:
    """The first sequence number anywhere in the line, else 0."""
    return F.coalesce(F.nullif(pattern.group(line, 1), F.lit("")).try_cast("int"), F.lit(0))


def _matched(lines: DataFrame, p: Pattern) -> DataFrame:
    """The lines in which the pattern is found, with its groups in ``m``: one run of the pattern a line.

    The array is exploded, as the optimizer would copy a plain column into the filter and run the pattern there again.
    """
    return lines.withColumn("m", F.explode(F.filter(F.array(p.match(F.col("line"))), lambda m: F.size(m) > 1)))


def diagnostic_entries(lines: DataFrame, config: ModuleConfig) -> DataFrame:
    """Lines that contain the module's upper-case name and, anywhere, its pattern."""
    p, line, m = portable(config.diag_pattern), F.col("line"), F.col("m")
    rows = _matched(lines.filter((F.col("family") == "diagnostic") & line.contains(config.module_name.upper())), p)
    process = text.dashed_process(p.captured(m, "ProcessName"))
    active = p.captured(m, "Context").rlike(portable(config.active_master_keyword).java) if config.active_master_keyword else F.lit(False)
    return _entries(
        rows, config, "diagnostic", F.concat(F.lit("slot_"), "scope", F.lit("/"), "name"),
        slot=text.stripped(p.captured(m, "Slot")), cpu=text.plain_cpu(p.captured(m, "CPU_Id")), process=process["process"], pid=process["pid"],
        context=p.captured(m, "Context"), sequence=sequence_of(line, portable(config.sequence_pattern)), active=active,
    )


def journal_match(line: Column, config: ModuleConfig) -> Column:
    """struct(pattern, name, pid, sequence, context) of the first pattern that fits from the start of the line, else null.

    The configured patterns come first; only a line without any marker ``No[`` is tried without sequence.  Patterns
    are tried one after another, each run once and only where those before it failed.
    """
    tries = []
    named = [("journal.line_pattern", config.line_pattern), ("journal.line_pattern2", config.line_pattern2)]
    derived = [(f"{n}.auto_no_sequence", without_sequence(p, config.sequence_pattern)) for n, p in named if p and portable(p).groups >= 4]
    for (name, pattern), bare in [*((t, False) for t in named), *((t, True) for t in derived)]:
        if not pattern:
            continue
        p = portable(pattern).at_start()
        numbered = p.groups >= 4

        def found(m: Column) -> Column:  # called at once, below
            return F.struct(
                F.lit(name).alias("pattern"), p.captured(m, 1).alias("name"), (p.captured(m, 2) if p.groups >= 2 else F.lit("")).alias("pid"),
                (F.coalesce(p.captured(m, 3).try_cast("int"), F.lit(0)) if numbered else F.lit(0)).alias("sequence"),
                p.captured(m, 4 if numbered else min(3, p.groups)).alias("context"),
            )

        match = p.match(line)
        one = F.get(F.transform(F.filter(F.array(F.when(~line.contains("No["), match) if bare else match), lambda m: F.size(m) > 1), found), 0)
        tries.append(one)
    if not tries:
        return F.lit(None)
    chosen = F.lit(None).cast("struct<pattern:string,name:string,pid:string,sequence:int,context:string>")
    step = lambda done, k: F.coalesce(done, *[F.when(k == i, t) for i, t in enumerate(tries)])
    return F.aggregate(F.array(*[F.lit(i) for i in range(len(tries))]), chosen, step)


def journal_entries(lines: DataFrame, config: ModuleConfig) -> DataFrame:
    """Lines that contain the module's name and, case ignored, its keyword, and fit one of its patterns."""
    line = F.col("line")
    rows = lines.filter((F.col("family") == "journal") & line.contains(config.module_name.upper()) & F.lower(line).contains(config.identifying_keyword.lower()))
    rows = rows.withColumn("m", F.explode(F.filter(F.array(journal_match(line, config)), lambda m: m.isNotNull())))
    if config.required_substrings:
        some = F.exists(F.array(*[F.lit(s) for s in config.required_substrings]), lambda s: F.contains(line, s))
        rows = rows.filter(~F.col("m.pattern").startswith("journal.line_pattern2") | some)
    split = text.dashed_process(F.col("m.name"), 3)
    bare = F.col("m.pid") == ""
    return _entries(
        rows, config, "journal", F.concat(F.lit("slot_"), "scope", F.when(F.coalesce("cpu", F.lit("")) == "", "").otherwise(F.concat(F.lit("_cpu_"), "cpu")), F.lit("/"), "name"),
        slot=F.col("scope"), cpu=text.plain_cpu(F.col("cpu")), process=F.when(bare, split["process"]).otherwise(F.col("m.name")), pid=F.when(bare, split["pid"]).otherwise(F.col("m.pid")),
        context=F.col("m.context"), sequence=F.col("m.sequence"), active=F.lit(False),
    )


def keyword_entries(lines: DataFrame, config: ModuleConfig) -> DataFrame:
    """The second family: keyword contained, pattern anywhere, slot the last part of a frame path, process ``name[pid]``."""
    p, line, m = portable(config.diag_pattern), F.col("line"), F.col("m")
    rows = _matched(lines.filter((F.col("family") == "diagnostic") & line.contains(config.identifying_keyword)), p)
    process = text.bracket_process(text.stripped(p.captured(m, "ProcessName")))
    return _entries(
        rows, config, "diagnostic", F.concat(F.lit("slot_"), "scope", F.lit("/"), "name"),
        slot=text.last_part(p.captured(m, "Slot")), cpu=text.plain_cpu(p.captured(m, "CPU_Id")), process=process["process"], pid=process["pid"],
        context=p.captured(m, "Context"), sequence=F.lit(0), active=F.lit(False),
    )


def _entries(rows: DataFrame, config: ModuleConfig, source: str, source_file: Column, *, slot, cpu, process, pid, context, sequence, active) -> DataFrame:
    return rows.select(
        F.lit(config.key).alias("module_key"), "file_ord", "line_no", times.first_stamp(F.col("line"), portable(config.timestamp_regex)).alias("stamp"),
        F.lit(source).alias("source"), source_file.alias("source_file"), slot.alias("slot"), cpu.alias("cpu_id"), process.alias("process_name"), pid.alias("pid"),
        context.alias("context"), sequence.cast("int").alias("sequence"), active.alias("is_active_signal"), text.raw_text(F.col("line")).alias("raw"),
    )


def content_stamps(lines: DataFrame, timestamp_regex: str = TIMESTAMP) -> DataFrame:
    """(file_ord, line_no, pos, scope, stamp): every time in every diagnostic line, extracted or not."""
    found = F.posexplode(times.extracted(F.col("line"), portable(timestamp_regex)))
    return lines.filter(F.col("family") == "diagnostic").select("file_ord", "line_no", "scope", found.alias("pos", "stamp"))
