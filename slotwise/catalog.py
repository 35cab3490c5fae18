"""The registered queries of the log operators, and the DuckDB SQL that checks them.

The test tables hold no device logs, so ``events`` is projected to entries: slot and CPU from the user,
process from the event type, sequence from the properties.  Line operators run over lines that are
formatted from events, so parsing must give the events back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from slotwise.functions import text, times
from slotwise.functions.patterns import portable
from slotwise.operators import aggregates, correlate, entries, extract, intervals, lifecycle, ordering
from slotwise.plans import evidence, onboarding, target
from slotwise.sources import discovery
from slotwise.storage import cut

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The patterns of the two log families, which the formats of the devices decide.
MODULE = extract.ModuleConfig(
    "module1", "EXAMPLE", r"Service=(?P<Service>[^;]+).*?Slot=(?P<Slot>[^;,)]+).*?CPU-Id=(?P<CPU_Id>[^;,)]*).*?ProcessName=(?P<ProcessName>[^;,)]+).*?Context=(?P<Context>.+?)\)$",
    identifying_keyword="example", line_pattern=r"^\S+\s+\S+\s+\S+?:\s+\[slotId\s*=\s*\d+,\s*cpuId\s*=\s*\d+,\s*processName\s*=\s*(\S+?)-(\d+)\]:\s+No\[(\d+)\](.+)$",
    line_pattern2=r"^\S+\s+\S+\s+(\S+?)(?:-(\d+))?:\s+No\[(\d+)\](.+)$",
)
SECOND = extract.ModuleConfig("module2", "MODULE2", r'Slot=(?P<Slot>[\d/]+),CPU-Id=(?P<CPU_Id>[^,]*),ProcessName=(?P<ProcessName>[^,]+),Context="(?P<Context>.*?)"', identifying_keyword="xxx")

#: Events as entries, in SQL.  Pids last 400 events and sequences 97, so that there are restarts.
BASE = """
WITH e AS (SELECT event_id AS entry_ord, CAST(user_id % 4 AS VARCHAR) AS slot, CASE WHEN user_id % 3 = 0 THEN '' ELSE CAST(user_id % 3 AS VARCHAR) END AS cpu_id,
  event_type AS process_name, CAST(event_id // 400 AS VARCHAR) AS pid, CAST(event_id % 97 AS INTEGER) AS sequence,
  CASE WHEN event_id % 2 = 0 THEN 'diagnostic' ELSE 'journal' END AS source, epoch_us(ts) AS ts_us, ts FROM events)
"""
RELIABLE = ("click",)
GAP_S = 1800


def query(name: str, sql: str | None = None):
    """Registers a query and its SQL; SQL that starts with a comma or SELECT goes on from BASE."""

    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql if sql.lstrip().startswith("WITH") else BASE + sql
        return f

    return register


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table; as it may be one file of one row group, its rows are dealt to all cores."""
    table, cores = spark.read.parquet(f"{sf_dir}/events.parquet"), spark.sparkContext.defaultParallelism
    return table.repartition(cores) if len(table.inputFiles()) < cores else table


def event_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat entries of all events."""
    u, i = F.col("user_id"), F.col("event_id")
    raw = F.concat_ws(" ", F.col("event_type"), i.cast("string"))
    return events(spark, sf_dir).select(
        F.lit("module1").alias("module_key"), F.lit(0).alias("file_ord"), i.alias("line_no"), i.alias("entry_ord"), F.when(i % 2 == 0, "diagnostic").otherwise("journal").alias("source"),
        F.concat(F.lit("slot_"), u % 4, F.lit("/events.log")).alias("source_file"), (u % 4).cast("string").alias("slot"), F.when(u % 3 == 0, "").otherwise((u % 3).cast("string")).alias("cpu_id"),
        F.col("event_type").alias("process_name"), F.floor(i / 400).cast("string").alias("pid"), raw.alias("context"), (i % 97).cast("int").alias("sequence"), F.lit(False).alias("is_active_signal"), raw.alias("raw"),
        F.col("ts").alias("ts_local"), F.lit(None).cast("int").alias("tz_offset_s"), times.local_us(F.col("ts")).alias("ts_us"),
    )


def event_lines(spark: SparkSession, sf_dir: str, family: str = "diagnostic") -> DataFrame:
    """Log lines of all events in the formats of the modules."""
    u, i = F.col("user_id"), F.col("event_id")
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    process = F.concat("event_type", F.lit("-"), F.floor(i / 400))
    diagnostic = F.concat(stamp, F.lit(" Service=S; Slot="), u % 4, F.lit("; CPU-Id="), u % 3, F.lit("; ProcessName="), process, F.lit("; Context=No["), i % 97, F.lit("] EXAMPLE step "), i, F.lit(")"))
    numbered = F.when(i % 5 == 0, F.lit("")).otherwise(F.concat(F.lit("No["), i % 97, F.lit("]")))
    journal = F.concat(F.regexp_replace(stamp, " ", "T"), F.lit(" host "), process, F.lit(": "), numbered, F.lit(" EXAMPLE Example step "), i)
    second = F.concat(stamp, F.lit("+08:00 xxx Slot=0/"), u % 4, F.lit(",CPU-Id="), u % 3, F.lit(",ProcessName="), "event_type", F.lit("["), F.floor(i / 400), F.lit('],Context="step '), i, F.lit('"'))
    line = {"diagnostic": diagnostic, "journal": journal, "second": second}[family]
    return events(spark, sf_dir).select(F.lit(0).alias("file_ord"), i.alias("line_no"), line.alias("line"), F.lit("journal" if family == "journal" else "diagnostic").alias("family"), (u % 4).cast("string").alias("scope"), (u % 3).cast("string").alias("cpu"), F.lit("events.log").alias("name"))


def shown(found: DataFrame, *more) -> DataFrame:
    return found.select(F.col("line_no").alias("entry_ord"), F.col("stamp.ts_us").alias("ts_us"), "slot", "cpu_id", "process_name", "pid", "sequence", *more)


# -- extraction -------------------------------------------------------------------------------------


@query("c01_diag_extract", "SELECT entry_ord, ts_us, slot, cpu_id, process_name, pid, sequence, 'No[' || sequence || '] EXAMPLE step ' || entry_ord AS context FROM e")
def c01(spark, d):
    return shown(extract.diagnostic_entries(event_lines(spark, d), MODULE), "context")


@query("c05_journal_extract", "SELECT entry_ord, ts_us, slot, cpu_id, process_name, pid, CASE WHEN entry_ord % 5 = 0 THEN 0 ELSE sequence END AS sequence, ' EXAMPLE Example step ' || entry_ord AS context FROM e")
def c05(spark, d):
    found = extract.journal_entries(event_lines(spark, d, "journal"), MODULE)
    return shown(found, F.when(F.col("context").startswith(" "), F.col("context")).otherwise(F.concat(F.lit(" "), "context")).alias("context"))


@query("c06_pattern_alternation", "SELECT CASE WHEN entry_ord % 5 = 0 THEN 'journal.line_pattern2.auto_no_sequence' ELSE 'journal.line_pattern2' END AS pattern, count(*) AS n FROM e GROUP BY 1")
def c06(spark, d):
    return event_lines(spark, d, "journal").select(extract.journal_match(F.col("line"), MODULE)["pattern"].alias("pattern")).groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))


@query("c09_keyword_extract", "SELECT entry_ord, ts_us - 28800000000 AS ts_us, slot, cpu_id, process_name, pid, 0 AS sequence FROM e")
def c09(spark, d):
    return shown(extract.keyword_entries(event_lines(spark, d, "second"), SECOND))


@query("c02_sequence", "SELECT sequence, count(*) AS n FROM e GROUP BY 1")
def c02(spark, d):
    return event_lines(spark, d).select(extract.sequence_of(F.col("line"), portable(MODULE.sequence_pattern)).alias("sequence")).groupBy("sequence").agg(F.count(F.lit(1)).alias("n"))


@query("c14_canonical", "SELECT CASE WHEN process_name IN ('click', 'view') THEN 'Front' ELSE process_name END AS process_name, count(*) AS n FROM e GROUP BY 1")
def c14(spark, d):
    return entries.canonical(event_entries(spark, d), {"Front": ["CLICK", "View"]}).groupBy("process_name").agg(F.count(F.lit(1)).alias("n"))


@query("c18_zone_fill", "SELECT source, min(ts_us - CASE WHEN source = 'journal' THEN 28800000000 ELSE 28800000000 END) AS first_us, count(*) AS n FROM e GROUP BY 1")
def c18(spark, d):
    """Diagnostics at +08:00 every third row; all others take it over."""
    rows = event_entries(spark, d)
    known = (F.col("source") == "diagnostic") & (F.col("entry_ord") % 3 == 0)
    stamp = F.struct("ts_local", F.when(known, 28800).cast("int").alias("tz_offset_s"), (F.col("ts_us") - F.when(known, F.lit(28_800_000_000)).otherwise(0)).alias("ts_us"))
    filled = entries.zone_filled(rows.withColumn("stamp", stamp))
    return filled.groupBy("source").agg(F.min("stamp.ts_us").alias("first_us"), F.count(F.lit(1)).alias("n"))


@query("t01_timestamps", "SELECT entry_ord, 2 AS n, ts_us AS first_us, ts_us - 19800000000 AS last_us FROM e")
def t01(spark, d):
    """Three times a line, of which one has no such month and one an offset."""
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    line = F.concat(stamp, F.lit(" then 2024-13-01 00:00:00 and "), F.regexp_replace(stamp, " ", "T"), F.lit("+05:30 end"))
    found = events(spark, d).select(F.col("event_id").alias("entry_ord"), times.extracted(line, portable(extract.TIMESTAMP)).alias("t"))
    return found.select("entry_ord", F.size("t").alias("n"), F.col("t")[0]["ts_us"].alias("first_us"), F.col("t")[1]["ts_us"].alias("last_us"))


@query("t07_isoformat", "SELECT entry_ord, CASE WHEN ts_us % 1000000 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END AS iso, strftime(ts, '%Y%m%d%H%M%S') || '-' || strftime(ts, '%Y%m%d%H%M%S') AS dir_name FROM e")
def t07(spark, d):
    return event_entries(spark, d).select("entry_ord", times.iso(F.col("ts_local")).alias("iso"), times.cycle_dir(F.col("ts_local"), F.col("ts_local")).alias("dir_name"))


@query("l01_dedup", "SELECT entry_ord, source, process_name FROM e")
def l01(spark, d):
    """Every entry twice more, from later files: only the first stays."""
    rows = event_entries(spark, d).withColumn("stamp", F.struct("ts_local", "tz_offset_s", "ts_us"))
    again = [rows.withColumn("file_ord", F.lit(k)).withColumn("source", F.lit("journal")).withColumn("source_file", F.lit("later")) for k in (1, 2)]
    unique = entries.deduplicated(again[0].unionByName(rows).unionByName(again[1]).drop("ts_local", "tz_offset_s", "ts_us", "entry_ord"))
    return unique.select(F.col("line_no").alias("entry_ord"), "source", "process_name")


# -- lifecycles -------------------------------------------------------------------------------------

_SEGMENTS = """, g AS (SELECT *, CASE WHEN ts_us - lag(ts_us) OVER (PARTITION BY slot ORDER BY ts_us) {cmp} {gap} THEN 1 ELSE 0 END AS b FROM e),
s AS (SELECT *, CAST(sum(b) OVER (PARTITION BY slot ORDER BY ts_us ROWS UNBOUNDED PRECEDING) AS INTEGER) AS seg FROM g)
"""


@query("l02_active_periods", _SEGMENTS.format(cmp=">", gap=GAP_S * 1_000_000) + "SELECT slot, seg AS period, min(ts_us) AS start_us, max(ts_us) AS end_us FROM s GROUP BY ALL")
def l02(spark, d):
    return lifecycle.active_periods(event_entries(spark, d), ["slot"], "ts_us", GAP_S)


@query("l03_candidate_segments", _SEGMENTS.format(cmp=">=", gap=GAP_S * 1_000_000) + "SELECT slot, seg AS candidate_index, min(ts_us) AS start_us, max(ts_us) AS end_us, count(*) AS log_count FROM s GROUP BY ALL")
def l03(spark, d):
    return lifecycle.candidate_segments(event_entries(spark, d), ["slot"], GAP_S * 1_000_000)[0]


def event_lifecycles(spark: SparkSession, d: str) -> lifecycle.Lifecycles:
    return lifecycle.split(event_entries(spark, d), RELIABLE, (), GAP_S * 1_000_000)


# The fold itself: from candidate to candidate, a boundary is kept if what is left of it back to the last
# kept one, together with the next candidate, shows two pids, or a sequence number falls across it.
_FOLD = (
    _SEGMENTS.format(cmp=">=", gap=GAP_S * 1_000_000).rstrip()
    + """,
c AS (SELECT slot, seg, min(ts_us) AS start_us, max(ts_us) AS end_us, count(*) AS log_count FROM s GROUP BY ALL),
v AS (SELECT slot, seg, pid, sequence, ts_us FROM s WHERE cpu_id = '' AND process_name = 'click'),
p AS (SELECT slot, seg, min(pid) AS lo, max(pid) AS hi FROM v GROUP BY ALL),
q AS (SELECT slot, seg, arg_min(sequence, ts_us) AS first, arg_max(sequence, ts_us) AS last FROM v WHERE sequence > 0 GROUP BY ALL),
i AS (
  SELECT slot, seg AS i, before AS after FROM (SELECT *, lag(seg) OVER w AS before, lag(lo) OVER w AS blo, lag(hi) OVER w AS bhi FROM p WINDOW w AS (PARTITION BY slot ORDER BY seg)) WHERE least(lo, blo) <> greatest(hi, bhi) AND before IS NOT NULL
  UNION ALL SELECT slot, seg, seg - 1 FROM p WHERE lo <> hi UNION ALL SELECT slot, seg + 1, seg FROM p WHERE lo <> hi
  UNION ALL SELECT slot, seg, before FROM (SELECT *, lag(seg) OVER w AS before, lag(last) OVER w AS blast FROM q WINDOW w AS (PARTITION BY slot ORDER BY seg)) WHERE first < blast),
m AS (SELECT slot, i, max(after) AS after, row_number() OVER (PARTITION BY slot ORDER BY i) AS n FROM i WHERE i > 0 AND i IN (SELECT seg FROM c WHERE c.slot = i.slot) GROUP BY slot, i),
f(slot, n, cut, last) AS (
  SELECT DISTINCT slot, CAST(0 AS BIGINT), CAST(-1 AS INTEGER), CAST(0 AS INTEGER) FROM c
  UNION ALL SELECT m.slot, m.n, CAST(CASE WHEN m.after >= f.last THEN m.i ELSE -1 END AS INTEGER), CAST(CASE WHEN m.after >= f.last THEN m.i ELSE f.last END AS INTEGER) FROM f JOIN m ON m.slot = f.slot AND m.n = f.n + 1),
k AS (SELECT c.*, (SELECT count(*) FROM f WHERE f.slot = c.slot AND f.cut > 0 AND f.cut <= c.seg) AS life FROM c)
"""
)


@query("l04_lifecycles", BASE.replace("WITH e", "WITH RECURSIVE e") + _FOLD + "SELECT slot, CAST(life AS INTEGER) AS lifecycle_index, min(start_us) AS start_us, max(end_us) AS end_us, CAST(sum(log_count) AS BIGINT) AS log_count, count(*) AS candidates FROM k GROUP BY ALL")
def l04(spark, d):
    lives = lifecycle.board_lifecycles(event_entries(spark, d), RELIABLE, (), GAP_S * 1_000_000)
    return lives.select("slot", "lifecycle_index", "start_us", "end_us", "log_count", F.size("candidate_indices").cast("long").alias("candidates"))


def _scope_fold(x: str, source: str) -> str:
    """The fold over any scope ``k`` of a source with ev (rows that are evidence); tables end in ``x``.

    k: its segments with their lifecycle.  r: why a boundary stays.
    """
    return f""",
g{x} AS (SELECT *, CASE WHEN ts_us - lag(ts_us) OVER (PARTITION BY k ORDER BY ts_us) >= {GAP_S * 1_000_000} THEN 1 ELSE 0 END AS b FROM {source}),
s{x} AS (SELECT *, CAST(sum(b) OVER (PARTITION BY k ORDER BY ts_us ROWS UNBOUNDED PRECEDING) AS INTEGER) AS seg FROM g{x}),
c{x} AS (SELECT k, seg, min(ts_us) AS start_us, max(ts_us) AS end_us, count(*) AS log_count FROM s{x} GROUP BY ALL),
v{x} AS (SELECT k, seg, process_name, pid, sequence, ts_us FROM s{x} WHERE ev AND process_name = 'click'),
p{x} AS (SELECT k, seg, process_name, list_sort(list(DISTINCT pid)) AS pids FROM v{x} GROUP BY ALL),
q{x} AS (SELECT k, seg, process_name, arg_min(sequence, ts_us) AS first, arg_max(sequence, ts_us) AS last FROM v{x} WHERE sequence > 0 GROUP BY ALL),
i{x} AS (
  SELECT k, seg AS i, before AS after, 'reliable_pid_conflict' AS reason, process_name, NULL::INTEGER AS old, NULL::INTEGER AS new FROM (SELECT *, lag(seg) OVER w AS before, lag(pids) OVER w AS old FROM p{x} WINDOW w AS (PARTITION BY k, process_name ORDER BY seg)) WHERE before IS NOT NULL AND len(list_distinct(list_concat(old, pids))) > 1
  UNION ALL SELECT k, seg, seg - 1, 'reliable_pid_conflict', process_name, NULL, NULL FROM p{x} WHERE len(pids) > 1 UNION ALL SELECT k, seg + 1, seg, 'reliable_pid_conflict', process_name, NULL, NULL FROM p{x} WHERE len(pids) > 1
  UNION ALL SELECT k, seg, before, 'journal_wrap', process_name, old, first FROM (SELECT *, lag(seg) OVER w AS before, lag(last) OVER w AS old FROM q{x} WINDOW w AS (PARTITION BY k, process_name ORDER BY seg)) WHERE first < old),
m{x} AS (SELECT k, i, max(after) AS after, row_number() OVER (PARTITION BY k ORDER BY i) AS n FROM i{x} WHERE i > 0 AND (k, i) IN (SELECT (k, seg) FROM c{x}) GROUP BY k, i),
f{x}(k, n, cut, prev, last) AS (
  SELECT DISTINCT k, CAST(0 AS BIGINT), CAST(-1 AS INTEGER), CAST(0 AS INTEGER), CAST(0 AS INTEGER) FROM c{x}
  UNION ALL SELECT m.k, m.n, CAST(CASE WHEN m.after >= f.last THEN m.i ELSE -1 END AS INTEGER), f.last, CAST(CASE WHEN m.after >= f.last THEN m.i ELSE f.last END AS INTEGER) FROM f{x} f JOIN m{x} m ON m.k = f.k AND m.n = f.n + 1),
k{x} AS (SELECT c.k, c.seg, c.start_us, c.end_us, c.log_count, (SELECT count(*) FROM f{x} f WHERE f.k = c.k AND f.cut > 0 AND f.cut <= c.seg) AS life FROM c{x} c),
r{x} AS (SELECT i.* FROM i{x} i JOIN f{x} f ON f.k = i.k AND f.cut = i.i WHERE i.after >= f.prev),
d{x} AS (SELECT k, seg, (start_us - lag(end_us) OVER (PARTITION BY k ORDER BY seg)) / 1000000 AS gap_seconds, (SELECT min(reason) FROM r{x} r WHERE r.k = o.k AND r.i = o.seg) AS reason FROM c{x} o),
l{x} AS (SELECT k, life, min(start_us) AS start_us, max(end_us) AS end_us FROM k{x} GROUP BY ALL)"""


#: Boards by all rows of a slot, judged by those without a cpu; CPUs inside each board lifecycle.
_LIVES = (
    BASE.replace("WITH e", "WITH RECURSIVE e").rstrip() + ",\nsb AS (SELECT *, {'slot': slot, 'cpu': NULL::VARCHAR, 'parent': ''} AS k, cpu_id = '' AS ev FROM e)" + _scope_fold("1", "sb") + """,
pb AS (SELECT s.*, 'board:' || s.slot || ':board:root:lifecycle:' || t.life AS board FROM s1 s JOIN k1 t ON t.k = s.k AND t.seg = s.seg),
sc AS (SELECT * EXCLUDE (k, ev, b, seg), {'slot': slot, 'cpu': cpu_id, 'parent': board} AS k, TRUE AS ev FROM pb WHERE cpu_id <> '')""" + _scope_fold("2", "sc") + """,
life AS (SELECT 'board' AS scope, 'board:' || k.slot || ':board:root:lifecycle:' || life AS id, * FROM l1 UNION ALL SELECT 'cpu', 'cpu:' || k.slot || ':' || k.cpu || ':' || k.parent || ':lifecycle:' || life, * FROM l2),
pid AS (SELECT DISTINCT board AS id, process_name, pid FROM pb WHERE cpu_id = '' UNION SELECT DISTINCT 'cpu:' || s.slot || ':' || s.cpu_id || ':' || s.board || ':lifecycle:' || t.life, s.process_name, s.pid FROM s2 s JOIN k2 t ON t.k = s.k AND t.seg = s.seg)
"""
)
_KEY = "k.slot AS slot, k.cpu AS cpu_id, k.parent AS parent_lifecycle_id"


@query("l05_merge_decisions", _LIVES + "".join(f"{u}SELECT '{n}' AS scope, {_KEY}, seg - 1 AS left_index, seg AS right_index, CASE WHEN (k, seg) IN (SELECT (k, cut) FROM f{x}) THEN 'kept_split' ELSE 'merged' END AS decision, reason, gap_seconds FROM d{x} WHERE seg > 0" for u, n, x in (("", "board", "1"), (" UNION ALL ", "cpu", "2"))))
def l05(spark, d):
    return event_lifecycles(spark, d).decisions


@query("l08_wrap_evidence", _LIVES + "".join(f"{u}SELECT '{n}' AS scope, {_KEY}, CAST(i AS INTEGER) AS right_index, process_name, old AS old_sequence, new AS new_sequence FROM r{x} WHERE reason = 'journal_wrap'" for u, n, x in (("", "board", "1"), (" UNION ALL ", "cpu", "2"))))
def l08(spark, d):
    return event_lifecycles(spark, d).evidence


@query("l09_issues", _LIVES + f""", many AS (SELECT id, process_name, list_sort(list(pid)) AS pids FROM pid WHERE process_name = 'click' GROUP BY ALL HAVING count(*) > 1),
again AS (SELECT process_name, pid, life.*, lag(life) OVER w AS before, lag(life.id) OVER w AS other FROM pid JOIN life ON life.id = pid.id WINDOW w AS (PARTITION BY scope, k, process_name, pid ORDER BY life))
SELECT 'reliable_process_multiple_pid_in_lifecycle' AS type, 'error' AS severity, scope, {_KEY}, process_name AS related_process, array_to_string(pids, ',') AS observed_pids, life.id AS affected FROM many JOIN life ON life.id = many.id
UNION ALL SELECT 'pid_reuse_assumption_violation', 'warning', scope, {_KEY}, process_name, pid, other || ',' || id FROM again WHERE before = life - 1""")
def l09(spark, d):
    return event_lifecycles(spark, d).issues.withColumns({c: F.concat_ws(",", c) for c in ("observed_pids", "affected")})


@query("l11_cycles", _LIVES + """SELECT id, scope, k.slot AS slot, k.cpu AS cpu_id, k.parent AS parent_id, CAST(row_number() OVER (PARTITION BY k.slot ORDER BY scope, k.cpu NULLS FIRST, start_us) - 1 AS INTEGER) AS cycle_ord, start_us, end_us,
strftime(make_timestamp(start_us), '%Y%m%d%H%M%S') || '-' || strftime(make_timestamp(end_us), '%Y%m%d%H%M%S') AS dir_name FROM life""")
def l11(spark, d):
    return lifecycle.cycles(event_lifecycles(spark, d))


@query("l12_processes", _SEGMENTS.format(cmp=">=", gap=GAP_S * 1_000_000) + """SELECT slot, seg AS candidate_index, process_name, pid, cpu_id, count(*) AS total_count,
  greatest(max(sequence) FILTER (sequence > 0) - min(sequence) FILTER (sequence > 0) + 1 - count(DISTINCT sequence) FILTER (sequence > 0), 0) AS n_missing FROM s GROUP BY ALL""")
def l12(spark, d):
    placed = lifecycle.candidate_segments(event_entries(spark, d), ["slot"], GAP_S * 1_000_000)[1]
    out = lifecycle.processes(placed, ["slot", "candidate_index"])
    some = F.when(F.size("missing_sequences") >= 0, F.size("missing_sequences")).cast("long")
    return out.join(placed.groupBy("slot", "candidate_index", "process_name", "pid", "cpu_id").agg(F.count_if(F.col("sequence") > 0).alias("_n")), ["slot", "candidate_index", "process_name", "pid", "cpu_id"]).select("slot", "candidate_index", "process_name", "pid", "cpu_id", "total_count", some.alias("n_missing"))


@query("j10_pidless", """, r AS (SELECT *, CASE WHEN entry_ord % 3 = 0 THEN '' ELSE pid END AS p, entry_ord // 1000 AS cycle FROM e),
o AS (SELECT cycle, process_name, cpu_id, min(p) AS lo, max(p) AS hi FROM r WHERE p <> '' GROUP BY ALL)
SELECT cycle, process_name, CASE WHEN p = '' AND source = 'journal' AND lo = hi THEN lo ELSE p END AS pid, count(*) AS n FROM r LEFT JOIN o USING (cycle, process_name, cpu_id) GROUP BY ALL""")
def j10(spark, d):
    rows = event_entries(spark, d).withColumn("pid", F.when(F.col("entry_ord") % 3 == 0, "").otherwise(F.col("pid"))).withColumn("cycle", F.floor(F.col("entry_ord") / 1000))
    return lifecycle.merged_pidless(rows, ["cycle"]).groupBy("cycle", "process_name", "pid").agg(F.count(F.lit(1)).alias("n"))


@query("l20_roles", "SELECT slot, n_periods, CASE WHEN slot = '1' THEN 'active' WHEN has_logs THEN 'standby' ELSE 'unknown' END AS role FROM (SELECT slot, count(DISTINCT pid) AS n_periods, slot <> '3' AS has_logs FROM e GROUP BY slot)")
def l20(spark, d):
    slots = event_entries(spark, d).groupBy("slot").agg(F.countDistinct("pid").alias("n_periods")).withColumn("has_logs", F.col("slot") != "3").withColumn("is_active", F.col("slot") == "1")
    return lifecycle.roles(slots).select("slot", "n_periods", "role")


# -- correlation ------------------------------------------------------------------------------------

# Cycles: every other segment of diagnostics; points: all journals.
_CYCLES = """, d AS (SELECT * FROM e WHERE source = 'diagnostic'),
g AS (SELECT *, CASE WHEN ts_us - lag(ts_us) OVER (PARTITION BY slot ORDER BY ts_us) >= 1800000000 THEN 1 ELSE 0 END AS b FROM d),
s AS (SELECT *, CAST(sum(b) OVER (PARTITION BY slot ORDER BY ts_us ROWS UNBOUNDED PRECEDING) AS INTEGER) AS seg FROM g),
cy AS (SELECT slot, seg AS ord, min(ts_us) AS start_us, max(ts_us) AS end_us FROM s WHERE seg % 2 = 0 GROUP BY ALL),
pt AS (SELECT * FROM e WHERE source = 'journal')
"""


def event_cycles(spark: SparkSession, d: str) -> DataFrame:
    seen = lifecycle.candidate_segments(event_entries(spark, d).filter("source = 'diagnostic'"), ["slot"], 1_800_000_000)[0]
    return seen.filter("candidate_index % 2 = 0").select("slot", F.col("candidate_index").alias("ord"), "start_us", "end_us")


def event_points(spark: SparkSession, d: str) -> DataFrame:
    return event_entries(spark, d).filter("source = 'journal'").select("entry_ord", "slot", "ts_us")


@query("j02_interval_join", _CYCLES + "SELECT entry_ord, pt.slot, ord FROM pt JOIN cy ON pt.slot = cy.slot AND ts_us BETWEEN start_us AND end_us")
def j02(spark, d):
    return intervals.interval_join(event_points(spark, d), event_cycles(spark, d), ["slot"], "ts_us", "start_us", "end_us").select("entry_ord", "slot", "ord")


@query("j04_nearest", _CYCLES + """, o AS (SELECT pt.* FROM pt WHERE NOT EXISTS (FROM cy WHERE cy.slot = pt.slot AND pt.ts_us BETWEEN start_us AND end_us)),
r AS (SELECT entry_ord, o.slot, ord, greatest(start_us - ts_us, ts_us - end_us) AS distance_us FROM o JOIN cy ON o.slot = cy.slot)
SELECT * FROM r QUALIFY rank() OVER (PARTITION BY entry_ord ORDER BY distance_us) = 1""")
def j04(spark, d):
    return intervals.nearest(event_points(spark, d), event_cycles(spark, d), ["entry_ord"], ["slot"], "ts_us", "start_us", "end_us").select("entry_ord", "slot", "ord", "distance_us")


@query("l15_half_gap_limits", _CYCLES + """, n AS (SELECT *, lag(end_us) OVER w AS pe, lead(start_us) OVER w AS ns FROM cy WINDOW w AS (PARTITION BY slot ORDER BY ord))
SELECT slot, ord, pe + (start_us - pe) // 2 + CASE WHEN (start_us - pe) % 2 = 0 THEN 0 ELSE ((start_us - pe) // 2) % 2 END + 1 AS lower_us,
  end_us + (ns - end_us) // 2 + CASE WHEN (ns - end_us) % 2 = 0 THEN 0 ELSE ((ns - end_us) // 2) % 2 END AS upper_us FROM n""")
def l15(spark, d):
    return intervals.half_gap_limits(event_cycles(spark, d), ["slot"], ["ord"]).select("slot", "ord", "lower_us", "upper_us")


def event_upstream(spark: SparkSession, d: str) -> correlate.Upstream:
    """Boards from the segments; in each, a CPU's cycle goes from its first to its last diagnostic entry."""
    boards = event_cycles(spark, d).select(F.concat("slot", F.lit(":"), "ord").alias("id"), F.lit("board").alias("scope"), "slot", F.lit(None).cast("string").alias("cpu_id"), F.lit("").alias("parent_id"), F.col("ord").alias("cycle_ord"), "start_us", "end_us")
    inside = intervals.interval_join(event_entries(spark, d).filter("source = 'diagnostic'").select("entry_ord", "slot", "cpu_id", "ts_us", "process_name", "pid"), boards.select("slot", "id", "cycle_ord", "start_us", "end_us"), ["slot"], "ts_us", "start_us", "end_us")
    own = F.concat("id", F.lit("/"), "cpu_id")
    inner = inside.filter("cpu_id <> ''")
    cpus = inner.groupBy("slot", "id", "cpu_id", "cycle_ord").agg(F.min("ts_us").alias("start_us"), F.max("ts_us").alias("end_us"))
    cpus = cpus.select(own.alias("id"), F.lit("cpu").alias("scope"), "slot", "cpu_id", F.col("id").alias("parent_id"), "cycle_ord", "start_us", "end_us")
    pids = inside.select(F.col("id").alias("cycle_id"), "process_name", "pid").unionByName(inner.select(own.alias("cycle_id"), "process_name", "pid"))
    return correlate.upstream(cut(boards.unionByName(cpus)), cut(pids.distinct()))


@query("j05_pid_fallback", _CYCLES + """, o AS (SELECT pt.* FROM pt WHERE cpu_id = '' AND NOT EXISTS (FROM cy WHERE cy.slot = pt.slot AND pt.ts_us BETWEEN start_us AND end_us)),
r AS (SELECT entry_ord, o.slot, o.process_name, o.pid, ord FROM o JOIN cy ON o.slot = cy.slot QUALIFY rank() OVER (PARTITION BY entry_ord ORDER BY greatest(start_us - ts_us, ts_us - end_us)) = 1),
h AS (SELECT r.entry_ord, r.slot, ord, max(CASE WHEN s.process_name = r.process_name THEN 1 ELSE 0 END) AS same FROM r JOIN s ON s.slot = r.slot AND s.seg = r.ord AND s.pid = r.pid GROUP BY ALL),
b AS (SELECT * FROM h QUALIFY same = max(same) OVER (PARTITION BY entry_ord))
SELECT entry_ord, slot || ':' || ord AS board_id FROM b QUALIFY count(*) OVER (PARTITION BY entry_ord) = 1""")
def j05(spark, d):
    rows = event_entries(spark, d).filter("source = 'journal' and cpu_id = ''")
    return correlate.pid_matches(rows, event_upstream(spark, d)).select("entry_ord", "board_id")


#: The first match of every journal entry: by time, by pid among the nearest cycles, or none.
MATCHES = _CYCLES.rstrip() + """,
db AS (SELECT s.slot, cy.ord, s.cpu_id, s.process_name, s.pid, s.ts_us FROM s JOIN cy ON s.slot = cy.slot AND s.seg = cy.ord),
cpu AS (SELECT slot, ord, cpu_id, min(ts_us) AS start_us, max(ts_us) AS end_us FROM db WHERE cpu_id <> '' GROUP BY ALL),
wp AS (SELECT DISTINCT slot, ord, '' AS cpu_id, process_name, pid FROM db UNION ALL SELECT DISTINCT slot, ord, cpu_id, process_name, pid FROM db WHERE cpu_id <> ''),
bt AS (SELECT entry_ord, min(ord) AS ord FROM pt JOIN cy ON pt.slot = cy.slot AND ts_us BETWEEN start_us AND end_us GROUP BY 1),
ct AS (SELECT bt.entry_ord, bt.ord, cpu.cpu_id AS own FROM bt JOIN pt USING (entry_ord) LEFT JOIN cpu ON cpu.slot = pt.slot AND cpu.ord = bt.ord AND cpu.cpu_id = pt.cpu_id AND pt.ts_us BETWEEN cpu.start_us AND cpu.end_us),
lost AS (SELECT pt.* FROM pt WHERE pid <> '' AND entry_ord NOT IN (SELECT entry_ord FROM bt)),
near AS (SELECT lost.*, cy.ord, cy.start_us, cy.end_us FROM lost JOIN cy ON lost.slot = cy.slot QUALIFY rank() OVER (PARTITION BY entry_ord ORDER BY greatest(start_us - ts_us, ts_us - end_us)) = 1),
cand AS (SELECT entry_ord, slot, cpu_id, process_name, pid, ts_us, ord, start_us, end_us FROM near WHERE cpu_id = ''
  UNION ALL SELECT near.entry_ord, near.slot, near.cpu_id, near.process_name, near.pid, near.ts_us, near.ord, cpu.start_us, cpu.end_us FROM near JOIN cpu ON cpu.slot = near.slot AND cpu.ord = near.ord AND cpu.cpu_id = near.cpu_id),
hit AS (SELECT entry_ord, cand.ord, cand.cpu_id, ts_us, start_us, end_us, max(CASE WHEN wp.process_name = cand.process_name THEN 1 ELSE 0 END) AS same FROM cand JOIN wp ON wp.slot = cand.slot AND wp.ord = cand.ord AND wp.cpu_id = cand.cpu_id AND wp.pid = cand.pid GROUP BY ALL),
h1 AS (SELECT * FROM hit QUALIFY same = max(same) OVER (PARTITION BY entry_ord)),
h2 AS (SELECT *, greatest(start_us - ts_us, ts_us - end_us, 0) AS far FROM h1 QUALIFY far = min(far) OVER (PARTITION BY entry_ord)),
bm AS (SELECT entry_ord, min(ord) AS ord, min(cpu_id) AS own FROM h2 GROUP BY 1 HAVING count(*) = 1),
mt AS (SELECT pt.*, coalesce(ct.ord, bm.ord) AS ord, CASE WHEN ct.ord IS NOT NULL THEN ct.own ELSE nullif(bm.own, '') END AS own,
  CASE WHEN pt.slot NOT IN (SELECT slot FROM cy) THEN 'no_upstream_slot' WHEN ct.ord IS NOT NULL AND pt.cpu_id <> '' AND ct.own IS NULL THEN 'no_cpu_cycle_contains_timestamp' WHEN ct.ord IS NOT NULL THEN 'matched_by_time'
  WHEN bm.ord IS NOT NULL THEN 'matched_by_pid' ELSE 'no_board_cycle_contains_timestamp' END AS reason FROM pt LEFT JOIN ct USING (entry_ord) LEFT JOIN bm USING (entry_ord)),
el AS (SELECT DISTINCT mt.entry_ord FROM mt JOIN wp ON wp.slot = mt.slot AND wp.cpu_id = mt.cpu_id AND wp.pid = mt.pid WHERE mt.pid <> '' AND reason IN ('matched_by_time', 'no_cpu_cycle_contains_timestamp') AND NOT (wp.ord = mt.ord AND (mt.cpu_id = '' OR mt.own IS NOT NULL))),
fin AS (SELECT mt.entry_ord, slot, cpu_id, process_name, pid, ts_us, reason, CASE WHEN ord IS NULL THEN 'unknown' ELSE 'assigned' END AS status, slot || ':' || ord AS board_id, slot || ':' || ord || '/' || own AS own_id, entry_ord IN (SELECT entry_ord FROM el) AS blocked FROM mt)
"""


@query("j07_matches", MATCHES + "SELECT entry_ord, status, reason, board_id, own_id, blocked FROM fin")
def j07(spark, d):
    """The first match of every journal, on boards and CPUs."""
    out = correlate.matches(event_entries(spark, d).filter("source = 'journal'"), event_upstream(spark, d))
    return out.select("entry_ord", "status", "reason", "board_id", "own_id", F.col("pid_fallback_blocked_by_time_cycle").alias("blocked"))


@query("j11_reassigned")
def j11(spark, d):
    up = event_upstream(spark, d)
    matched = cut(correlate.matches(event_entries(spark, d).filter("source = 'journal'"), up))
    return correlate.reassigned(matched, up).groupBy("slot", "board_id", "moved_by").agg(F.count(F.lit(1)).alias("n"))


@query("j16_target_selection", _CYCLES + """, a AS (SELECT entry_ord, slot, ts_us FROM pt),
x AS (SELECT a.entry_ord, ord, CASE WHEN ts_us BETWEEN start_us AND end_us THEN 0 ELSE least(abs(ts_us - start_us), abs(ts_us - end_us)) END AS far FROM a JOIN cy ON a.slot = cy.slot),
y AS (SELECT entry_ord, count(*) FILTER (far = 0) AS n_in, min(far) AS least FROM x GROUP BY 1),
z AS (SELECT x.entry_ord, n_in, count(*) FILTER (far = least) AS n_near, min(ord) FILTER (far = least) AS ord FROM x JOIN y USING (entry_ord) GROUP BY ALL)
SELECT entry_ord, CASE WHEN n_in = 1 THEN 'exact' WHEN n_in > 1 OR n_near > 1 THEN 'ambiguous' ELSE 'nearest' END AS match_status, CASE WHEN n_in > 1 OR n_near > 1 THEN NULL ELSE ord END AS ord FROM z""")
def j16(spark, d):
    """Only cycles that contain a point or are nearest to it can be chosen, so no others are paired with it."""
    points, cycles = event_points(spark, d), cut(event_cycles(spark, d))
    inside = intervals.interval_join(points, cycles, ["slot"], "ts_us", "start_us", "end_us")
    near = intervals.nearest(points, cycles, ["entry_ord"], ["slot"], "ts_us", "start_us", "end_us")
    both = inside.select("entry_ord", "ts_us", "ord", "start_us", "end_us").unionByName(near.select("entry_ord", "ts_us", "ord", "start_us", "end_us"))
    pairs = both.select("entry_ord", F.col("ts_us").alias("at_us"), F.col("ord").alias("cycle_id"), "start_us", "end_us", F.lit("").alias("log_path"))
    return target.selected(pairs, ["entry_ord"]).select("entry_ord", "match_status", F.col("choice.cycle_id").alias("ord"))


@query("j18_index_against_files", "SELECT path, problem FROM (SELECT 'p' || pid AS path, 'missing' AS problem FROM e GROUP BY pid HAVING CAST(pid AS INT) % 5 = 0 UNION ALL SELECT 'q' || pid, 'orphan' FROM e GROUP BY pid HAVING CAST(pid AS INT) % 7 = 0)")
def j18(spark, d):
    pids = event_entries(spark, d).select("pid", F.col("pid").cast("int").alias("n")).distinct()
    named = pids.select(F.concat(F.lit("p"), "pid").alias("path"))
    there = pids.filter("n % 5 <> 0").select(F.concat(F.lit("p"), "pid").alias("path")).unionByName(pids.filter("n % 7 = 0").select(F.concat(F.lit("q"), "pid").alias("path")))
    return evidence.index_against_files(named, there)


@query("j22_pid_reuse", ", t AS (SELECT DISTINCT slot, entry_ord // 400 AS life, process_name FROM e) SELECT a.slot, a.life, count(*) AS n FROM t a JOIN t b ON a.slot = b.slot AND a.process_name = b.process_name AND b.life = a.life - 1 GROUP BY ALL")
def j22(spark, d):
    pairs = event_entries(spark, d).select("slot", F.floor(F.col("entry_ord") / 400).alias("life"), "process_name").distinct()
    by = W.partitionBy("slot", "process_name").orderBy("life")
    return pairs.withColumn("_b", F.lag("life").over(by)).filter("_b = life - 1").groupBy("slot", "life").agg(F.count(F.lit(1)).alias("n"))


# -- aggregations, windows, order -------------------------------------------------------------------


@query("g01_coverage", "SELECT count(DISTINCT slot) AS diagnostic_scopes, count(*) AS timestamps, strftime(min(ts), '%Y-%m-%dT%H:%M:%S') AS first_time, strftime(max(ts), '%Y-%m-%dT%H:%M:%S') AS last_time FROM e")
def g01(spark, d):
    rows = event_entries(spark, d)
    files = rows.select(F.lit("diagnostic").alias("family"), F.col("slot").alias("scope"), F.lit(None).cast("string").alias("cpu"), F.lit("events.log").alias("name")).distinct()
    whole = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    return aggregates.coverage(files, rows).select("diagnostic_scopes", "timestamps", whole("first_time").alias("first_time"), whole("last_time").alias("last_time"))


@query("g04_counts_by_source", "SELECT 'module1' AS module_key, count(*) FILTER (source = 'diagnostic') AS diagnostic, count(*) FILTER (source = 'journal') AS journal FROM e")
def g04(spark, d):
    return aggregates.counts_by_source(event_entries(spark, d))


@query("g07_stage_tree", """, t AS (SELECT 'parse.' || process_name || '.slot' || slot AS name, CAST(count(*) AS DOUBLE) AS seconds, CAST(sum(sequence) AS BIGINT) AS items FROM e GROUP BY 1)
SELECT 'parse' AS path, sum(seconds) AS seconds, 0 AS calls, CAST(NULL AS BIGINT) AS items FROM t
UNION ALL SELECT split_part(name, '.', 1) || '.' || split_part(name, '.', 2), sum(seconds), 0, NULL FROM t GROUP BY 1 UNION ALL SELECT name, seconds, 1, items FROM t""")
def g07(spark, d):
    stages = event_entries(spark, d).groupBy(F.concat(F.lit("parse."), "process_name", F.lit(".slot"), "slot").alias("name")).agg(F.count(F.lit(1)).cast("double").alias("seconds"), F.sum("sequence").alias("items"))
    return aggregates.stage_tree(stages)


@query("g11_members", "SELECT slot, array_to_string(list_sort(list(DISTINCT process_name)), ',') AS process_names, array_to_string(list_sort(list(DISTINCT pid)), ',') AS pids FROM e GROUP BY slot")
def g11(spark, d):
    return aggregates.distinct_members(event_entries(spark, d).withColumn("_slot", F.col("slot")), ["_slot"]).select(F.col("_slot").alias("slot"), F.array_join("process_names", ",").alias("process_names"), F.array_join("pids", ",").alias("pids"))


@query("g09_issue_counts", "SELECT count(*) FILTER (process_name IN ('click', 'error')) AS errors, count(*) FILTER (process_name NOT IN ('click', 'error', 'view')) AS warnings, count(*) FILTER (process_name = 'view') AS infos FROM e")
def g09(spark, d):
    severity = F.when(F.col("process_name") == "click", "ERROR").when(F.col("process_name") == "view", "info").otherwise(F.col("process_name"))
    return aggregates.issue_counts(event_entries(spark, d).select(severity.alias("severity")))


@query("w08_line_window", """, t AS (SELECT slot, row_number() OVER (PARTITION BY slot ORDER BY entry_ord) AS n, entry_ord, ts_us FROM e),
a AS (SELECT slot, arg_min(n, (abs(ts_us - 1704931200000000), n)) AS spot FROM t GROUP BY slot)
SELECT slot, entry_ord AS line_no, n = spot AS is_target FROM t JOIN a USING (slot) WHERE n >= greatest(spot - 24, 1) AND n < greatest(spot - 24, 1) + 48""")
def w08(spark, d):
    by = W.partitionBy("slot").orderBy("entry_ord")
    rows = event_entries(spark, d).select("slot", "entry_ord", "ts_us", F.row_number().over(by).alias("line_no"))
    return aggregates.line_window(rows, 1_704_931_200_000_000, by=["slot"]).select("slot", F.col("entry_ord").alias("line_no"), "is_target")


@query("w09_byte_budget", ", t AS (SELECT slot, entry_ord, process_name, sum(strlen(process_name) + 1) OVER (PARTITION BY slot ORDER BY entry_ord ROWS UNBOUNDED PRECEDING) AS used FROM e) SELECT slot, entry_ord AS line_no, CASE WHEN strlen(process_name) <= 1000 - (used - strlen(process_name) - 1) THEN process_name ELSE left(process_name, CAST(1000 - (used - strlen(process_name) - 1) AS INT)) END AS line FROM t WHERE used - strlen(process_name) - 1 < 1000")
def w09(spark, d):
    rows = event_entries(spark, d).select("slot", F.col("entry_ord").alias("line_no"), F.col("process_name").alias("line"))
    return aggregates.within_bytes(rows, ["slot"], 1000)


@query("w10_line_ranges", ", t AS (SELECT slot, entry_ord, entry_ord - row_number() OVER (PARTITION BY slot ORDER BY entry_ord) AS g FROM e) SELECT slot, min(entry_ord) AS first_line, max(entry_ord) AS last_line FROM t GROUP BY slot, g")
def w10(spark, d):
    return aggregates.line_ranges(event_entries(spark, d).select("slot", F.col("entry_ord").alias("line_no")), ["slot"])


@query("w07_ordinals", "SELECT entry_ord, CAST(row_number() OVER (ORDER BY ts_us, entry_ord) - 1 AS BIGINT) AS ordinal FROM e")
def w07(spark, d):
    return ordering.row_numbers(event_entries(spark, d).select("entry_ord", "ts_us"), ["ts_us", "entry_ord"], "ordinal").drop("ts_us")


@query("o09_best_by_count", ", t AS (SELECT slot, process_name, count(*) AS n, min(entry_ord) AS first FROM e GROUP BY ALL) SELECT slot, arg_max(process_name, (n, -first)) AS process_name FROM t GROUP BY slot")
def o09(spark, d):
    counts = event_entries(spark, d).groupBy("slot", "process_name").agg(F.count(F.lit(1)).alias("n"), F.min("entry_ord").alias("first"))
    return aggregates.best_by_count(counts, ["slot"], "process_name", "n", "first")


# -- text, files, onboarding ------------------------------------------------------------------------


@query("s21_whole_segment", """WITH t AS (SELECT item_id, text, list_transform(string_split(text, ''), lambda c: CASE WHEN regexp_full_match(c, '[A-Za-z0-9_.-]') THEN c ELSE '~U' || printf('%08x', unicode(c)) END) AS parts FROM benchmark)
SELECT item_id, CASE WHEN coalesce(text, '') = '' THEN 'unknown'
  WHEN regexp_full_match(text, '[A-Za-z0-9_.-]+') AND text NOT IN ('.', '..') AND NOT ends_with(text, '.') AND NOT regexp_full_match(upper(split_part(text, '.', 1)), 'CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9]') THEN text
  ELSE array_to_string(parts, '') || '~H' || left(sha256(text), 16) END AS segment FROM t""")
def s21_whole(spark, d):
    """Whole texts."""
    return spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", text.safe_segment(F.col("text")).alias("segment"))


@query("s23_slot_names", "SELECT slot, cpu_id, count(*) AS n FROM e GROUP BY ALL")
def s23(spark, d):
    folder = F.concat(F.lit("SLOT_"), "slot", F.when(F.col("cpu_id") == "", "").otherwise(F.concat(F.lit("_cpu_"), "cpu_id")))
    who = text.private_slot(folder)
    return event_entries(spark, d).select(who["slot"].alias("slot"), F.coalesce(who["cpu"], F.lit("")).alias("cpu_id")).groupBy("slot", "cpu_id").agg(F.count(F.lit(1)).alias("n"))


@query("s32_name_shapes", "SELECT 'log_*_' || process_name || '.txt' AS shape, count(*) AS n FROM (SELECT DISTINCT process_name, pid FROM e) GROUP BY 1")
def s32(spark, d):
    number = F.when(F.length("pid") < 4, F.lpad("pid", 4, "0")).otherwise(F.col("pid"))  # lpad alone cuts longer ones
    names = event_entries(spark, d).select(F.concat(F.lit("log_"), number, F.lit("_"), "process_name", F.lit(".txt")).alias("name")).distinct()
    return names.groupBy(text.name_shape(F.col("name")).alias("shape")).agg(F.count(F.lit(1)).alias("n"))


@query("s29_references", "SELECT entry_ord, sha256('module1' || chr(31) || slot || chr(31) || entry_ord) AS ref FROM e")
def s29(spark, d):
    return event_entries(spark, d).select("entry_ord", text.reference(F.lit("module1"), F.col("slot"), F.col("entry_ord")).alias("ref"))


@query("a11_discovery", """, p AS (SELECT DISTINCT slot, pid FROM e)
SELECT 'diagnostic' AS family, slot AS scope, 'diaglog_' || slot || '_' || (20240101000000 + CAST(pid AS BIGINT)) || '.log.zip' AS name, 'diag/slot_' || slot || '/diaglog_' || slot || '_' || (20240101000000 + CAST(pid AS BIGINT)) || '.log.zip_extracted/a.log' AS path, 0 AS rot_sequence FROM p
UNION ALL SELECT 'journal', slot, 'journal.log.' || pid || '.gz', 'varlog/slot_' || slot || '/varlog.zip_extracted/journal.log.' || pid || '.gz', CAST(pid AS INT) FROM p""")
def a11(spark, d):
    p = event_entries(spark, d).select("slot", "pid").distinct()
    name = F.concat(F.lit("diaglog_"), "slot", F.lit("_"), F.lit(20_240_101_000_000) + F.col("pid").cast("long"), F.lit(".log.zip"))
    paths = p.select(F.concat(F.lit("diag/slot_"), "slot", F.lit("/"), name, F.lit("_extracted/a.log")).alias("path"))
    paths = paths.unionByName(p.select(F.concat(F.lit("varlog/slot_"), "slot", F.lit("/varlog.zip_extracted/journal.log."), "pid", F.lit(".gz")).alias("path")))
    paths = paths.unionByName(p.select(F.concat(F.lit("diag/other/readme"), "pid", F.lit(".txt")).alias("path")))
    found = discovery.diagnostics(paths, discovery.DEFAULT).unionByName(discovery.journals(paths, discovery.DEFAULT))
    return found.select("family", "scope", "name", "path", "rot_sequence")


@query("a13_fingerprints", ", t AS (SELECT slot AS path, entry_ord, md5(process_name || entry_ord) AS h FROM e) SELECT path, md5(string_agg(h, chr(10) ORDER BY entry_ord)) AS content_fp FROM t GROUP BY path")
def a13(spark, d):
    lines = event_entries(spark, d).select(F.col("slot").alias("path"), F.col("entry_ord").alias("line_no"), F.concat("process_name", "entry_ord").alias("line"), F.lit(None).cast("string").alias("error"))
    return discovery.content_fingerprints(lines)


@query("g16_directory_integrity", ", t AS (SELECT process_name AS path, CAST(count(*) AS BIGINT) AS file_count, CAST(sum(strlen(pid)) AS BIGINT) AS size FROM (SELECT DISTINCT process_name, pid FROM e) GROUP BY 1) SELECT path, 'directory' AS kind, size, file_count FROM t")
def g16(spark, d):
    files = event_entries(spark, d).select("process_name", "pid").distinct()
    files = files.select(F.concat("process_name", F.lit("/"), "pid").alias("path"), F.length("pid").cast("long").alias("size"), F.sha2(F.col("pid").cast("binary"), 256).alias("sha256"))
    return evidence.artifacts(files).select("path", "kind", "size", "file_count")


@query("b02_evidence_paths", "SELECT DISTINCT 'mech_modules/EXAMPLE/slot_' || slot || '/c' || pid || CASE WHEN cpu_id = '' THEN '' ELSE '/cpu_' || cpu_id || '/d' END || '/' || process_name || '-' || pid || '.log' AS path FROM e")
def b02(spark, d):
    path = evidence.evidence_path(F.lit("EXAMPLE"), F.col("slot"), F.concat(F.lit("c"), "pid"), F.col("cpu_id"), F.lit("d"), F.col("process_name"), F.col("pid"))
    return event_entries(spark, d).select(path.alias("path")).distinct()


@query("g13_candidate_counters", "SELECT count(*) AS eligible, count(*) AS record_matches, count(*) AS timestamp_parseable, 0 AS timestamp_runtime_errors, count(*) AS ordinal_integers FROM e")
def g13(spark, d):
    candidate = {"file_patterns": ["events.*"], "timestamp_regex": extract.TIMESTAMP, "module_name": "example", "diag_pattern": MODULE.diag_pattern, "sequence_pattern": MODULE.sequence_pattern}
    return onboarding.evaluate(event_lines(spark, d), candidate).select("eligible", "record_matches", "timestamp_parseable", "timestamp_runtime_errors", "ordinal_integers")


@query("g14_onboarding_coverage", "SELECT 'iso8601' AS key, count(*) AS eligible, count(*) AS matched, count(*) AS parseable, CAST(1.0 AS DOUBLE) AS coverage FROM e")
def g14(spark, d):
    return onboarding.analyze(event_lines(spark, d))["timestamps"].select("key", "eligible", "matched", "parseable", F.col("coverage").cast("double").alias("coverage"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lifecycles of all slots from gaps and process evidence."""
    return l04(spark, sf_dir)
