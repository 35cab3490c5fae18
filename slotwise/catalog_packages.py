"""Registered queries from end to end: a package of logs made of ``events``, read, parsed, written and asked.

The package is written by the engine's own sink into the shared folder, one file a slot and family, and packed
there.  Without reliable processes a slot has one board lifecycle, and one for each of its CPUs, so SQL can tell
every result from the events.  What is built is kept for the session, as all queries here start from it.
"""

from __future__ import annotations

import gzip
import os
import shutil
import tarfile
import uuid
import zipfile
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotwise.catalog import MODULE, event_lines, query
from slotwise.operators import aggregates, entries, extract
from slotwise.plans import checks, evidence
from slotwise.plans.api import Task
from slotwise.plans.parse import ParseResult, parse
from slotwise.sources import archive, discovery
from slotwise.sources.config import Mechanism, Product
from slotwise.storage import cut, shared_dir

PRODUCT = Product("events", discovery.COMPACT, (Mechanism("module1", "lifecycle", MODULE),), active_gap_seconds=1800)

#: The events as log lines in files, in SQL: half of them in each family, by slot.
LINES = """
WITH e AS (SELECT event_id AS i, user_id % 4 AS slot, user_id % 3 AS cpu, event_type AS process, event_id // 400 AS pid, event_id % 97 AS seq, event_id % 2 = 0 AS diagnostic, epoch_us(ts) AS ts_us, ts,
  strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS stamp FROM events),
l AS (SELECT *, CASE WHEN diagnostic THEN 'boards/slot_' || slot || '/debug_main.log' ELSE 'logs/slot_' || slot || '/syslog.log' END AS path,
  CASE WHEN diagnostic THEN stamp || ' Service=S; Slot=' || slot || '; CPU-Id=' || cpu || '; ProcessName=' || process || '-' || pid || '; Context=No[' || seq || '] EXAMPLE step ' || i || ')'
  ELSE replace(stamp, ' ', 'T') || ' host ' || process || '-' || pid || ': ' || CASE WHEN i % 5 = 0 THEN '' ELSE 'No[' || seq || ']' END || ' EXAMPLE Example step ' || i END AS line FROM e),
n AS (SELECT *, CAST(row_number() OVER (PARTITION BY path ORDER BY i) - 1 AS BIGINT) AS line_no FROM l),
x AS (SELECT *, CASE WHEN diagnostic AND cpu <> 0 THEN CAST(cpu AS VARCHAR) ELSE '' END AS cpu_id, CASE WHEN NOT diagnostic AND i % 5 = 0 THEN 0 ELSE seq END AS sequence FROM n),
board AS (SELECT slot, min(ts_us) AS start_us, max(ts_us) AS end_us, strftime(min(ts), '%Y%m%d%H%M%S') || '-' || strftime(max(ts), '%Y%m%d%H%M%S') AS dir_name FROM x GROUP BY ALL),
own AS (SELECT slot, cpu_id, min(ts_us) AS start_us, max(ts_us) AS end_us, strftime(min(ts), '%Y%m%d%H%M%S') || '-' || strftime(max(ts), '%Y%m%d%H%M%S') AS dir_name FROM x WHERE cpu_id <> '' GROUP BY ALL),
log AS (SELECT x.*, 'mech_modules/EXAMPLE/slot_' || x.slot || '/' || board.dir_name || CASE WHEN x.cpu_id <> '' THEN '/cpu_' || x.cpu_id || '/' || own.dir_name ELSE '' END || '/' || process || '-' || pid || '.log' AS file
  FROM x JOIN board USING (slot) LEFT JOIN own ON own.slot = x.slot AND own.cpu_id = x.cpu_id)
"""


@dataclass
class Built:
    """Folders and archives of one package, and, when asked for, its parse result and task folder."""

    root: str
    parsed: ParseResult | None = None
    task: str | None = None


_BUILT: dict[tuple[str, str], Built] = {}


def built(spark: SparkSession, d: str) -> Built:
    """The package of a table folder: ``logs`` (plain files), from which ``packed`` makes zip, tar.gz, nested zip and gz."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _BUILT:
        root = f"{shared_dir(spark).removeprefix('file://')}/slotwise-package-{uuid.uuid4().hex}"
        logs, i = f"{root}/logs", F.col("line_no")
        families = event_lines(spark, d).filter(i % 2 == 0).unionByName(event_lines(spark, d, "journal").filter(i % 2 == 1))
        path = F.when(i % 2 == 0, F.concat(F.lit("boards/slot_"), "scope", F.lit("/debug_main.log"))).otherwise(F.concat(F.lit("logs/slot_"), "scope", F.lit("/syslog.log")))
        os.makedirs(logs)
        rows = families.select(path.alias("path"), F.col("line").alias("text"), i.alias("ts_us"), F.lit(0).alias("sequence"), F.lit("").alias("source_file"), F.lit("").alias("raw"))
        evidence.write_evidence(rows, logs)
        _BUILT[key] = Built(root)
    return _BUILT[key]


def packed(root: str, name: str) -> str:
    """The path of the logs' folder, one of its files, or an archive of them, which is made when first asked for."""
    path, logs = f"{root}/{name}", f"{root}/logs"
    if os.path.exists(path):
        return path
    files = [os.path.relpath(f, logs) for f in archive.folder_files(logs)]
    if name == "plain.zip":
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for f in files:
                z.write(f"{logs}/{f}", f)
    elif name == "plain.tar.gz":
        with tarfile.open(path, "w:gz") as t:
            for f in files:
                t.add(f"{logs}/{f}", f)
    elif name == "nested.zip":
        with zipfile.ZipFile(path, "w") as z:
            z.write(packed(root, "plain.zip"), "deep/plain.zip")
    else:
        f = next(f for f in files if name == f"{f.replace('/', '-')}.gz")
        with open(f"{logs}/{f}", "rb") as source, gzip.open(path, "wb") as out:
            shutil.copyfileobj(source, out)
    return path


def parsed(spark: SparkSession, d: str) -> ParseResult:
    b = built(spark, d)
    b.parsed = b.parsed or parse(spark, packed(b.root, "plain.zip"), PRODUCT)
    return b.parsed


def task(spark: SparkSession, d: str) -> str:
    """The written task folder."""
    b = built(spark, d)
    if b.task is None:
        evidence.write_task(spark, parsed(spark, d), {"module1": "EXAMPLE"}, f"{b.root}/task", "events")
        b.task = f"{b.root}/task"
    return b.task


def _lines(spark: SparkSession, d: str, name: str) -> DataFrame:
    return archive.read_package(spark, packed(built(spark, d).root, name))


def _counted(lines: DataFrame, prefix: str = "") -> DataFrame:
    return lines.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("line")).alias("chars"))


_COUNTED = LINES + "SELECT {0} AS path, count(*) AS n, CAST(sum(length(line)) AS BIGINT) AS chars FROM n GROUP BY 1"


# -- sources ----------------------------------------------------------------------------------------


@query("a02_zip_members", _COUNTED.format("path"))
def a02(spark, d):
    return _counted(_lines(spark, d, "plain.zip"))


@query("a03_tar_members", _COUNTED.format("path"))
def a03(spark, d):
    return _counted(_lines(spark, d, "plain.tar.gz"))


@query("a04_gz_file", LINES + "SELECT line_no, line FROM n WHERE path = 'logs/slot_1/syslog.log'")
def a04(spark, d):
    """One compressed file as the package."""
    return _lines(spark, d, "logs-slot_1-syslog.log.gz").select("line_no", "line")


@query("a05_nested_archives", _COUNTED.format("'deep/plain.zip_extracted/' || path"))
def a05(spark, d):
    return _counted(_lines(spark, d, "nested.zip"))


@query("a07_folder", _COUNTED.format("path"))
def a07(spark, d):
    return _counted(_lines(spark, d, "logs"))


@query("a08_single_file", LINES + "SELECT line_no, line FROM n WHERE path = 'boards/slot_2/debug_main.log'")
def a08(spark, d):
    return _lines(spark, d, "logs/boards/slot_2/debug_main.log").select("line_no", "line")


@query("a09_line_scan", LINES + "SELECT path, line_no, line FROM n")
def a09(spark, d):
    return _lines(spark, d, "plain.zip").select("path", "line_no", "line")


@query("a15_boards_and_syslogs", LINES + "SELECT DISTINCT path, CASE WHEN diagnostic THEN 'diagnostic' ELSE 'journal' END AS family, CAST(slot AS VARCHAR) AS scope, CAST(dense_rank() OVER (ORDER BY path) - 1 AS INTEGER) AS file_ord FROM n")
def a15(spark, d):
    return discovery.discovered(_lines(spark, d, "plain.zip"), discovery.COMPACT).select("path", "family", "scope", "file_ord")


def _log_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = _lines(spark, d, "plain.zip")
    return discovery.log_lines(lines, cut(discovery.discovered(lines, discovery.COMPACT)))


_ENTRY = "ts_us, CAST(slot AS VARCHAR) AS slot, cpu_id, process AS process_name, CAST(pid AS VARCHAR) AS pid, sequence, line AS raw"


def _entry(found: DataFrame) -> DataFrame:
    return found.select(F.col("stamp.ts_us").alias("ts_us"), "slot", "cpu_id", "process_name", "pid", F.col("sequence").cast("long").alias("sequence"), "raw")


@query("a17_diagnostic_scan", LINES + f"SELECT {_ENTRY} FROM x WHERE diagnostic")
def a17(spark, d):
    return _entry(extract.diagnostic_entries(_log_lines(spark, d), MODULE))


@query("a18_journal_scan", LINES + f"SELECT {_ENTRY} FROM x WHERE NOT diagnostic")
def a18(spark, d):
    return _entry(extract.journal_entries(_log_lines(spark, d), MODULE))


@query("c17_content_times", LINES + "SELECT CAST(slot AS VARCHAR) AS scope, count(*) AS n, min(ts_us) AS first_us, max(ts_us) AS last_us FROM x WHERE diagnostic GROUP BY 1")
def c17(spark, d):
    return parsed(spark, d).stamps.groupBy("scope").agg(F.count(F.lit(1)).alias("n"), F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"))


# -- the parse plan ---------------------------------------------------------------------------------


@query("a10_parsed_entries", LINES + f"SELECT {_ENTRY}, CASE WHEN diagnostic THEN 'diagnostic' ELSE 'journal' END AS source FROM x")
def a10(spark, d):
    rows = parsed(spark, d).mechanisms["module1"].entries
    return rows.select("ts_us", "slot", "cpu_id", "process_name", "pid", F.col("sequence").cast("long").alias("sequence"), "raw", "source")


@query("u02_entries_of_all_files", LINES + "SELECT 'module1' AS module_key, count(*) FILTER (diagnostic) AS diagnostic, count(*) FILTER (NOT diagnostic) AS journal FROM x")
def u02(spark, d):
    return aggregates.counts_by_source(parsed(spark, d).mechanisms["module1"].entries).select("module_key", F.col("diagnostic").cast("long").alias("diagnostic"), F.col("journal").cast("long").alias("journal"))


@query("c15_timed_entries", LINES + "SELECT count(*) AS n, count(DISTINCT ts_us) AS times FROM x")
def c15(spark, d):
    return entries.timed(parsed(spark, d).mechanisms["module1"].entries).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("ts_us").alias("times"))


@query("l11_parsed_cycles", LINES + """SELECT 'board' AS scope, CAST(slot AS VARCHAR) AS slot, '' AS cpu_id, start_us, end_us, dir_name FROM board
UNION ALL SELECT 'cpu', CAST(slot AS VARCHAR), cpu_id, start_us, end_us, dir_name FROM own""")
def l11_parsed(spark, d):
    return parsed(spark, d).mechanisms["module1"].cycles.select("scope", "slot", F.coalesce("cpu_id", F.lit("")).alias("cpu_id"), "start_us", "end_us", "dir_name")


@query("j09_cpu_parents", LINES + "SELECT 'cpu:' || slot || ':' || cpu_id || ':board:' || slot || ':board:root:lifecycle:0:lifecycle:0' AS id, 'board:' || slot || ':board:root:lifecycle:0' AS parent_id FROM own")
def j09(spark, d):
    return parsed(spark, d).mechanisms["module1"].cycles.filter("scope = 'cpu'").select("id", "parent_id")


@query("j08_lifecycle_entries", LINES + "SELECT CAST(slot AS VARCHAR) AS slot, cpu_id, count(*) AS n FROM x GROUP BY ALL")
def j08(spark, d):
    rows = parsed(spark, d).mechanisms["module1"].placed
    return rows.groupBy("slot", "cpu_id").agg(F.count_if(F.col("lifecycle_id").isNotNull() & ((F.col("cpu_id") == "") | F.col("cpu_lifecycle_id").isNotNull())).alias("n"))


@query("l12_parsed_processes", LINES + ", p AS (SELECT slot, cpu_id, process, pid, count(*) AS n, list_sort(list(DISTINCT sequence) FILTER (sequence > 0)) AS s FROM x GROUP BY ALL) SELECT CAST(slot AS VARCHAR) AS slot, cpu_id, process AS process_name, CAST(pid AS VARCHAR) AS pid, n AS total_count, CAST(coalesce(s[-1] - s[1] + 1 - len(s), 0) AS BIGINT) AS n_missing FROM p")
def l12_parsed(spark, d):
    r = parsed(spark, d).mechanisms["module1"]
    who = r.cycles.select(F.col("id").alias("cycle_id"), "slot", F.coalesce("cpu_id", F.lit("")).alias("cpu_id"))
    return r.processes.join(who, "cycle_id").select("slot", "cpu_id", "process_name", "pid", "total_count", F.size("missing_sequences").cast("long").alias("n_missing"))


@query("l20_parsed_roles", LINES + "SELECT DISTINCT CAST(slot AS VARCHAR) AS slot, CASE WHEN (SELECT count(DISTINCT slot) FROM x WHERE diagnostic) > 1 THEN 'unknown' ELSE 'active' END AS role FROM x")
def l20_parsed(spark, d):
    return parsed(spark, d).slots.select("slot", "role")


# -- sinks and documents ----------------------------------------------------------------------------


@query("b03_written_evidence", LINES + "SELECT file AS path, '[' || CASE WHEN sequence > 0 THEN lpad(CAST(sequence AS VARCHAR), 4, '0') ELSE '....' END || '] [' || CASE WHEN diagnostic THEN 'diagnostic|slot_' || slot || '/debug_main.log' ELSE 'journal|slot_' || slot || '/syslog.log' END || '] ' || line AS text FROM log")
def b03(spark, d):
    """Every line of every written file."""
    lines = archive.read_package(spark, f"{task(spark, d)}/{evidence.ROOT}")
    return lines.select(F.concat(F.lit(evidence.ROOT + "/"), "path").alias("path"), F.col("line").alias("text"))


@query("o02_order_in_files", LINES + ", o AS (SELECT file, i, row_number() OVER (PARTITION BY file ORDER BY ts_us, sequence, diagnostic, line) AS n FROM log) SELECT file AS path, CAST(n - 1 AS BIGINT) AS line_no, CAST(i AS VARCHAR) AS step FROM o")
def o02(spark, d):
    lines = archive.read_package(spark, f"{task(spark, d)}/{evidence.ROOT}")
    return lines.select(F.concat(F.lit(evidence.ROOT + "/"), "path").alias("path"), "line_no", F.regexp_extract("line", r"step (\d+)\)?$", 1).alias("step"))


@query("b04_metadata", LINES + "SELECT count(DISTINCT slot) FILTER (diagnostic) AS diagnostic_scopes, count(DISTINCT slot) FILTER (NOT diagnostic) AS journal_files, count(*) FILTER (diagnostic) AS timestamps FROM x")
def b04(spark, d):
    c = Task(spark, task(spark, d)).metadata()["coverage"]
    return spark.createDataFrame([(c["diagnostic_scopes"], c["journal_files"], c["timestamps"])], "diagnostic_scopes long, journal_files long, timestamps long")


@query("b06_manifest", LINES + "SELECT 'mech_modules' AS path, 'directory' AS kind, count(DISTINCT file) AS file_count FROM log UNION ALL SELECT unnest(['metadata.json', 'result.json']), 'file', 1")
def b06(spark, d):
    """The manifest's rows, all of which verify."""
    folder = task(spark, d)
    rows = evidence.artifacts(evidence.file_hashes(spark, folder).filter("path <> 'parse_manifest.json'"))
    bad = evidence.verify_manifest(spark, folder)
    return rows.join(bad.select("path").distinct(), "path", "left_anti").select("path", "kind", "file_count")


@query("j20_same_output_again", LINES + "SELECT 'differences' AS what, CAST(0 AS BIGINT) AS n UNION ALL SELECT 'files', count(DISTINCT file) + 2 FROM log")
def j20(spark, d):
    """A second run over the folder instead of the archive writes the same."""
    b = built(spark, d)
    if not os.path.exists(f"{b.root}/again"):
        evidence.write_task(spark, parse(spark, f"{b.root}/logs", PRODUCT), {"module1": "EXAMPLE"}, f"{b.root}/again", "events")
    found = evidence.compare_outputs(spark, task(spark, d), f"{b.root}/again").agg(F.lit("differences").alias("what"), F.count(F.lit(1)).alias("n"))
    files = evidence.file_names(spark, f"{b.root}/again").filter("path <> 'parse_manifest.json'").agg(F.lit("files").alias("what"), F.count(F.lit(1)).alias("n"))
    return found.unionByName(files)


# -- questions --------------------------------------------------------------------------------------


@query("q01_slots", LINES + "SELECT DISTINCT CAST(slot AS VARCHAR) AS slot, TRUE AS known FROM x")
def q01(spark, d):
    t = Task(spark, task(spark, d))
    return spark.createDataFrame([(s["slot"], t.slot(f"slot_{s['slot']}") == s) for s in t.slots()], "slot string, known boolean")


@query("q02_modules", LINES + "SELECT DISTINCT 'module1' AS module_key, 'EXAMPLE' AS module_name, 'success' AS status, CAST(slot AS VARCHAR) AS slot FROM x")
def q02(spark, d):
    t = Task(spark, task(spark, d))
    return spark.createDataFrame([(m["module_key"], m["module_name"], m["status"], s) for m in t.modules() for s in t.module_slots(m["module_name"])], "module_key string, module_name string, status string, slot string")


@query("q03_lifecycles", LINES + ", c AS (SELECT slot, count(*) AS cpus FROM own GROUP BY 1) SELECT CAST(slot AS VARCHAR) AS slot, dir_name, CAST(coalesce(cpus, 0) AS BIGINT) AS cpu_cycles FROM board LEFT JOIN c USING (slot)")
def q03(spark, d):
    t = Task(spark, task(spark, d))
    rows = [(s["slot"], b["dir_name"], len(b["cpu_cycles"])) for s in t.slots() for b in t.lifecycles(s["slot"], processes=False)]
    return spark.createDataFrame(rows, "slot string, dir_name string, cpu_cycles long")


@query("q04_log_paths", LINES + "SELECT DISTINCT file AS path, TRUE AS there FROM log WHERE cpu_id = ''")
def q04(spark, d):
    """The logs that the index names by slot, cycle and process."""
    return Task(spark, task(spark, d)).log_paths().filter("cpu_id = ''").select("path", "there")


_ANCHORS = "SELECT slot, process, pid, min(ts_us) AS at_us, any_value(file) AS file FROM log WHERE cpu_id = '' GROUP BY slot, process, pid"


@query("q05_target_logs", LINES + f""", a AS ({_ANCHORS}), p AS (SELECT DISTINCT slot, cpu_id, process, pid FROM x WHERE cpu_id <> ''),
k AS (SELECT a.*, (SELECT count(*) FROM p JOIN own USING (slot, cpu_id) WHERE p.slot = a.slot AND p.process = a.process AND p.pid = a.pid AND at_us BETWEEN start_us AND end_us) AS more FROM a)
SELECT CAST(slot AS VARCHAR) || '/' || process || '/' || pid AS label, CASE WHEN more = 0 THEN 'exact' ELSE 'ambiguous' END AS match_status, CASE WHEN more = 0 THEN file END AS log_path FROM k""")
def q05(spark, d):
    """The log of each process at the time of its first entry on the board itself; ambiguous where a CPU's log fits as well."""
    rows = parsed(spark, d).mechanisms["module1"].entries.filter("cpu_id = ''").groupBy("slot", "process_name", "pid").agg(F.min("ts_us").alias("at_us"))
    anchors = rows.select(F.concat_ws("/", "slot", "process_name", "pid").alias("anchor_id"), "at_us", F.lit("example").alias("module"), F.concat(F.lit("slot_"), "slot").alias("slot"), "process_name", "pid")
    t = Task(spark, task(spark, d))
    logs = evidence.file_names(spark, str(t.folder)).filter(F.col("path").startswith(evidence.ROOT + "/"))
    from slotwise.plans import target

    return target.resolve(anchors, t.index(), logs).select(F.col("anchor_id").alias("label"), "match_status", "log_path")


@query("q07_artifact_check", "SELECT 'LP_DFX_OK' AS code, 1 AS n")
def q07(spark, d):
    return checks.artifact_check(spark, task(spark, d)).groupBy("code").agg(F.count(F.lit(1)).cast("int").alias("n"))
