"""Which files of a package are logs of which slot: listings as DataFrames.

Input is a table of ``path`` (relative, with slashes); output has a row a log file: family, scope (slot),
cpu, name, path, dump_time, rot_sequence, and file_ord by path parts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from slotwise.functions import text, times
from slotwise.functions.patterns import matches_any, portable


@dataclass(frozen=True)
class DiscoveryConfig:
    """Folders and name globs of a product; an empty ``loose_globs`` looks for no loose files."""

    diagnostic_dir: str
    diagnostic_globs: tuple[str, ...]
    private_dir: str
    journal_globs: tuple[str, ...]
    slot_glob: str = "slot_*"
    private_globs: tuple[str, ...] = ("slot_*", "slot_*_cpu_*")
    loose_globs: tuple[str, ...] = ()
    name_time: str | None = None
    rotation: str | None = None
    journal_once_a_name: bool = False
    archive_prefix: str = ""


#: The two products' layouts.
DEFAULT = DiscoveryConfig(
    "diag", ("diag.zip", "diaglog_*.log.zip", "diaglog_*.zip"), "varlog", ("journal.log", "journal.log.*.gz"),
    loose_globs=("diag.zip", "diaglog_*.log.zip", "diaglog_*.zip"), name_time=r".*_(\d{14})\..*", rotation=r"journal\.log(?:\.(\d+))?(?:\.gz)?", archive_prefix="varlog",
)
COMPACT = DiscoveryConfig("boards", ("debug_*.log",), "logs", ("syslog.log",), private_globs=("slot_*",), name_time=r".*_(\d{8})\..*", journal_once_a_name=True)


def path_key(path: Column) -> Column:
    """Order by path parts, not by characters."""
    return F.split(path, "/")


def _owner(parts: Column, top: str) -> tuple[Column, Column]:
    """Position of the folder ``top`` at the root or one level down (0: none), and the part behind it."""
    at = F.when(F.try_element_at(parts, F.lit(1)) == top, 1).when(F.try_element_at(parts, F.lit(2)) == top, 2).otherwise(0)
    return at, F.when(at > 0, F.try_element_at(parts, at + 1))


def outer(part: Column) -> Column:
    """The name of the archive that a part ``<name>_extracted`` stands for."""
    return F.regexp_replace(part, "_extracted$", "")


def diagnostics(paths: DataFrame, config: DiscoveryConfig) -> DataFrame:
    """Direct children of slot folders whose own or archive's name fits; all files of one archive share its name."""
    parts = F.split("path", "/")
    at, slot = _owner(parts, config.diagnostic_dir)
    name = outer(F.try_element_at(parts, at + 2))
    rows = paths.withColumn("_slot", slot).withColumn("name", name)
    rows = rows.filter(F.col("_slot").isNotNull() & matches_any(F.col("_slot"), [config.slot_glob]) & matches_any(F.col("name"), list(config.diagnostic_globs)))
    direct = (F.size(parts) == at + 2) | F.try_element_at(parts, at + 2).endswith("_extracted")
    return _described(rows.filter(direct), config, "diagnostic", text.slot_id(F.col("_slot")), F.lit(None).cast("string"))


def loose(paths: DataFrame, registered: DataFrame, fingerprints: DataFrame, config: DiscoveryConfig) -> DataFrame:
    """Fitting files elsewhere, slot ``loose``: without registered paths, and once per content, the first by path.

    ``fingerprints`` has path and content_fp; files without one are kept.
    """
    if not config.loose_globs:
        return _described(paths.limit(0).withColumn("name", F.lit("")), config, "diagnostic", F.lit("loose"), F.lit(None).cast("string"))
    parts = F.split("path", "/")
    fits = F.exists(parts, lambda p: matches_any(outer(p), list(config.loose_globs)))
    name = F.element_at(F.filter(F.transform(parts, outer), lambda p: matches_any(p, list(config.loose_globs))), 1)
    rows = paths.filter(fits).withColumn("name", name).join(registered.select("path"), "path", "left_anti").join(fingerprints, "path", "left")
    known = registered.join(fingerprints, "path").select("content_fp").distinct()
    rows = rows.join(known, "content_fp", "left_anti")
    unique = rows.filter("content_fp is not null").groupBy("content_fp").agg(F.min_by(F.struct("path", "name"), path_key(F.col("path"))).alias("f")).select("f.path", "f.name")
    rows = unique.unionByName(rows.filter("content_fp is null").select("path", "name"))
    return _described(rows, config, "diagnostic", F.lit("loose"), F.lit(None).cast("string"))


def journals(paths: DataFrame, config: DiscoveryConfig) -> DataFrame:
    """Files at any depth of slot and slot-cpu folders; where a folder has parts named like the archive, only those count."""
    parts = F.split("path", "/")
    at, folder = _owner(parts, config.private_dir)
    rows = paths.withColumn("_dir", folder).withColumn("name", F.element_at(parts, -1))
    rows = rows.filter(F.col("_dir").isNotNull() & matches_any(F.col("_dir"), list(config.private_globs)) & matches_any(F.col("name"), list(config.journal_globs)))
    if config.archive_prefix:
        inside = F.exists(F.slice(parts, at + 2, F.greatest(F.size(parts) - at - 2, F.lit(0))), lambda p: p.startswith(config.archive_prefix))
        rows = rows.withColumn("_in", inside).withColumn("_any", F.max("_in").over(W.partitionBy("_dir"))).filter(F.col("_in") | ~F.col("_any"))
    rows = rows.dropDuplicates(["path"])
    if config.journal_once_a_name:
        rows = rows.groupBy("_dir", "name").agg(F.min_by("path", path_key(F.col("path"))).alias("path"))
    who = text.private_slot(F.col("_dir"))
    return _described(rows, config, "journal", who["slot"], who["cpu"])


def _described(rows: DataFrame, config: DiscoveryConfig, family: str, slot: Column, cpu: Column) -> DataFrame:
    name = F.col("name")
    dumped = times.dump_time(name, portable(config.name_time)) if config.name_time and family == "diagnostic" else F.lit(None).cast("timestamp_ntz")
    turned = text.rotation(name, portable(config.rotation).java) if config.rotation and family == "journal" else F.lit(0)
    return rows.select(F.lit(family).alias("family"), slot.alias("scope"), cpu.alias("cpu"), "name", "path", dumped.alias("dump_time"), turned.alias("rot_sequence"))


def content_fingerprints(lines: DataFrame) -> DataFrame:
    """(path, content_fp): MD5 over a file's lines in order.

    Each line is hashed on its own first, so a file's hashes, not its text, come together.
    """
    hashed = lines.filter("error is null").select("path", F.struct("line_no", F.md5("line").alias("h")).alias("l"))
    return hashed.groupBy("path").agg(F.md5(F.array_join(F.transform(F.sort_array(F.collect_list("l")), lambda x: x["h"]), "\n")).alias("content_fp"))


def discovered(lines: DataFrame, config: DiscoveryConfig) -> DataFrame:
    """All log files of a package with file_ord: diagnostics, loose ones, then journals, by path parts.

    The listing has a row a file, so numbering it in one window is small.
    """
    paths = lines.select("path").distinct()
    found = diagnostics(paths, config)
    more = loose(paths, found, content_fingerprints(lines), config) if config.loose_globs else None
    rows = found.unionByName(journals(paths, config))
    rows = rows.unionByName(more) if more is not None else rows
    rank = F.when(F.col("family") == "journal", 2).when(F.col("scope") == "loose", 1).otherwise(0)
    return rows.withColumn("file_ord", (F.row_number().over(W.orderBy(rank, path_key(F.col("path")))) - 1).cast("int"))


def log_lines(lines: DataFrame, files: DataFrame) -> DataFrame:
    """The lines of discovered files, with family, scope, cpu, name and file_ord; the listing is one row a file."""
    return lines.join(files.select("path", "family", "scope", "cpu", "name", "file_ord"), "path").filter("error is null")
