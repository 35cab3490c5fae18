"""Checks of a task folder: documents, index against files, targets, and context windows around problem times."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotwise.functions import text, times
from slotwise.functions.patterns import portable
from slotwise.operators.aggregates import line_ranges, line_window, within_bytes
from slotwise.operators.extract import TIMESTAMP
from slotwise.plans import results, target
from slotwise.plans.evidence import ROOT, file_names, index_against_files, verify_manifest, write_atomic, write_json
from slotwise.sources.artifacts import ArtifactError, checked_shape, read_artifact

#: Which code is told first, and bounds of the deep windows.
PRIORITY = {
    "LP_RESULT_MISSING": 10, "LP_RESULT_INVALID": 11, "LP_SCHEMA_UNSUPPORTED": 12, "LP_ARTIFACT_INTEGRITY_FAILED": 15, "LP_MODULE_MISSING": 20, "LP_SLOT_MISSING": 30,
    "LP_TARGET_LOG_MISSING": 40, "LP_TARGET_AMBIGUOUS": 50, "LP_TARGET_MISSING": 60, "LP_V3_MISSING": 70, "LP_METADATA_MISSING": 80, "LP_METADATA_INVALID": 81,
    "LP_DEEP_WINDOW_EMPTY": 90, "LP_TARGET_TIME_MISSING": 100, "LP_MANIFEST_MISSING": 190, "LP_MANIFEST_INVALID": 200, "LP_PERFORMANCE_INVALID": 210, "LP_PERFORMANCE_STAGE_ERROR": 220, "LP_DFX_OK": 1000,
}
OTHER_PRIORITY, WINDOWS, WINDOW_LINES, WINDOW_BYTES, EXAMPLES = 500, 5, 48, 80 << 10, 10
ISSUE = "code string, severity string, message string"


def primary(issues: DataFrame) -> DataFrame:
    """The issue that is told first, as one line of at most 120 characters."""
    rank = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv]), F.col("code")), F.lit(OTHER_PRIORITY))
    best = issues.agg(F.min_by(F.struct("code", "message"), F.struct(rank, "code", "message")).alias("i"))
    return best.select(text.shortened(F.concat("i.code", F.lit(": "), text.single_line(F.col("i.message")))).alias("summary"))


def index_paths(result: dict) -> list[str]:
    """Evidence paths that a result document names."""
    from slotwise.plans.names import log_file_name, safe_segment

    out = []
    for m in result["mech_results"]:
        for s in m["slots"]:
            for b in s["board_cycles"]:
                base = f"{ROOT}/{safe_segment(m['module_name'])}/slot_{safe_segment(s['slot_id'])}/{safe_segment(b['dir_name'])}"
                out += [f"{base}/{log_file_name(p['process_name'], p['pid'])}" for p in b["processes"]]
                for c in b["cpu_cycles"]:
                    out += [f"{base}/cpu_{safe_segment(c['cpu_id'])}/{safe_segment(c['dir_name'])}/{log_file_name(p['process_name'], p['pid'])}" for p in c["processes"]]
    return out


def artifact_check(spark: SparkSession, folder: str) -> DataFrame:
    """(code, severity, message) of everything wrong with a folder; one row LP_DFX_OK if nothing is."""
    found: list[tuple] = []
    root, result, paths, boards = Path(folder), None, None, False
    shapes = {"result.json": ("LP_RESULT", (2,), {"mech_results": [dict]}), "metadata.json": ("LP_METADATA", (2,), {"coverage": dict}), "parse_manifest.json": ("LP_MANIFEST", (1,), {"artifacts": [dict], "task_id": str})}
    for name, (code, versions, shape) in shapes.items():
        try:
            if name == "result.json" and results.is_lined(root / name):
                boards = any([kind == "board" for kind, *_ in results.scan(root / name, strict=True)])  # a list: all of it is read
                paths = target.candidates(results.index_table(spark, root / name)).select(F.col("log_path").alias("path"))
                continue
            data = checked_shape(read_artifact(root / name, versions), {k: v if isinstance(v, list) else v for k, v in shape.items()})
            result = data if name == "result.json" else result
        except ArtifactError as e:
            kind = "LP_SCHEMA_UNSUPPORTED" if e.kind in ("unsupported_schema", "missing_schema") else f"{code}_{'MISSING' if e.kind == 'missing' else 'INVALID'}"
            found.append((kind, "error" if code == "LP_RESULT" else "warning", str(e)))
    if (root / "performance.json").exists():
        try:
            stages = read_artifact(root / "performance.json", (1,)).get("stages", [])
            found += [("LP_PERFORMANCE_STAGE_ERROR", "warning", s["name"]) for s in stages if s.get("status") == "failed"]
        except ArtifactError as e:
            found.append(("LP_PERFORMANCE_INVALID", "warning", str(e)))
    issues = spark.createDataFrame(found, ISSUE)
    if result is not None:
        boards = any(s["board_cycles"] for m in result["mech_results"] for s in m["slots"])
        paths = spark.createDataFrame([(p,) for p in index_paths(result)], "path string")
    if paths is not None:
        if not boards:
            issues = issues.unionByName(spark.createDataFrame([("LP_V3_MISSING", "warning", "no lifecycles in result.json")], ISSUE))
        files = file_names(spark, folder).filter(F.col("path").startswith(ROOT + "/"))
        differ = index_against_files(paths, files)
        code = F.when(F.col("problem") == "missing", "LP_TARGET_LOG_MISSING").otherwise("LP_EVIDENCE_ORPHAN")
        issues = issues.unionByName(differ.select(code.alias("code"), F.lit("warning").alias("severity"), F.concat("problem", F.lit(": "), "path").alias("message")))
    if (root / "parse_manifest.json").exists() and not any(c.startswith("LP_MANIFEST") for c, _, _ in found):
        bad = verify_manifest(spark, folder)
        issues = issues.unionByName(bad.select(F.lit("LP_ARTIFACT_INTEGRITY_FAILED").alias("code"), F.lit("error").alias("severity"), F.concat_ws(" ", "path", "field", F.coalesce("expected", F.lit("-")), F.coalesce("actual", F.lit("-"))).alias("message")))
    if not issues.limit(1).count():
        return spark.createDataFrame([("LP_DFX_OK", "info", "all checks passed")], ISSUE)
    return issues


def timed_lines(lines: DataFrame, timestamp_regex: str = TIMESTAMP) -> DataFrame:
    """Lines with the microseconds of their first time."""
    return lines.withColumn("ts_us", times.first_stamp(F.col("line"), portable(timestamp_regex))["ts_us"])


def deep_windows(lines: DataFrame, targets: list[tuple[str, int]]) -> DataFrame:
    """(path, line_no, line, is_target) of up to five windows of 48 lines, together at most 80 KiB.

    ``targets`` are (path, problem time in microseconds); each may use an equal share of the bytes.
    """
    out = None
    chosen = targets[:WINDOWS]
    for path, at in chosen:
        window = within_bytes(line_window(timed_lines(lines.filter(F.col("path") == path)), at, size=WINDOW_LINES), ["path"], WINDOW_BYTES // len(chosen))
        window = window.select("path", "line_no", "line", "is_target")
        out = window if out is None else out.unionByName(window)
    return out if out is not None else lines.limit(0).select("path", "line_no", "line", F.lit(False).alias("is_target"))


def report(spark: SparkSession, folder: str, windows: DataFrame | None = None) -> dict:
    """Writes dfx_report.json and dfx_summary.txt, and the windows to dfx_context; gives the report back."""
    issues = artifact_check(spark, folder).persist()
    counts = {r["severity"]: r["count"] for r in issues.groupBy("severity").count().collect()}
    examples = [r.asDict() for r in issues.orderBy("code", "message").limit(EXAMPLES).collect()]
    out = {"schema_version": 1, "issue_counts": counts, "issues": examples, "summary": primary(issues).first()["summary"]}
    if windows is not None:
        out["windows"] = [r.asDict() for r in line_ranges(windows, ["path"]).orderBy("path", "first_line").collect()]
        by: dict[str, list[str]] = {}
        for r in windows.orderBy("path", "line_no").collect():  # at most WINDOWS * WINDOW_LINES rows
            by.setdefault(r["path"], []).append(f"{'>' if r['is_target'] else ' '} {r['line_no']}: {r['line']}")
        for i, (path, rows) in enumerate(sorted(by.items())):
            write_atomic(Path(folder) / "dfx_context" / f"window_{i}.txt", f"# {path}\n" + "\n".join(rows) + "\n")
    issues.unpersist()
    write_json(Path(folder) / "dfx_report.json", out)
    write_atomic(Path(folder) / "dfx_summary.txt", out["summary"] + "\n")
    return out


def parse_targets(document: str) -> tuple[list[dict], str | None]:
    """Anchors from a JSON list, or from an object with targets and a common problem_time."""
    data = json.loads(document)
    if isinstance(data, list):
        return data, None
    return data["targets"], data.get("problem_time")
