"""Evidence files and artifacts: layout, writers, integrity, verification and comparison."""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from slotwise.functions import text, times
from slotwise.operators.lifecycle import merged_pidless
from slotwise.plans import results
from slotwise.plans.parse import MechanismResult, ParseResult
from slotwise.sources.archive import grouped, names_packed, names_unpacked, walked

ROOT = "mech_modules"
#: What a task folder may hold.
RESERVED = ("result.json", "metadata.json", "parse_manifest.json", "performance.json", "dfx_report.json", "dfx_summary.txt", "dfx_context", ROOT)


def evidence_path(module, slot, board, cpu, cpu_cycle, process, pid):
    """mech_modules/<module>/slot_<slot>/<board>[/cpu_<cpu>[/<cycle>]]/<file> as an expression; null parts are left out."""
    return F.concat_ws(
        "/", F.lit(ROOT), text.safe_segment(module), F.concat(F.lit("slot_"), text.safe_segment(slot)), text.safe_segment(board),
        F.when(cpu != "", F.concat(F.lit("cpu_"), text.safe_segment(cpu))), F.when(cpu != "", text.safe_segment(cpu_cycle)), text.log_file_name(process, pid),
    )


def evidence_line():
    """'[0007] [source|file] raw', dots for no sequence."""
    return F.concat(text.sequence_label(F.col("sequence")), F.lit(" ["), "source", F.lit("|"), "source_file", F.lit("] "), "raw")


def evidence(result: MechanismResult, module_name: str) -> DataFrame:
    """(path, text, ts_us, sequence, source_file, raw): every line of every process's evidence file, with its order."""
    if result.lifecycles is not None:
        rows = result.placed.withColumn("cycle_id", F.coalesce("cpu_lifecycle_id", "lifecycle_id"))
        rows = merged_pidless(rows, ["cycle_id"])
        dirs = result.cycles.select("id", "dir_name", "parent_id")
        boards = dirs.select(F.col("id").alias("lifecycle_id"), F.col("dir_name").alias("board"))
        cpus = dirs.filter("parent_id <> ''").select(F.col("id").alias("cpu_lifecycle_id"), F.col("dir_name").alias("cpu_dir"))
        rows = rows.join(boards, "lifecycle_id").join(cpus, "cpu_lifecycle_id", "left")
    else:
        boards = result.cycles.filter("cpu_id = ''").select("slot", "board_id", F.col("dir_name").alias("board"))
        cpus = result.cycles.filter("cpu_id <> ''").select("slot", "board_id", "own_id", "cpu_id", F.col("dir_name").alias("cpu_dir"))
        rows = result.placed.alias("r").join(boards.alias("b"), F.expr("r.slot = b.slot and r.board_id <=> b.board_id")).select("r.*", "b.board")
        rows = rows.alias("r").join(cpus.alias("c"), F.expr("r.slot = c.slot and r.board_id <=> c.board_id and r.own_id <=> c.own_id and r.cpu_id = c.cpu_id"), "left").select("r.*", "c.cpu_dir")
    path = evidence_path(F.lit(module_name), F.col("slot"), F.col("board"), F.col("cpu_id"), F.col("cpu_dir"), F.col("process_name"), F.col("pid"))
    return rows.select(path.alias("path"), evidence_line().alias("text"), "ts_us", "sequence", "source_file", "raw")


# -- writing ----------------------------------------------------------------------------------------


class _Commit(WriterCommitMessage):
    """The files of a task, as packed names, and the suffix that they have until all tasks have ended."""

    def __init__(self, names: list[str], suffix: str):
        self.names, self.suffix = names_packed(names) if names else b"", suffix

    def targets(self) -> Iterator[str]:
        return iter(names_unpacked(self.names) if self.names else ())


class EvidenceWriter(DataSourceWriter):
    """One file a path; tasks write beside the target, the driver renames when all have ended."""

    def __init__(self, root: str, job: str):
        self.root, self.job = os.path.abspath(root), job

    def write(self, rows: Iterator) -> _Commit:
        targets: dict[str, None] = {}
        folders: set[str] = set()
        suffix = f".{self.job}.{uuid.uuid4().hex}.part"
        out, now = None, None
        try:
            for row in rows:
                if row.path != now:
                    if out:
                        out.close()
                    target = inside(self.root, row.path)
                    folder = os.path.dirname(target)
                    if folder not in folders:
                        os.makedirs(folder, exist_ok=True)
                        folders.add(folder)
                    again = target in targets
                    targets[target] = None
                    out, now = open(target + suffix, "a" if again else "w", encoding="utf-8", newline=""), row.path
                out.write(row.text + "\n")
        finally:
            if out:
                out.close()
        return _Commit(list(targets), suffix)

    def commit(self, messages: list[_Commit | None]) -> None:
        for m in messages:
            for target in m.targets() if m else ():
                os.replace(target + m.suffix, target)

    def abort(self, messages: list[_Commit | None]) -> None:
        for m in messages:
            for target in m.targets() if m else ():
                if os.path.exists(target + m.suffix):
                    os.remove(target + m.suffix)


class EvidenceSink(DataSource):
    """``df.write.format("slotwise_evidence").option("path", folder).mode("append").save()``; columns path, text."""

    @classmethod
    def name(cls) -> str:
        return "slotwise_evidence"

    def writer(self, schema, overwrite: bool) -> EvidenceWriter:
        return EvidenceWriter(self.options["path"], uuid.uuid4().hex[:8])


def inside(root: str, path: str) -> str:
    """The path under ``root``; one that leads out of it is refused."""
    target = os.path.abspath(os.path.join(root, path))
    if os.path.commonpath([root, target]) != root:
        raise ValueError(f"path leaves the task folder: {path}")
    return target


def write_evidence(rows: DataFrame, folder: str) -> None:
    """Files by path, lines in entry order.  A file's lines come to one task, as one file must hold them; files spread over all."""
    spark = rows.sparkSession
    spark.dataSource.register(EvidenceSink)
    order = ["path", F.col("ts_us").asc_nulls_last(), "sequence", "source_file", "raw"]
    rows.repartition("path").sortWithinPartitions(*order).select("path", "text").write.format("slotwise_evidence").option("path", folder).mode("append").save()


def write_evidence_table(rows: DataFrame, path: str) -> None:
    """The same lines as text files in a folder a log, for stores that only Spark writes; names are encoded in the folders'."""
    order = ["path", F.col("ts_us").asc_nulls_last(), "sequence", "source_file", "raw"]
    rows.repartition("path").sortWithinPartitions(*order).select("path", F.col("text").alias("value")).write.partitionBy("path").mode("overwrite").text(path)


def write_atomic(path: str | Path, content: str) -> None:
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    part = path.with_name(f".{path.name}.{uuid.uuid4().hex}")
    part.write_text(content, encoding="utf-8", newline="")
    os.replace(part, path)


def write_json(path: str | Path, data) -> None:
    write_atomic(path, json.dumps(data, ensure_ascii=False, indent=2, sort_keys=True, default=str) + "\n")


def reset_task(folder: str | Path, task_id: str) -> None:
    """Removes what an earlier run left, if its manifest says that the folder is this task's; nothing else is touched."""
    folder = Path(folder)
    if not folder.exists() or not any(folder.iterdir()):
        return
    manifest = folder / "parse_manifest.json"
    owner = json.loads(manifest.read_text(encoding="utf-8")).get("task_id") if manifest.exists() else None
    if owner != task_id:
        raise ValueError(f"{folder} belongs to {owner!r}, not to {task_id!r}")
    for name in RESERVED:
        target = folder / name
        shutil.rmtree(target) if target.is_dir() else target.unlink(missing_ok=True)


# -- documents --------------------------------------------------------------------------------------


def _with_processes(result: MechanismResult, gathered: bool) -> DataFrame:
    """The cycles with their processes: one row each with a sorted list, or a row a process (null for a cycle without one)."""
    p = F.struct("process_name", "pid", "total_count", "missing_sequences")

    def held(key: list[str]) -> DataFrame:
        if gathered:
            return result.processes.groupBy(*key).agg(F.sort_array(F.collect_list(p)).alias("processes"))
        return result.processes.select(*key, p.alias("p"))

    name = "processes" if gathered else "p"
    if result.lifecycles is not None:
        found = held(["cycle_id"])
        return result.cycles.join(found, result.cycles["id"] == found["cycle_id"], "left").drop("cycle_id")
    found = held(["slot", "board_id", "own_id", "cpu_id"]).alias("p")
    c = result.cycles.alias("c")
    out = c.join(found, F.expr("c.slot = p.slot and c.board_id <=> p.board_id and c.own_id <=> p.own_id and c.cpu_id = p.cpu_id"), "left")
    identity = F.concat_ws("/", F.coalesce("c.board_id", F.lit("open")), F.when(F.col("c.cpu_id") != "", F.concat(F.lit("cpu:"), "c.cpu_id", F.lit(":"), F.coalesce("c.own_id", F.lit("unknown")))))
    parent = F.when(F.col("c.cpu_id") == "", "").otherwise(F.coalesce("c.board_id", F.lit("open")))
    return out.select("c.slot", identity.alias("id"), F.when(F.col("c.cpu_id") == "", "board").otherwise("cpu").alias("scope"), "c.cpu_id", parent.alias("parent_id"), "c.dir_name", "c.start_us", "c.end_us", f"p.{name}")


def process_index(result: MechanismResult) -> DataFrame:
    """(slot, id, scope, cpu_id, parent_id, dir_name, start_us, end_us, processes): the cycles with their processes, no raw text."""
    return _with_processes(result, True)


def write_result(path: str | Path, mechanisms: dict[str, MechanismResult], names: dict[str, str]) -> None:
    """result.json: modules, slots, board cycles with their processes and CPU cycles.

    Spark sorts and formats the processes; the driver writes them as they come, some at a time.
    """
    modules = []
    for key, r in mechanisms.items():
        header = {"module_key": key, "module_name": names[key], "status": r.status, "reason": r.reason}
        modules.append((header, iter(()) if r.cycles is None else results.cycle_lines(results.process_chunks(_with_processes(r, False)))))
    results.write_lines(path, modules)


def metadata_document(result: ParseResult) -> dict:
    """metadata.json: coverage, the slots with role and periods, private slots, all errors (they are held in the driver)."""
    c = result.coverage.first().asDict(True)
    iso = lambda col: times.iso(times.from_us(F.col(col)))
    periods = result.periods.groupBy(F.col("scope").alias("slot")).agg(F.sort_array(F.collect_list(F.struct(iso("start_us").alias("start"), iso("end_us").alias("end")))).alias("periods"))
    slots = [r.asDict(True) for r in result.slots.join(periods, "slot", "left").orderBy("slot").collect()]
    private = [r.asDict(True) for r in result.files.filter("family = 'journal'").groupBy("scope", "cpu").agg(F.sort_array(F.collect_list("path")).alias("files")).orderBy("scope", "cpu").collect()]
    errors = [r.asDict(True) for r in result.diagnostics.orderBy("message").collect()]
    return {"schema_version": 2, "coverage": c, "diagnostic_slots": slots, "private_slots": private, "errors": errors}


def write_task(spark: SparkSession, result: ParseResult, names: dict[str, str], folder: str, task_id: str) -> None:
    """Evidence, result, metadata and, last, the manifest."""
    reset_task(folder, task_id)
    for key, r in result.mechanisms.items():
        if r.placed is not None and r.cycles is not None:
            write_evidence(evidence(r, names[key]), folder)
    write_result(Path(folder) / "result.json", result.mechanisms, names)
    write_json(Path(folder) / "metadata.json", metadata_document(result))
    write_manifest(spark, folder, task_id, {k: r.status for k, r in result.mechanisms.items()})


def performance_document(stages: list[tuple[str, float, dict]], allowed: tuple[str, ...], metrics: tuple[str, ...]) -> dict:
    """performance.json: only known metric keys, and stages of unknown names as ``custom``."""
    rows = [{"name": n if n in allowed else "custom", "seconds": round(s, 6), "metrics": {k: v for k, v in m.items() if k in metrics}} for n, s, m in stages]
    return {"schema_version": 1, "total_seconds": round(sum(s for _, s, _ in stages), 6), "stages": rows}


# -- integrity --------------------------------------------------------------------------------------


@dataclass(frozen=True)
class _Files(InputPartition):
    names: bytes


class FilesReader(DataSourceReader):
    """Names of files that Spark's readers would see, with sizes and hashes unless only names are asked for."""

    def __init__(self, root: str, only: str):
        self.root, self.only = os.path.abspath(root), only

    def partitions(self) -> list[_Files]:
        return [_Files(g) for g in grouped(walked(self.root, links=True, hidden=False))] or [_Files(b"")]

    def read(self, part: _Files) -> Iterator[pa.RecordBatch]:
        names = names_unpacked(part.names) if part.names else []
        if self.only == "names":
            rows = [(n, None, None) for n in names]
        elif self.only == "compared":  # the manifest's hashes cover volatile values, so it is left out
            rows = [(n, None, compared_hash(os.path.join(self.root, n), self.root)) for n in names if n not in ("parse_manifest.json", "performance.json")]
        else:
            rows = [(n, *file_hash(os.path.join(self.root, n))) for n in names]
        columns = list(zip(*rows)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string()))], ["path", "size", "sha256"])


class FilesSource(DataSource):
    """``spark.read.format("slotwise_files").load(folder)``: path, size, sha256; option ``only`` is names, compared or unset."""

    @classmethod
    def name(cls) -> str:
        return "slotwise_files"

    def schema(self) -> str:
        return "path string, size long, sha256 string"

    def reader(self, schema) -> FilesReader:
        return FilesReader(self.options["path"], self.options.get("only", ""))


def file_hash(path: str) -> tuple[int, str]:
    """Size and SHA-256 of a file, read in blocks."""
    with open(path, "rb") as f:
        digest = hashlib.file_digest(f, "sha256")
        return f.tell(), digest.hexdigest()


def _files(spark: SparkSession, folder: str, only: str = "") -> DataFrame:
    spark.dataSource.register(FilesSource)
    return spark.read.format("slotwise_files").option("only", only).load(folder)


def file_hashes(spark: SparkSession, folder: str) -> DataFrame:
    """(path, size, sha256) of every file of a folder, read in parallel, many small files in a task."""
    return _files(spark, folder)


def file_names(spark: SparkSession, folder: str) -> DataFrame:
    """(path) of every file of a folder; none is opened."""
    return _files(spark, folder, "names").select("path")


def artifacts(files: DataFrame) -> DataFrame:
    """(path, kind, size, sha256, file_count): top-level files, and folders by size, count and hash over their files in path order.

    A folder's hash runs over its sorted files one after another, so it is one task's work, but none holds them at once.
    """

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: dict[str, list] = {}
        for b in batches:
            for top, path, size, sha in zip(*(c.to_pylist() for c in b.columns)):
                at = done.setdefault(top, [hashlib.sha256(), 0, 0])
                at[0].update(f"{path[len(top) + 1:]}\0{sha}\n".encode())
                at[1] += size
                at[2] += 1
        yield pa.RecordBatch.from_pylist([{"path": k, "kind": "directory", "size": n, "sha256": h.hexdigest(), "file_count": c} for k, (h, n, c) in done.items()], schema=pa.schema([("path", pa.string()), ("kind", pa.string()), ("size", pa.int64()), ("sha256", pa.string()), ("file_count", pa.int64())]))

    top = F.substring_index("path", "/", 1)
    rows = files.withColumn("top", top).withColumn("folder", top != F.col("path"))
    inner = rows.filter("folder").select("top", "path", "size", "sha256").repartition("top").sortWithinPartitions("top", F.split("path", "/"))
    folders = inner.mapInArrow(folded, "path string, kind string, size long, sha256 string, file_count long")
    return folders.unionByName(rows.filter(~F.col("folder")).select("path", F.lit("file").alias("kind"), "size", "sha256", F.lit(1).cast("long").alias("file_count")))


def write_manifest(spark: SparkSession, folder: str, task_id: str, stages: dict[str, str]) -> None:
    kept = file_hashes(spark, folder).filter("path <> 'parse_manifest.json'")
    rows = [r.asDict() for r in artifacts(kept).orderBy("path").collect()]
    status = "partial" if "failed" in stages.values() else "success"
    write_json(Path(folder) / "parse_manifest.json", {"schema_version": 1, "contract_version": 1, "task_id": task_id, "status": status, "stages": stages, "artifacts": rows})


def verify_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """(path, field, expected, actual): every difference between the manifest and what is there."""
    named = json.loads((Path(folder) / "parse_manifest.json").read_text(encoding="utf-8"))["artifacts"]
    schema = "path string, kind string, size long, sha256 string, file_count long"
    want = spark.createDataFrame([tuple(a[k] for k in ("path", "kind", "size", "sha256", "file_count")) for a in named], schema)
    have = artifacts(file_hashes(spark, folder).filter("path <> 'parse_manifest.json'"))
    w, h = want.alias("w"), have.alias("h")
    fields = F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"w.{c}").cast("string").alias("expected"), F.col(f"h.{c}").cast("string").alias("actual")) for c in ("kind", "size", "sha256", "file_count")])
    rows = w.join(h, F.col("w.path") == F.col("h.path"), "full_outer").select(F.coalesce("w.path", "h.path").alias("path"), F.inline(fields))
    return rows.filter(~F.col("expected").eqNullSafe(F.col("actual")))


def index_against_files(index_paths: DataFrame, files: DataFrame) -> DataFrame:
    """(path, problem): evidence that the index names and is missing, and files that nothing names."""
    missing = index_paths.select("path").distinct().join(files.select("path"), "path", "left_anti").withColumn("problem", F.lit("missing"))
    orphan = files.select("path").join(index_paths.select("path").distinct(), "path", "left_anti").withColumn("problem", F.lit("orphan"))
    return missing.unionByName(orphan)


def normalised_json(text_: str, root: str) -> str:
    """JSON with sorted keys, without creation times, and the root folder as a mark."""

    def plain(v):
        if isinstance(v, dict):
            return {k: plain(x) for k, x in sorted(v.items()) if k != "created_at"}
        return [plain(x) for x in v] if isinstance(v, list) else v.replace(root, "<root>") if isinstance(v, str) else v

    return json.dumps(plain(json.loads(text_)), sort_keys=True, ensure_ascii=False)


def compared_hash(path: str, root: str) -> str:
    """The hash of a file's content; JSON without volatile values, a result in lines a line at a time."""
    if not path.endswith(".json"):
        return file_hash(path)[1]
    if not results.is_lined(path):
        return hashlib.sha256(normalised_json(Path(path).read_text(encoding="utf-8"), root).encode()).hexdigest()
    digest = hashlib.sha256()
    with open(path, "rb") as f:
        for line in f:
            digest.update(line.replace(root.encode(), b"<root>"))
    return digest.hexdigest()


def compare_outputs(spark: SparkSession, left: str, right: str) -> DataFrame:
    """(path, difference): files of only one side, and those whose content differs after volatile values are dropped."""
    l, r = (_files(spark, folder, "compared").filter("sha256 is not null").alias(side) for folder, side in ((left, "l"), (right, "r")))
    rows = l.join(r, F.col("l.path") == F.col("r.path"), "full_outer")
    kind = F.when(F.col("r.path").isNull(), "only_left").when(F.col("l.path").isNull(), "only_right").when(F.col("l.sha256") != F.col("r.sha256"), "content")
    return rows.select(F.coalesce("l.path", "r.path").alias("path"), kind.alias("difference")).filter("difference is not null")
