"""Questions about a written task folder: slots, modules, lifecycles, logs, targets."""

from __future__ import annotations

import json
import os
import platform
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotwise.functions import times
from slotwise.plans import evidence, results, target
from slotwise.plans.names import log_file_name, safe_segment
from slotwise.sources.artifacts import read_artifact

class Task:
    """A task folder; its documents are read when asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, Path(folder)

    def metadata(self) -> dict:
        return read_artifact(self.folder / "metadata.json", (2,))

    def result(self) -> dict:
        return read_artifact(self.folder / "result.json", (2,))

    def slots(self) -> list[dict]:
        return self.metadata()["diagnostic_slots"]

    def slot(self, slot: str) -> dict | None:
        name = slot.removeprefix("slot_")
        return next((s for s in self.slots() if s["slot"] == name), None)

    def _mechanisms(self, slot: str | None = None, processes: bool = False) -> list[dict]:
        """``mech_results`` with the headers of all slots, of which only ``slot`` has cycles; a result in lines is never held whole."""
        path = self.folder / "result.json"
        if not results.is_lined(path):
            return self.result()["mech_results"]
        out: list[dict] = []
        for kind, header, begin, end in results.scan(path):
            if kind == "module":
                out.append(header | {"slots": []})
            elif kind == "slot":
                out[-1]["slots"].append(header | {"board_cycles": []})
            elif out[-1]["slots"][-1]["slot_id"] == slot:
                cycle = header | {"processes": list(results.processes_in(path, begin, end)) if processes else []}
                boards = out[-1]["slots"][-1]["board_cycles"]
                if kind == "board":
                    boards.append(cycle | {"cpu_cycles": []})
                else:
                    boards[-1]["cpu_cycles"].append(cycle)
        return out

    def modules(self) -> list[dict]:
        return [{k: m[k] for k in ("module_key", "module_name", "status")} for m in self._mechanisms()]

    def module_slots(self, module: str) -> list[str]:
        return [s["slot_id"] for m in self._mechanisms() if module in (m["module_key"], m["module_name"]) for s in m["slots"]]

    def lifecycles(self, slot: str, processes: bool = True) -> list[dict]:
        """Board cycles of a slot, over all modules, on request without their processes."""
        name = slot.removeprefix("slot_")
        return [b | {"module_key": m["module_key"]} for m in self._mechanisms(name, processes) for s in m["slots"] if s["slot_id"] == name for b in s["board_cycles"]]

    def log_paths(self) -> DataFrame:
        """(module_name, slot, cpu_id, cycle_id, process_name, pid, path, there): the log of each process, for as many as there are."""
        files = evidence.file_names(self.spark, str(self.folder)).select("path", F.lit(True).alias("_there"))
        rows = target.candidates(self.index()).withColumnRenamed("log_path", "path").join(files, "path", "left")
        return rows.select("module_name", "slot", "cpu_id", "cycle_id", "process_name", "pid", "path", F.col("_there").isNotNull().alias("there"))

    def log_path(self, module: str, slot: str, board: str, process: str, pid: str = "", cpu: str = "", cpu_cycle: str = "") -> Path:
        parts = [evidence.ROOT, safe_segment(module), f"slot_{safe_segment(slot)}", safe_segment(board)] + ([f"cpu_{safe_segment(cpu)}", safe_segment(cpu_cycle)] if cpu else [])
        return self.folder.joinpath(*parts, log_file_name(process, pid))

    def index(self) -> DataFrame:
        """The cycle index as a table; see ``results.index_table``."""
        return results.index_table(self.spark, self.folder / "result.json")

    def target_logs(self, anchors: list[dict], explain: bool = False) -> list[dict]:
        """The log that covers each anchor's problem time: module, slot, process_name, problem_time and perhaps pid and label."""
        rows = [(i, a.get("problem_time"), a["module"], a["slot"], a["process_name"], a.get("pid")) for i, a in enumerate(anchors)]
        df = self.spark.createDataFrame(rows, "anchor_id int, problem_time string, module string, slot string, process_name string, pid string")
        # Cycles hold local times, so an offset of the problem time is left out of the comparison.
        stamp = times.parsed_loose(F.col("problem_time"))
        df = df.withColumn("at_us", stamp["ts_us"] + F.coalesce(stamp["tz_offset_s"], F.lit(0)).cast("long") * 1_000_000)
        logs = evidence.file_names(self.spark, str(self.folder)).filter(F.col("path").startswith(evidence.ROOT + "/"))
        found = sorted(target.resolve(df, self.index(), logs).collect(), key=lambda r: r["anchor_id"])
        return [target.payload(r, {k: v for k, v in anchors[r["anchor_id"]].items() if k != "problem_time"} | {"label": anchors[r["anchor_id"]].get("label") or anchors[r["anchor_id"]]["process_name"]}, explain) for r in found]


def lifecycle_text(lives, level: str = "summary") -> str:
    """Lifecycles for reading: off, errors, summary, decisions or full."""
    if level == "off":
        return ""
    out = [f"{r.severity.upper()} {r.type} {r.slot} {r.related_process} {','.join(r.observed_pids)}" for r in lives.issues.orderBy("severity", "slot", "related_process").collect() if level != "errors" or r.severity == "error"]
    if level == "errors":
        return "\n".join(out)
    rows = lives.lifecycles.orderBy("slot", "scope", F.col("cpu_id").asc_nulls_first(), "parent_lifecycle_id", "lifecycle_index").collect()
    out = [f"{r.id} {r.start_us}..{r.end_us} rows={r.log_count} candidates={len(r.candidate_indices)}" + ("" if r.lifecycle_reliable else " UNRELIABLE") for r in rows] + out
    if level in ("decisions", "full"):
        out += [f"{r.scope} {r.slot} {r.left_index}|{r.right_index} {r.decision} {r.reason or ''} gap={r.gap_seconds:g}" for r in lives.decisions.orderBy("scope", "slot", "right_index").collect()]
    if level == "full":
        out += [f"wrap {r.slot} {r.process_name} {r.old_sequence}->{r.new_sequence}" for r in lives.evidence.orderBy("slot", "right_index", "process_name").collect()]
    return "\n".join(out)


def doctor(folder: str | None = None) -> list[dict]:
    """What a run needs and has."""
    import pyarrow
    import pyspark

    rows = [{"check": "python", "ok": True, "detail": platform.python_version()}, {"check": "pyspark", "ok": int(pyspark.__version__.split(".")[0]) >= 4, "detail": pyspark.__version__}, {"check": "pyarrow", "ok": True, "detail": pyarrow.__version__}]
    try:
        import yaml

        rows.append({"check": "yaml", "ok": True, "detail": yaml.__version__})
    except ImportError:
        rows.append({"check": "yaml", "ok": False, "detail": "missing: only JSON configurations can be read"})
    if folder:
        rows.append({"check": "writable", "ok": os.access(folder, os.W_OK), "detail": folder})
    return rows


def as_json(data) -> str:
    return json.dumps(data, ensure_ascii=False, indent=2, default=str)
