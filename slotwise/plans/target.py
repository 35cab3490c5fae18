"""Which process log covers a problem time?  Selection over the cycle index, for one anchor or for many."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from slotwise.functions import times
from slotwise.plans.evidence import evidence_path


def normal_slot(slot: Column) -> Column:
    return F.regexp_replace(slot, "(?i)^slot_", "")


def candidates(index: DataFrame) -> DataFrame:
    """(module_key, module_name, slot, cpu_id, process_name, pid, cycle_id, start_us, end_us, log_path) from the modules' index.

    ``index`` is ``evidence.process_index`` of one or more modules with module_key and module_name.
    """
    boards = index.filter("scope = 'board'").select("module_key", "slot", F.col("id").alias("_b"), F.col("dir_name").alias("_board")).distinct()
    rows = index.withColumn("_b", F.when(F.col("scope") == "board", F.col("id")).otherwise(F.col("parent_id"))).join(boards, ["module_key", "slot", "_b"])
    rows = rows.withColumn("p", F.explode("processes"))
    cpu = F.coalesce("cpu_id", F.lit(""))
    path = evidence_path(F.col("module_name"), F.col("slot"), F.col("_board"), cpu, F.col("dir_name"), F.col("p.process_name"), F.col("p.pid"))
    return rows.select("module_key", "module_name", "slot", cpu.alias("cpu_id"), "p.process_name", "p.pid", "p.total_count", F.col("id").alias("cycle_id"), "start_us", "end_us", path.alias("log_path"))


def selected(pairs: DataFrame, key: list[str]) -> DataFrame:
    """(key, match_status, choice, reason, caveats) over candidate rows with start_us, end_us and at_us.

    The only interval that contains the time is exact, several are ambiguous; else the only nearest one
    is taken; of intervals without bounds just one.  Open at one side is containment at that side.
    """
    every = W.partitionBy(*key)
    inside, far = times.contains(F.col("start_us"), F.col("end_us"), F.col("at_us")), times.distance_us(F.col("start_us"), F.col("end_us"), F.col("at_us"))
    rows = pairs.withColumn("_in", inside).withColumn("_far", far)
    rows = rows.withColumn("_least", F.min("_far").over(every))
    choice = F.struct(*[c for c in pairs.columns if c not in key])
    agg = rows.groupBy(*key).agg(
        F.count_if("_in").alias("n_in"), F.count("_far").alias("n_timed"), F.count_if(F.col("_far") == F.col("_least")).alias("n_near"), F.count_if(F.col("_far").isNull()).alias("n_open"),
        F.min_by(choice, F.when(F.col("_in"), F.struct("cycle_id", "log_path"))).alias("exact"), F.min_by(choice, F.when(F.col("_far") == F.col("_least"), F.struct("cycle_id", "log_path"))).alias("near"),
        F.min_by(choice, F.when(F.col("_far").isNull(), F.struct("cycle_id", "log_path"))).alias("open"),
    )
    timed = F.col("n_timed") > 0
    status = (
        F.when(F.col("n_in") == 1, "exact").when(F.col("n_in") > 1, "ambiguous").when(timed & (F.col("n_near") == 1), "nearest")
        .when(timed, "ambiguous").when(F.col("n_open") == 1, "unknown").otherwise("ambiguous")
    )
    reason = (
        F.when(F.col("n_in") > 1, "multiple exact cycles match target process and problem_time").when(timed & (F.col("n_in") == 0) & (F.col("n_near") > 1), "nearest tie for target process and problem_time")
        .when(~timed & (F.col("n_open") > 1), "multiple unknown cycles match target process").otherwise("")
    )
    caveat = (
        F.when(F.col("n_in") > 0, F.array().cast("array<string>")).when(timed & (F.col("n_near") == 1), F.array(F.lit("nearest-cycle fallback"))).when(timed, F.array(F.lit("nearest-cycle fallback tied")))
        .when(F.col("n_open") == 1, F.array(F.lit("no timed cycle available; using unknown cycle"))).otherwise(F.array(F.lit("no timed cycle available")))
    )
    chosen = F.when(F.col("n_in") == 1, F.col("exact")).when((F.col("n_in") == 0) & timed & (F.col("n_near") == 1), F.col("near")).when(~timed & (F.col("n_open") == 1), F.col("open"))
    return agg.select(*key, status.alias("match_status"), chosen.alias("choice"), reason.alias("reason"), caveat.alias("caveats"))


def resolve(anchors: DataFrame, index: DataFrame, logs: DataFrame | None = None) -> DataFrame:
    """One row an anchor: match_status, error_code, module_key, cycle_id, log_path, reason, caveats.

    ``anchors`` has anchor_id, at_us, module, slot, process_name and pid (null: any).  Modules fit by key or
    name and processes by name, case ignored; the pid must be the same.  With ``logs`` (path), a
    log that is not there is looked for once in the CPU folders of its board.
    """
    modules = index.select("module_key", "module_name").distinct()
    named = anchors.join(modules, (F.lower("module") == F.lower("module_key")) | (F.lower("module") == F.lower("module_name")), "left")
    n_modules = named.groupBy("anchor_id").agg(F.count("module_key").alias("n_modules"), F.min("module_key").alias("module_key"))
    slots = index.select("module_key", F.col("slot").alias("_slot")).distinct()
    base = anchors.join(n_modules, "anchor_id").withColumn("_slot", normal_slot(F.col("slot")))
    base = base.join(slots.withColumn("_has", F.lit(True)), ["module_key", "_slot"], "left")
    c = candidates(index).alias("c")
    a = base.filter("n_modules = 1 and _has").select("anchor_id", "at_us", F.col("module_key").alias("_m"), "_slot", F.lower("process_name").alias("_p"), F.col("pid").alias("_pid")).alias("a")
    pairs = a.join(c, F.expr("a._m = c.module_key and a._slot = c.slot and a._p = lower(c.process_name) and (a._pid is null or a._pid = c.pid)"))
    pairs = pairs.select("a.anchor_id", "a.at_us", "c.cycle_id", "c.start_us", "c.end_us", "c.log_path", "c.pid", "c.total_count")
    hit = selected(pairs, ["anchor_id"])
    out = base.join(hit, "anchor_id", "left")
    status = F.when(F.col("at_us").isNull() | (F.col("n_modules") == 0) | F.col("_has").isNull(), F.when(F.col("n_modules") > 1, "ambiguous").otherwise("missing")).otherwise(F.coalesce("match_status", F.lit("missing")))
    code = (
        F.when(F.col("at_us").isNull(), "LP_TARGET_TIME_INVALID").when(F.col("n_modules") == 0, "LP_MODULE_MISSING").when(F.col("n_modules") > 1, "LP_TARGET_AMBIGUOUS").when(F.col("_has").isNull(), "LP_SLOT_MISSING")
        .when(F.col("match_status").isNull(), "LP_TARGET_MISSING").when(F.col("match_status") == "ambiguous", "LP_TARGET_AMBIGUOUS")
    )
    out = out.select("anchor_id", status.alias("match_status"), code.alias("error_code"), "module_key", F.col("choice.cycle_id").alias("cycle_id"), F.col("choice.log_path").alias("log_path"), "reason", F.coalesce("caveats", F.array().cast("array<string>")).alias("caveats"))
    return out if logs is None else with_logs(out, logs)


def with_logs(targets: DataFrame, logs: DataFrame) -> DataFrame:
    """Targets whose log exists keep its path; else a single file of that name in a CPU folder of the board is taken."""
    there = logs.select(F.col("path").alias("log_path"), F.lit(True).alias("_there")).distinct()
    cpu_free = F.regexp_replace("path", "/cpu_[^/]+/", "/")
    nested = logs.filter(F.col("path").rlike("/cpu_[^/]+/[^/]+$")).groupBy(cpu_free.alias("log_path")).agg(F.min("path").alias("_one"), F.count(F.lit(1)).alias("_n"))
    rows = targets.join(there, "log_path", "left").join(nested, "log_path", "left")
    found = F.col("_there").isNotNull() | F.col("log_path").isNull()
    many = ~found & (F.col("_n") > 1)
    lost = ~found & F.col("_n").isNull()
    return rows.select(
        "anchor_id", F.when(many, "ambiguous").when(lost, "missing").otherwise(F.col("match_status")).alias("match_status"),
        F.when(many, "LP_TARGET_AMBIGUOUS").when(lost, "LP_TARGET_LOG_MISSING").otherwise(F.col("error_code")).alias("error_code"), "module_key", "cycle_id",
        F.when(found, F.col("log_path")).when(many | lost, F.lit(None)).otherwise(F.col("_one")).alias("log_path"), "reason", "caveats",
    )


def payload(row, anchor: dict, explain: bool = False) -> dict:
    """The JSON contract for one resolved anchor."""
    target = dict(anchor) | {"match_status": row["match_status"], "caveats": list(row["caveats"]) + ([row["reason"]] if row["reason"] else [])}
    if row["log_path"]:
        target["log_path"] = row["log_path"]
    out = {"schema_version": 1, "api_version": 1, "target_logs": [target]}
    if explain:
        target["error_code"] = row["error_code"]
        out["selection_diagnostics"] = {"module_key": row["module_key"], "cycle_id": row["cycle_id"], "error_code": row["error_code"], "reason": row["reason"]}
    return out
