"""Command line: ``python -m slotwise.cli COMMAND --help``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from slotwise.plans import api, checks, evidence, onboarding
from slotwise.plans.parse import parse
from slotwise.sources import artifacts, config

#: Exit codes.
OK, FAILED, USAGE, DRAFT = 0, 1, 2, 4


def session() -> SparkSession:
    spark = SparkSession.builder.appName("slotwise").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="slotwise")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *names: str, **options):
        c = sub.add_parser(name)
        for n in names:
            c.add_argument(n)
        for k, v in options.items():
            c.add_argument("--" + k.replace("_", "-"), **v)
        return c

    command("parse", "package", "folder", config=dict(required=True), product=dict(default="default"), task=dict(default="task"))
    for name in ("info", "slots", "modules", "artifact-check"):
        command(name, "folder")
    command("lifecycles", "folder", "slot")
    command("target-logs", "folder", module={}, slot={}, process={}, pid={}, problem_time={}, targets_json={}, explain=dict(action="store_true"))
    command("dfx-output", "folder")
    command("compare", "left", "right")
    command("explain-config", "config", product=dict(default="default"))
    command("test-pattern", "config", "line", product=dict(default="default"), module=dict(required=True))
    command("onboarding", "action", candidate={}, samples=dict(nargs="+", default=[]), encoding=dict(default="utf-8"))
    command("doctor", folder={})
    return p


def run(argv: list[str]) -> int:
    a = arguments().parse_args(argv)
    if a.command == "doctor":
        rows = api.doctor(a.folder)
        print(api.as_json(rows))
        return OK if all(r["ok"] for r in rows) else FAILED
    if a.command == "explain-config":
        print(api.as_json(config.explain(config.product(a.product, config.load(a.config)["products"][a.product]))))
        return OK
    spark = session()
    if a.command == "parse":
        product = config.product(a.product, config.load(a.config)["products"][a.product])
        result = parse(spark, a.package, product)
        evidence.write_task(spark, result, {m.key: m.module.module_name for m in product.mechanisms}, a.folder, a.task)
        print(api.as_json({k: {"status": r.status, "reason": r.reason} for k, r in result.mechanisms.items()}))
        return FAILED if any(r.status == "failed" for r in result.mechanisms.values()) else OK
    if a.command == "test-pattern":
        product = config.product(a.product, config.load(a.config)["products"][a.product])
        module = next(m.module for m in product.mechanisms if m.key == a.module)
        print(api.as_json(onboarding.explain_line(spark, a.line, module).first().asDict()))
        return OK
    if a.command == "onboarding":
        lines = onboarding.sample_table(spark, artifacts.read_samples(a.samples, a.encoding))
        if a.action == "analyze":
            print(api.as_json({k: [r.asDict(True) for r in df.collect()] for k, df in onboarding.analyze(lines).items()}))
            return OK
        with open(a.candidate, "rb") as f:
            candidate = artifacts.read_candidate(f.read())
        checked = onboarding.validate(lines, candidate)
        print(api.as_json(onboarding.build_draft(candidate) if a.action == "build-draft" else checked))
        return FAILED if checked["status"] == "invalid" else DRAFT if a.action == "build-draft" else OK
    if a.command == "compare":
        differ = evidence.compare_outputs(spark, a.left, a.right)
        differ.orderBy("path").show(1000, False)
        return FAILED if differ.limit(1).count() else OK
    if a.command == "artifact-check":
        issues = checks.artifact_check(spark, a.folder)
        issues.orderBy("code", "message").show(1000, False)
        return FAILED if issues.filter("severity = 'error'").limit(1).count() else OK
    if a.command == "dfx-output":
        print(api.as_json(checks.report(spark, a.folder)))
        return OK
    task = api.Task(spark, a.folder)
    if a.command == "target-logs":
        anchors, common = checks.parse_targets(open(a.targets_json, encoding="utf-8").read()) if a.targets_json else ([{"module": a.module, "slot": a.slot, "process_name": a.process, "pid": a.pid}], a.problem_time)
        answers = task.target_logs([{"problem_time": common} | x if common else x for x in anchors], a.explain)
        print(api.as_json(answers if len(answers) > 1 else answers[0]))
        return OK
    print(api.as_json({"info": task.metadata, "slots": task.slots, "modules": task.modules, "lifecycles": lambda: task.lifecycles(a.slot)}[a.command]()))
    return OK


if __name__ == "__main__":
    sys.exit(run(sys.argv[1:]))
