"""From packages to evidence, documents, checks and answers."""

import gzip
import io
import json
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from slotwise.plans import checks, evidence, target
from slotwise.plans.parse import parse
from slotwise.sources.archive import is_safe_member, overlap, read_package
from slotwise.sources.discovery import discovered
from tests import packages

S = 1_809_820_800_000_000  # 2027-05-09T00:00:00


@pytest.fixture(scope="module")
def parsed(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("in") / "package.zip"
    path.write_bytes(packages.default_package())
    return parse(spark, str(path), packages.PRODUCT)


@pytest.fixture(scope="module")
def task(spark, parsed, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("task"))
    evidence.write_task(spark, parsed, packages.NAMES, folder, "t1")
    return folder


@pytest.mark.parametrize("name,safe", [("a/b.log", True), ("", False), ("/a", False), ("..", False), ("a/../b", False), ("C:\\x", False), ("\\\\host\\x", False), ("a..b", True)])
def test_safe_members(name, safe):
    assert is_safe_member(name) == safe


def test_discovery(parsed):
    rows = [(r.family, r.scope, r.cpu, r.name, r.rot_sequence) for r in parsed.files.orderBy("file_ord").collect()]
    assert rows == [
        ("diagnostic", "1", None, "diag.zip", 0), ("diagnostic", "1", None, "diaglog_1_20270509070000.log.zip", 0), ("diagnostic", "2", None, "diaglog_2_20270509070000.log.zip", 0),
        ("diagnostic", "loose", None, "diaglog_8_20270509070000.log.zip", 0),  # the other stray file has the content of a known one
        ("journal", "1", None, "journal.log", 0), ("journal", "1", None, "journal.log.1.gz", 1), ("journal", "1", "0", "journal.log", 0), ("journal", "2", None, "journal.log", 0),
    ]
    assert parsed.files.filter("name like 'diaglog_1%'").first().dump_time.hour == 7


def test_entries_and_cycles(parsed):
    r = parsed.mechanisms["module1"]
    assert r.status == "success" and sorted((x.source, x["count"]) for x in r.entries.groupBy("source").count().collect()) == [("diagnostic", 4), ("journal", 4)]
    assert sorted((x.slot, x.dir_name) for x in r.cycles.filter("scope = 'board'").collect()) == [("1", "20270509000100-20270509000200"), ("2", "20270509063000-20270509063100")]
    got = sorted((x.process_name, x.pid, x.total_count, tuple(x.missing_sequences)) for x in r.processes.collect())
    assert got == [("valved", "4711", 5, (3, 4, 5, 6, 7, 8)), ("valved", "8150", 3, (3,))]


def test_second_family(parsed):
    r = parsed.mechanisms["module2"]
    got = sorted((x.status, x.reason, x.ts_us - S) for x in r.decisions.collect())
    assert got == [("assigned", "matched_by_time", 100_000_000), ("unknown", "no_board_cycle_contains_timestamp", 2_400_000_000)]
    assert [x.dir_name for x in r.cycles.collect()] == ["20270509T000100-20270509T004000"]  # the row behind widens the cycle


def test_coverage_and_roles(parsed):
    c = parsed.coverage.first()
    assert (c.diagnostic_scopes, c.private_scopes, c.journal_files, c.timestamps) == (3, 3, 4, 13)
    assert {r.slot: r.role for r in parsed.slots.collect()} == {"1": "unknown", "2": "unknown", "loose": "unknown"}


def test_evidence_files(task):
    path = f"{task}/mech_modules/EXAMPLE/slot_1/20270509000100-20270509000200/valved-4711.log"
    lines = open(path, encoding="utf-8").read().splitlines()
    assert len(lines) == 5 and lines[0].startswith("[0001] [journal|slot_1/journal.log] 2027-05-09T00:01:00")
    assert lines[1].startswith("[0001] [diagnostic|slot_1/diaglog_1_20270509070000.log.zip] 2027-05-09 00:01:00.100000 Service=VALVES")


def test_documents(task):
    result = json.load(open(f"{task}/result.json"))
    slot = result["mech_results"][0]["slots"][0]
    assert slot["slot_id"] == "1" and slot["board_cycles"][0]["processes"][0]["pid"] == "4711"
    assert json.load(open(f"{task}/metadata.json"))["coverage"]["timestamps"] == 13


def test_checks_find_what_is_wrong(spark, task):
    assert [r.code for r in checks.artifact_check(spark, task).collect()] == ["LP_DFX_OK"]
    path = f"{task}/mech_modules/EXAMPLE/slot_1/20270509000100-20270509000200/valved-4711.log"
    content = open(path).read()
    try:
        open(path, "a").write("more\n")
        open(f"{task}/mech_modules/stray.log", "w").write("x\n")
        codes = {r.code for r in checks.artifact_check(spark, task).collect()}
        assert codes == {"LP_ARTIFACT_INTEGRITY_FAILED", "LP_EVIDENCE_ORPHAN"}
        out = checks.report(spark, task)
        assert out["summary"].startswith("LP_ARTIFACT_INTEGRITY_FAILED: mech_modules")
    finally:
        import os

        open(path, "w").write(content)
        for name in ("mech_modules/stray.log", "dfx_report.json", "dfx_summary.txt"):
            os.remove(f"{task}/{name}")


def test_rerun_gives_the_same(spark, parsed, task, tmp_path):
    evidence.write_task(spark, parsed, packages.NAMES, str(tmp_path / "again"), "t1")
    assert evidence.compare_outputs(spark, task, str(tmp_path / "again")).count() == 0
    with pytest.raises(ValueError):
        evidence.reset_task(tmp_path / "again", "other")


def anchors(spark, rows):
    return spark.createDataFrame(rows, "anchor_id int, at_us long, module string, slot string, process_name string, pid string")


def test_target_logs(spark, parsed, task):
    index = evidence.process_index(parsed.mechanisms["module1"]).withColumn("module_key", F.lit("module1")).withColumn("module_name", F.lit("EXAMPLE"))
    rows = [
        (0, S + 90_000_000, "example", "slot_1", "VALVED", "4711"), (1, S + 900_000_000, "module1", "1", "valved", None), (2, S, "module1", "1", "valved", "9"),
        (3, S, "nothing", "1", "valved", None), (4, S, "EXAMPLE", "7", "valved", None), (5, None, "EXAMPLE", "1", "valved", None),
    ]
    logs = evidence.file_hashes(spark, task).select("path")
    got = {r.anchor_id: r for r in target.resolve(anchors(spark, rows), index, logs).collect()}
    path = "mech_modules/EXAMPLE/slot_1/20270509000100-20270509000200/valved-4711.log"
    assert (got[0].match_status, got[0].log_path) == ("exact", path) and (got[1].match_status, got[1].caveats) == ("nearest", ["nearest-cycle fallback"])
    assert [got[i].error_code for i in (2, 3, 4, 5)] == ["LP_TARGET_MISSING", "LP_MODULE_MISSING", "LP_SLOT_MISSING", "LP_TARGET_TIME_INVALID"]
    answer = target.payload(got[0], {"label": "x"}, explain=True)
    assert answer["target_logs"][0]["log_path"] == path and answer["selection_diagnostics"]["module_key"] == "module1"


@pytest.mark.parametrize("spans,status,choice", [
    ([(0, 10)], "exact", 0), ([(0, 10), (5, 15)], "ambiguous", None), ([(20, 30), (40, 50)], "nearest", 0), ([(0, 3), (7, 9)], "ambiguous", None),
    ([(None, None)], "unknown", 0), ([(None, None), (None, None)], "ambiguous", None), ([(None, None), (20, 30)], "nearest", 1), ([(None, 10)], "exact", 0),
])
def test_selection_policy(spark, spans, status, choice):
    rows = spark.createDataFrame([(0, k, s, e, 5, "") for k, (s, e) in enumerate(spans)], "a int, cycle_id int, start_us long, end_us long, at_us long, log_path string")
    r = target.selected(rows, ["a"]).first()
    assert r.match_status == status and (r.choice.cycle_id if r.choice else None) == choice


def test_cpu_folder_fallback(spark):
    logs = spark.createDataFrame([("m/b/cpu_1/x.log",), ("m/b/cpu_1/y.log",), ("m/b/cpu_2/y.log",)], "path string")
    rows = spark.createDataFrame([(i, "exact", None, "m", "c", p, "", []) for i, p in enumerate(["m/b/x.log", "m/b/y.log", "m/b/z.log"])], "anchor_id int, match_status string, error_code string, module_key string, cycle_id string, log_path string, reason string, caveats array<string>")
    got = {r.anchor_id: (r.match_status, r.error_code, r.log_path) for r in target.with_logs(rows, logs).collect()}
    assert got == {0: ("exact", None, "m/b/cpu_1/x.log"), 1: ("ambiguous", "LP_TARGET_AMBIGUOUS", None), 2: ("missing", "LP_TARGET_LOG_MISSING", None)}


def test_compact_product(spark, tmp_path):
    path = tmp_path / "compact.zip"
    path.write_bytes(packages.compact_package())
    r = parse(spark, str(path), packages.COMPACT_PRODUCT)
    assert [x.path for x in r.files.filter("family = 'journal'").collect()] == ["logs/slot_1/deep/syslog.log"]
    assert r.mechanisms["ctrl"].entries.count() == 3 and r.periods.count() == 2 and {x.role for x in r.slots.collect()} == {"active"}


def test_folders_tars_and_broken_files(spark, tmp_path):
    (tmp_path / "p/diag/slot_1").mkdir(parents=True)
    (tmp_path / "p/diag/slot_1/a.log").write_bytes(b"one\r\ntwo\xff\n")
    (tmp_path / "p/b.log.gz").write_bytes(gzip.compress(b"x\xff\n" * 50_000)[:-9])
    (tmp_path / "p/bad.zip").write_bytes(b"no archive")
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as t:
        for name in ("in.log", "../out.log"):
            info = tarfile.TarInfo(name)
            info.size = 4
            t.addfile(info, io.BytesIO(b"tar\n"))
        link = tarfile.TarInfo("link")
        link.type, link.linkname = tarfile.SYMTYPE, "in.log"
        t.addfile(link)
    (tmp_path / "p/t.tgz").write_bytes(out.getvalue())
    (tmp_path / "p/bad.zip").unlink()
    rows = read_package(spark, str(tmp_path / "p")).collect()
    assert [(r.path, r.line) for r in rows if (r.error or "").startswith("LP_ARCHIVE_MEMBER_REFUSED: '../out.log'")] == [("t.tgz_extracted/t.tgz", "")]
    lines = {(r.path, r.line) for r in rows if not r.error and r.path != "b.log.gz"}
    assert lines == {("diag/slot_1/a.log", "one"), ("diag/slot_1/a.log", "two"), ("t.tgz_extracted/in.log", "tar")}
    broken = [r for r in rows if r.path == "b.log.gz"]
    assert broken[-1].error.startswith("LP_READ_FAILED") and any(r.line == "x�" for r in broken)
    (tmp_path / "p/link").symlink_to(tmp_path / "p/b.log.gz")
    with pytest.raises(Exception, match="links"):
        read_package(spark, str(tmp_path / "p")).collect()
    assert overlap(str(tmp_path), str(tmp_path / "p")) and not overlap(str(tmp_path / "p"), str(tmp_path / "q"))


def test_refused_members_are_told(spark, tmp_path):
    """A member with an unsafe name or beyond the ratio gives an error row, in the outer archive and in a nested one."""
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("ok.log", "fine\n")
        z.writestr("zeros.log", "0" * 2_000_000)
    with zipfile.ZipFile(tmp_path / "p.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("../up.log", "x\n")
        z.writestr("zeros.log", "0" * 2_000_000)
        z.writestr("in.zip", inner.getvalue())
        z.writestr("many.log", "".join(f"line {i * i % 7919} {i}\n" for i in range(20_000)))
    rows = read_package(spark, str(tmp_path / "p.zip")).collect()
    assert sorted((r.path, r.error.split(" ")[1]) for r in rows if r.error) == [("in.zip_extracted/in.zip", "'zeros.log'"), ("p.zip", "'../up.log'"), ("p.zip", "'zeros.log'")]
    assert [(r.path, r.line) for r in rows if r.path.endswith("ok.log")] == [("in.zip_extracted/ok.log", "fine")]
    assert sorted(r.line_no for r in rows if r.path == "many.log") == list(range(20_000))


def test_stored_packages_and_tables(spark, parsed, tmp_path):
    from slotwise.sources.archive import read_stored, read_text

    (tmp_path / "in").mkdir()
    (tmp_path / "in/p.zip").write_bytes(packages.default_package())
    (tmp_path / "in/bad.zip").write_bytes(b"none")
    (tmp_path / "in/plain.log").write_bytes(b"a\nb\n")
    rows = read_stored(spark, str(tmp_path / "in")).collect()
    assert ("plain.log", 1, "b", None) in {tuple(r) for r in rows} and sorted((r.path, r.error.split(":")[0]) for r in rows if r.error) == [("bad.zip", "LP_ARCHIVE_READ_FAILED"), ("p.zip_extracted/p.zip", "LP_ARCHIVE_MEMBER_REFUSED")]
    inside = {(r.path, r.line) for r in rows if r.path.startswith("p.zip_extracted/") and not r.error}
    assert inside == {("p.zip_extracted/" + r.path, r.line) for r in parsed.lines.select("path", "line").collect()} | {i for i in inside if "notes" in i[0] or "diaglog_9" in i[0]}
    assert sorted(r.line for r in read_text(spark, str(tmp_path / "in/plain.log")).collect()) == ["a", "b"]
    rows = evidence.evidence(parsed.mechanisms["module1"], "EXAMPLE")
    evidence.write_evidence_table(rows, str(tmp_path / "out"))
    back = spark.read.text(str(tmp_path / "out"))
    assert back.count() == rows.count() and back.select("path").distinct().count() == rows.select("path").distinct().count()


def test_nothing_found(spark):
    from slotwise.sources.discovery import DEFAULT

    empty = spark.createDataFrame([], "path string, line_no long, line string, error string")
    assert discovered(empty, DEFAULT).count() == 0


def test_questions_about_a_task(spark, task):
    from slotwise.plans.api import Task, doctor

    t = Task(spark, task)
    assert [s["slot"] for s in t.slots()] == ["1", "2", "loose"] and t.slot("slot_2")["slot"] == "2" and t.slot("9") is None
    assert [m["module_name"] for m in t.modules()] == ["EXAMPLE", "MODULE2"] and t.module_slots("EXAMPLE") == ["1", "2"]
    assert {c["module_key"] for c in t.lifecycles("1")} == {"module1", "module2"}
    assert t.log_path("EXAMPLE", "1", "20270509000100-20270509000200", "valved", "4711").exists()
    anchor = {"module": "EXAMPLE", "slot": "1", "process_name": "valved", "pid": "4711", "problem_time": "2027-05-09T00:01:30"}
    answer = t.target_logs([anchor, anchor | {"slot": "5"}], explain=True)
    assert answer[0]["target_logs"][0]["match_status"] == "exact" and answer[1]["selection_diagnostics"]["error_code"] == "LP_SLOT_MISSING"
    assert all(r["ok"] for r in doctor(task) if r["check"] != "yaml")


def test_lifecycle_text(parsed):
    from slotwise.plans.api import lifecycle_text

    lives = parsed.mechanisms["module1"].lifecycles
    assert lifecycle_text(lives, "off") == "" and lifecycle_text(lives, "errors") == ""
    assert "board:1:board:root:lifecycle:0" in lifecycle_text(lives, "full")


class Counter:
    """A mechanism from outside."""

    def validate(self, mechanism):
        if mechanism.module.module_name == "BAD":
            raise ValueError("bad name")

    def run(self, lines, mechanism, results):
        from slotwise.plans.parse import MechanismResult

        return MechanismResult(mechanism.key, "success" if "module1" in results else "empty", str(lines.count()))


def test_plugins_and_skipping(spark, tmp_path):
    import dataclasses

    from slotwise.plans.plugins import Discovery, load
    from slotwise.sources.config import Mechanism

    path = tmp_path / "package.zip"
    path.write_bytes(packages.default_package())
    bad = dataclasses.replace(packages.FIRST, module_name="BAD")
    own = (Mechanism("module1", "lifecycle", packages.FIRST), Mechanism("count", "tests.test_package:Counter", packages.FIRST, ("module1",)), Mechanism("bad", "tests.test_package:Counter", bad), Mechanism("after", "correlation", packages.SECOND, ("bad",)))
    got = parse(spark, str(path), dataclasses.replace(packages.PRODUCT, mechanisms=own)).mechanisms
    assert {k: r.status for k, r in got.items()} == {"module1": "success", "count": "success", "bad": "failed", "after": "skipped"}
    with pytest.raises(TypeError):
        load("tests.test_package:Counter", Discovery)
    with pytest.raises(ValueError):
        load("tests.test_package", Discovery)


def test_command_line(spark, task, tmp_path, capsys):
    from slotwise import cli

    assert cli.run(["doctor"]) in (0, 1)
    assert cli.run(["target-logs", task, "--module", "EXAMPLE", "--slot", "1", "--process", "valved", "--problem-time", "2027-05-09T00:01:30"]) == 0
    assert '"match_status": "exact"' in capsys.readouterr().out
    assert cli.run(["modules", task]) == 0 and cli.run(["artifact-check", task]) == 0
