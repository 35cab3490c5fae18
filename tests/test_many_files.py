"""Folders of very many files and indexes of very many processes, in small: nothing goes file by file or is held whole."""

import hashlib
import json
import pickle
import shutil
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from slotwise.plans import checks, evidence, results, target
from slotwise.plans.api import Task
from slotwise.plans.parse import parse
from slotwise.sources.archive import PackageReader, folder_files, names_unpacked, read_package
from tests import packages

FILES = 2500


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("many")
    for i in range(FILES):
        path = root / "top" / f"d{i % 7}" / f"f{i}.log"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(f"line {i}\n")
    (root / "top" / "d1.x").write_text("")  # by path parts d1 goes before d1.x
    (root / "alone.json").write_text("{}")
    return root


@pytest.fixture(scope="module")
def task(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("in") / "package.zip"
    path.write_bytes(packages.default_package())
    root = str(tmp_path_factory.mktemp("task"))
    evidence.write_task(spark, parse(spark, str(path), packages.PRODUCT), packages.NAMES, root, "t1")
    return root


def test_small_files_share_a_partition(spark, folder):
    parts = PackageReader(str(folder)).partitions()
    assert len(parts) == 2
    assert [f"{folder}/{n}" for p in parts for n in names_unpacked(p.names)] == folder_files(str(folder))
    rows = read_package(spark, str(folder)).filter("path like 'top/%'").collect()
    assert sorted((r.path, r.line_no, r.line) for r in rows) == sorted((f"top/d{i % 7}/f{i}.log", 0, f"line {i}") for i in range(FILES))


def test_hashes_are_taken_of_many_files_a_task(spark, folder):
    hashed = evidence.file_hashes(spark, str(folder))
    assert hashed.rdd.getNumPartitions() <= 2
    expected = {n: hashlib.sha256((folder / n).read_bytes()).hexdigest() for n in (f.removeprefix(f"{folder}/") for f in folder_files(str(folder)))}
    assert {r.path: r.sha256 for r in hashed.collect()} == expected
    got = {r.path: r for r in evidence.artifacts(hashed).collect()}
    inner = sorted((n.split("/"), n.removeprefix("top/"), h) for n, h in expected.items() if n.startswith("top/"))
    assert got["top"].sha256 == hashlib.sha256("".join(f"{n}\0{h}\n" for _, n, h in inner).encode()).hexdigest()
    assert (got["top"].file_count, got["alone.json"].kind, got["alone.json"].size) == (FILES + 1, "file", 2)
    assert evidence.file_names(spark, str(folder)).count() == FILES + 2


def test_a_commit_takes_few_bytes_a_file(tmp_path):
    rows = [SimpleNamespace(path=f"mech_modules/EXAMPLE/slot_1/20240101000000-20240130235959/click-{i}.log", text="x") for i in range(FILES)]
    writer = evidence.EvidenceWriter(str(tmp_path), "job")
    message = writer.write(iter(rows + rows[:1]))
    assert len(pickle.dumps(message)) < 20 * FILES
    writer.commit([message, None])
    assert len(folder_files(str(tmp_path))) == FILES and (tmp_path / rows[0].path).read_text() == "x\nx\n"
    writer.abort([writer.write(iter(rows))])
    assert len(folder_files(str(tmp_path))) == FILES


def test_questions_do_not_load_the_result(spark, task, monkeypatch):
    whole = json.load(open(f"{task}/result.json"))
    assert whole["schema_version"] == 2 and results.is_lined(f"{task}/result.json")
    old = Task(spark, task).result()["mech_results"]
    monkeypatch.setattr(Task, "result", lambda self: pytest.fail("loaded whole"))
    t = Task(spark, task)
    assert [m["module_key"] for m in t.modules()] == ["module1", "module2"] and t.module_slots("MODULE2") == [s["slot_id"] for s in old[1]["slots"]]
    for slot in ("1", "slot_2"):
        expected = [b | {"module_key": m["module_key"]} for m in old for s in m["slots"] if s["slot_id"] == slot[-1] for b in s["board_cycles"]]
        assert expected and t.lifecycles(slot) == expected
        assert [(b["dir_name"], len(b["cpu_cycles"])) for b in t.lifecycles(slot, processes=False)] == [(b["dir_name"], len(b["cpu_cycles"])) for b in expected]
    paths = {r.path: r.there for r in t.log_paths().collect()}
    assert paths == dict.fromkeys(checks.index_paths(whole), True)


def test_index_of_both_layouts(spark, task, tmp_path, monkeypatch):
    lined = results.index_table(spark, f"{task}/result.json").collect()
    (tmp_path / "result.json").write_text(json.dumps(json.load(open(f"{task}/result.json")), indent=2))
    assert sorted(map(str, lined)) == sorted(map(str, results.index_table(spark, tmp_path / "result.json").collect()))
    monkeypatch.setattr(results, "PART_BYTES", 50)
    reader = results.IndexReader(f"{task}/result.json")
    parts = reader.partitions()
    rows = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
    assert len(parts) > len(lined) and sorted((r["id"], p["process_name"], p["pid"]) for r in rows for p in r["processes"]) == sorted((r.id, p.process_name, p.pid) for r in lined for p in r.processes)


def test_cycles_in_several_rows_give_a_log_once(spark):
    one = ("m", "M", "1", "c0", "board", "", "", "dir")
    index = spark.createDataFrame([(*one, [("a", "1", 1, [])]), (*one, [("b", "2", 1, [])])], "module_key string, module_name string, slot string, id string, scope string, cpu_id string, parent_id string, dir_name string, processes array<struct<process_name:string,pid:string,total_count:bigint,missing_sequences:array<int>>>")
    index = index.withColumn("start_us", F.lit(0)).withColumn("end_us", F.lit(1))
    assert sorted(r.log_path for r in target.candidates(index).collect()) == ["mech_modules/M/slot_1/dir/a-1.log", "mech_modules/M/slot_1/dir/b-2.log"]


def test_checks_and_comparison_of_lined_results(spark, task, tmp_path):
    shutil.copytree(task, tmp_path / "t")
    assert evidence.compare_outputs(spark, task, str(tmp_path / "t")).count() == 0
    text = (tmp_path / "t/result.json").read_text()
    (tmp_path / "t/result.json").write_text(text[: len(text) // 2])
    assert [tuple(r) for r in evidence.compare_outputs(spark, task, str(tmp_path / "t")).collect()] == [("result.json", "content")]
    assert "LP_RESULT_INVALID" in {r.code for r in checks.artifact_check(spark, str(tmp_path / "t")).collect()}


def test_lines_of_nested_cycles():
    """Boards with and without CPU cycles, over slots, and text in several chunks, make one document."""
    key = ("slot", "board_id", "scope", "id", "header", "text")
    p = '{"missing_sequences":[],"pid":"%s"}'
    rows = [("0", "b0", "board", "b0", '{"id":"b0"}', p % 1), ("0", "b0", "board", "b0", '{"id":"b0"}', p % 2), ("0", "b0", "cpu", "c1", '{"id":"c1"}', p % 3), ("0", "b0", "cpu", "c2", '{"id":"c2"}', ""),
            ("0", "b1", "board", "b1", '{"id":"b1"}', ""), ("1", "b0", "board", "b0", '{"id":"b0"}', p % 4)]
    chunks = SimpleNamespace(toLocalIterator=lambda: (SimpleNamespace(**dict(zip(key, r))) for r in rows))
    doc = json.loads('[\n' + "\n".join(results.cycle_lines(chunks)) + "\n]")
    shape = [(s["slot_id"], [(b["id"], [x["pid"] for x in b["processes"]], [(c["id"], [x["pid"] for x in c["processes"]]) for c in b["cpu_cycles"]]) for b in s["board_cycles"]]) for s in doc]
    assert shape == [("0", [("b0", ["1", "2"], [("c1", ["3"]), ("c2", [])]), ("b1", [], [])]), ("1", [("b0", ["4"], [])])]
