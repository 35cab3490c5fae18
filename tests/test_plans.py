"""Configuration, documents, onboarding, windows and streams."""

import json

import pytest
from pyspark.sql import functions as F

from slotwise.operators import aggregates
from slotwise.plans import checks, onboarding
from slotwise.plans.evidence import normalised_json, performance_document
from slotwise.sources import artifacts, config
from slotwise.streaming import sessions

NODE = {
    "discovery": {"diagnostic_dir": "diag", "diagnostic_globs": ["*.zip"], "private_dir": "varlog", "journal_globs": ["journal.log"]},
    "parser": {"active_period_gap_seconds": 60},
    "mechanisms": {
        "b": {"kind": "correlation", "depends_on": ["a"], "config": {"module_name": "B", "diag_pattern": "(?P<Slot>.)(?P<CPU_Id>.)(?P<ProcessName>.)(?P<Context>.)"}},
        "a": {"kind": "lifecycle", "config": {"module_name": "A", "diag_pattern": "(?P<Slot>.)(?P<CPU_Id>.)(?P<ProcessName>.)(?P<Context>.)", "lifecycle_split": {"reliable_processes": "x", "process_name_mapping": {"X": "y"}}}},
    },
}


def test_config(tmp_path):
    (tmp_path / "products").mkdir()
    (tmp_path / "products/one.json").write_text(json.dumps(NODE))
    (tmp_path / "config.json").write_text(json.dumps({"one": {"$include": "products/one.json"}}))
    p = config.product("one", config.load(tmp_path / "config.json")["one"])
    assert config.explain(p)["execution_order"] == ["a", "b"] and p.mechanisms[1].module.process_name_mapping == {"X": ["y"]}
    for bad in ({"$include": "../x.json"}, {"$include": "/x.json"}, {"$include": "products/one.json", "more": 1}):
        (tmp_path / "config.json").write_text(json.dumps({"one": bad}))
        with pytest.raises(config.ConfigError):
            config.load(tmp_path / "config.json")


@pytest.mark.parametrize("change", [
    lambda n: n.update(more=1), lambda n: n["mechanisms"]["a"].update(kind="x"), lambda n: n["mechanisms"]["a"].update(depends_on=["b"]), lambda n: n["mechanisms"]["b"].update(depends_on=["c"]),
    lambda n: n["mechanisms"]["a"]["config"].update(diag_pattern="("), lambda n: n["mechanisms"]["a"]["config"].update(diag_pattern="(?P<Slot>.)"), lambda n: n["mechanisms"]["a"]["config"].update(journal={"line_pattern": "(a)"}),
    lambda n: n["mechanisms"]["a"]["config"]["lifecycle_split"].update(multi_instance_processes=["X"]), lambda n: n["parser"].update(timestamp_regex="x"), lambda n: n.pop("parser"),
])
def test_bad_config(change):
    node = json.loads(json.dumps(NODE))
    change(node)
    with pytest.raises(config.ConfigError):
        config.product("one", node)


@pytest.mark.parametrize("content,kind", [(None, "missing"), ("{", "invalid_json"), ("[]", "invalid_root"), ("{}", "missing_schema"), ('{"schema_version": true}', "unsupported_schema"), ('{"schema_version": 9}', "unsupported_schema")])
def test_artifact_errors(tmp_path, content, kind):
    if content is not None:
        (tmp_path / "x.json").write_text(content)
    with pytest.raises(artifacts.ArtifactError) as e:
        artifacts.read_artifact(tmp_path / "x.json", (1, 2))
    assert e.value.kind == kind


def test_shapes_and_candidates():
    artifacts.checked_shape({"a": 1, "b": [{"c": "x"}]}, {"a": int, "b": [{"c": str}]})
    for bad in ({"a": True, "b": []}, {"b": []}, {"a": 1, "b": [1]}):
        with pytest.raises(artifacts.ArtifactError):
            artifacts.checked_shape(bad, {"a": int, "b": [{"c": str}]})
    assert artifacts.read_candidate(b'{"a": [1]}') == {"a": [1]}
    for bad in (b'{"a": 1, "a": 2}', b'{"a": NaN}', b"[" * 30 + b"]" * 30, b"[1]", b"x" * 70_000, b"\xff"):
        with pytest.raises(artifacts.ArtifactError):
            artifacts.read_candidate(bad)


def test_samples(tmp_path):
    (tmp_path / "a.log").write_bytes(b"x" * 5000 + b"\n" + b"y\xff\n" * 600)
    s = artifacts.read_samples([str(tmp_path / "a.log")])[0]
    assert len(s.lines) == 512 and len(s.lines[0]) == 4096 and s.replaced == 511 and s.cut
    with pytest.raises((LookupError, ValueError)):
        artifacts.text_codec("hex")


CANDIDATE = {"file_patterns": ["a.log"], "timestamp_regex": r"(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2})([+-]\d{2}:\d{2})?", "module_name": "mod", "diag_pattern": r"Slot=(?P<Slot>\d+) cpu=(?P<CPU_Id>\d+) proc=(?P<ProcessName>\S+) ctx=(?P<Context>\w+)", "sequence_pattern": r"No\[(\d+)\]"}


def test_onboarding(spark):
    rows = [(0, "a.log", n, f"2027-05-09T00:00:0{n} MOD Slot=1 cpu=0 proc=p-{n} ctx=c No[{n}]") for n in range(4)] + [(0, "a.log", 4, " "), (1, "b_01.log", 0, "Jan  3 00:00:00 msg: x"), (2, "b_02.log", 0, "Jan  3 00:00:00 msg: x")]
    lines = spark.createDataFrame(rows, "file_ord int, name string, line_no long, line string")
    out = onboarding.validate(lines, CANDIDATE)
    assert out["status"] == "ready" and out["counters"]["record_matches"] == 4 and out["counters"]["ordinal_integers"] == 4
    assert onboarding.validate(lines, CANDIDATE | {"module_name": "none"})["status"] == "incomplete"
    assert onboarding.validate(lines, CANDIDATE | {"diag_pattern": "(a+)+(b)(c)(d)"})["status"] == "invalid"
    found = onboarding.analyze(lines)
    assert {r.key: (r.eligible, r.matched, r.parseable) for r in found["timestamps"].collect()} == {"iso8601": (6, 4, 4), "syslog_without_year": (6, 2, 0)}
    assert {r.field: r.alias for r in found["best_fields"].collect()} == {"Slot": "Slot", "CPU_Id": "cpu", "ProcessName": "proc", "Context": "ctx"}
    assert [tuple(r.files) for r in found["families"].orderBy("file_ord").collect()] == [("a.log",), ("b_01.log", "b_02.log")]
    assert [(r["shape"], r.n) for r in found["shapes"].collect()] == [("b_*.log", 2)]
    assert onboarding.build_draft(CANDIDATE)["final_config_ready"] is False


@pytest.mark.parametrize("pattern,reason", [
    (r"(a)\1", "backreference"), (r"(?=a)b", "assertion"), (r"a*", "zero_width"), (r"x(a+)+", "risky_repetition"), (r"x.*y.*", "ambiguous_repeat_layout"), (r"xa+b+", "ambiguous_repeat_layout"), (r"\d+x", "ambiguous_repeat_layout"), ("a" * 5000, "too_long"), ("(" * 80 + "a" + ")" * 80, "too_deep"),
])
def test_unsafe_patterns(pattern, reason):
    assert onboarding.pattern_errors(pattern, "p") == [f"p.unsafe_{reason}"]


def test_safe_pattern_and_sandbox():
    assert onboarding.pattern_errors(CANDIDATE["diag_pattern"], "p", 4) == []
    assert onboarding.pattern_errors(r"x(a)", "p", 2) == ["p.missing_capture_groups"] and onboarding.pattern_errors("", "p") == ["p.empty"]
    assert onboarding.sandboxed(r"k=(?P<k>\w+)", ["k=1", "x"]) == {"status": "ok", "matches": 1, "groups": {"k": 1}}
    assert onboarding.sandboxed(r"x(a+)+", [])["status"] == "refused"
    assert onboarding.sandboxed(r"k=(?P<k>\w+)", ["k=1"], 0.0001)["status"] == "timeout"


def test_explain_line(spark):
    from tests.packages import FIRST

    r = onboarding.explain_line(spark, "2027-05-09T00:01:00 [host7] valved: No[7] EXAMPLE x", FIRST).first()
    assert (r.has_module_name, r.diag_pattern_fits, r.sequence, r.journal_pattern, r.timestamp) == (True, False, 7, "journal.line_pattern2", "2027-05-09T00:01:00")


def test_windows(spark):
    lines = spark.createDataFrame([("p", n, f"2027-05-09T00:{n // 60:02d}:{n % 60:02d} é" if n % 2 else "plain") for n in range(200)] + [("q", n, "no time") for n in range(100)], "path string, line_no long, line string")
    at = 1_809_820_800_000_000
    w = checks.deep_windows(lines, [("p", at + 100_000_000), ("q", at)])
    rows = w.orderBy("path", "line_no").collect()
    p = [r.line_no for r in rows if r.path == "p"]
    assert (p[0], p[-1]) == (75, 122) and [r.line_no for r in rows if r.is_target] == [99]
    assert [r.line_no for r in rows if r.path == "q"] == [*range(24), *range(76, 100)]
    assert [(r.first_line, r.last_line) for r in aggregates.line_ranges(w, ["path"]).orderBy("path", "first_line").collect()] == [(75, 122), (0, 23), (76, 99)]
    cut = aggregates.within_bytes(spark.createDataFrame([("p", 0, "ab"), ("p", 1, "éé")], "path string, line_no long, line string"), ["path"], 6).orderBy("line_no").collect()
    assert [r.line for r in cut] == ["ab", "é"]


def test_stage_tree_and_performance(spark):
    stages = spark.createDataFrame([("a.b", 1.0, 2, "success"), ("a.b", 2.0, 3, "failed"), ("a", 4.0, 1, "success")], "name string, seconds double, items long, status string")
    assert {r.path: (r.seconds, r.calls, r["items"]) for r in aggregates.stage_tree(stages).collect()} == {"a": (7.0, 1, 1), "a.b": (3.0, 2, 5)}
    slow, odd = aggregates.performance_summary(stages, 2)
    assert [r.seconds for r in slow.collect()] == [4.0, 2.0] and odd.count() == 1
    out = performance_document([("scan", 1.0, {"lines": 2, "secret": 1}), ("mine", 0.5, {})], ("scan",), ("lines",))
    assert out["stages"] == [{"name": "scan", "seconds": 1.0, "metrics": {"lines": 2}}, {"name": "custom", "seconds": 0.5, "metrics": {}}]
    assert normalised_json('{"b": "/r/x", "created_at": 1, "a": 1}', "/r") == '{"a": 1, "b": "<root>/x"}'


def test_primary_issue(spark):
    rows = spark.createDataFrame([("LP_DFX_OK", "info", "fine"), ("LP_SLOT_MISSING", "error", "a\n b " + "x" * 200), ("X", "error", "y")], checks.ISSUE)
    s = checks.primary(rows).first().summary
    assert s.startswith("LP_SLOT_MISSING: a b xx") and len(s) == 120 and s.endswith("…")


def test_streams(spark, tmp_path):
    rows = [("1", s) for s in (0, 10, 39, 70, 500)] + [("2", 5), ("2", 5000)]
    df = spark.createDataFrame(rows, "slot string, s long").select("slot", F.timestamp_seconds(F.col("s") + 1_700_000_000).alias("ts"))
    for i, part in enumerate((df.filter("unix_seconds(ts) < 1700000100"), df.filter("unix_seconds(ts) >= 1700000100"))):
        part.coalesce(1).write.parquet(str(tmp_path / "in"), mode="append")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for name, out in (("segments", sessions.streaming_segments(stream, "ts", "10 minutes")), ("periods", sessions.streaming_periods(stream, "slot", "ts", 30, "10 minutes"))):
        q = out.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
    got = sorted((r.slot, r.start_us // 1_000_000 - 1_700_000_000, r.end_us // 1_000_000 - 1_700_000_000, r.log_count) for r in spark.table("segments").collect())
    assert ("1", 0, 39, 3) in got and ("1", 70, 70, 1) in got
    assert any(r.n >= 1 for r in spark.table("periods").collect())


def test_stream_numbers_go_on_after_a_timeout(spark, tmp_path):
    """A slot falls silent, its segment is closed by the watermark alone, and then the slot comes back."""
    schema = "slot string, ts timestamp"
    batches = [[("1", 0), ("1", 10)], [("2", 9000)], [("2", 9010)], [("1", 9020), ("1", 9100), (None, 9100), ("1", None)], [("2", 20000)], [("2", 20010)]]
    made = str(tmp_path / "in")
    stream = spark.readStream.schema(schema).parquet(made + "/*")
    out = sessions.streaming_segments(stream, "ts", "10 seconds")
    for i, rows in enumerate(batches):
        df = spark.createDataFrame(rows, "slot string, s long").select("slot", F.timestamp_seconds(F.col("s") + 1_700_000_000).alias("ts"))
        df.coalesce(1).write.parquet(f"{made}/{i}")
        q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(120)
    got = sorted((r.segment, r.start_us // 1_000_000 - 1_700_000_000, r.log_count) for r in spark.read.parquet(str(tmp_path / "out")).filter("slot = '1'").collect())
    assert got == [(0, 0, 2), (1, 9020, 1), (2, 9100, 1)]
