"""Boundary cases of lifecycles, and a random comparison with a plain fold."""

import random

import pytest

from slotwise.operators import lifecycle

SCHEMA = "ts_us long, sequence int, source_file string, raw string, file_ord int, line_no long, slot string, cpu_id string, process_name string, pid string, source string"


def table(spark, rows):
    out = []
    for k, (process, pid, second, *more) in enumerate(rows):
        cpu, sequence, source = (more + ["", 0, "diagnostic"][len(more) :])[:3]
        out.append((int(second * 1_000_000), sequence, "f", f"{process}-{pid}", 0, k, "1", cpu, process, pid, source))
    return spark.createDataFrame(out, SCHEMA)


def split(spark, rows, reliable=("anchor",), multi=()):
    return lifecycle.split(table(spark, rows), reliable, multi)


def shape(lives):
    boards = lives.lifecycles.filter("scope = 'board'").count()
    cpus = lives.lifecycles.filter("scope = 'cpu'").count()
    kept = sorted((r.decision, r.reason, r.gap_seconds) for r in lives.decisions.filter("scope = 'board'").collect())
    return lives.candidates.filter("scope = 'board'").count(), boards, cpus, kept


@pytest.mark.parametrize("rows,reliable,expected", [
    ([("anchor", "100", 0), ("worker", "500", 29)], ("anchor",), (1, 1, 0, [])),
    ([("anchor", "100", 0), ("worker", "500", 29), ("worker", "500", 58), ("other", "900", 88)], ("anchor",), (2, 1, 0, [("merged", None, 30.0)])),
    ([("anchor", "100", 0), ("anchor", "200", 30)], ("anchor",), (2, 2, 0, [("kept_split", "reliable_pid_conflict", 30.0)])),
    ([("anchor", "100", 0, "1"), ("anchor", "200", 30, "1")], ("anchor",), (2, 1, 2, [("merged", None, 30.0)])),
    ([("anchor", "100", 0, "", 99), ("anchor", "100", 30, "", 1)], ("anchor",), (2, 2, 0, [("kept_split", "journal_wrap", 30.0)])),
    ([("ordinary", "1", 0, "", 99), ("ordinary", "1", 30, "", 1)], (), (2, 1, 0, [("merged", None, 30.0)])),
])
def test_boundaries(spark, rows, reliable, expected):
    assert shape(split(spark, rows, reliable)) == expected


def test_conflict_inside_is_an_error(spark):
    lives = split(spark, [("anchor", "100", 0), ("anchor", "200", 29)])
    issue = lives.issues.first()
    assert (issue.severity, issue.observed_pids) == ("error", ["100", "200"]) and not lives.lifecycles.first().lifecycle_reliable


def test_pid_reuse_is_a_warning(spark):
    rows = [("anchor", "1", 0, "", 99), ("ordinary", "500", 10), ("anchor", "1", 40, "", 1), ("ordinary", "500", 50)]
    assert {(r.severity, r.related_process) for r in split(spark, rows).issues.collect()} == {("warning", "anchor"), ("warning", "ordinary")}
    assert {r.related_process for r in split(spark, rows, ("anchor",), ("ordinary",)).issues.collect()} == {"anchor"}


def test_pidless_journals(spark):
    def processes(rows):
        return sorted((r.process_name, r.pid, r.total_count) for r in lifecycle.cycle_processes(split(spark, rows, ())).collect())

    assert processes([("svc", "100", 0), ("svc", "", 5, "", 0, "journal")]) == [("svc", "100", 2)]
    assert processes([("svc", "100", 0), ("svc", "", 5)]) == [("svc", "", 1), ("svc", "100", 1)]
    assert processes([("svc", "100", 0), ("svc", "", 5, "", 0, "journal"), ("svc", "200", 10)]) == [("svc", "", 1), ("svc", "100", 1), ("svc", "200", 1)]


def test_missing_sequences(spark):
    lives = split(spark, [("svc", "1", i, "", s) for i, s in enumerate([3, 7, 5, 0, 5])], ())
    assert lifecycle.cycle_processes(lives).first().missing_sequences == [4, 6]


def test_both_reliable_and_multi(spark):
    with pytest.raises(ValueError):
        split(spark, [("a", "1", 0)], ("A",), ("a",))


def test_empty(spark):
    lives = split(spark, [])
    assert lives.lifecycles.count() == 0 and lives.issues.count() == 0


def fold(rows, reliable):
    """Segments merged from left to right over their rows."""
    rows = sorted(rows, key=lambda r: (r[2], r[4]))
    parts = [[rows[0]]]
    for r in rows[1:]:
        if r[2] - parts[-1][-1][2] >= 30:
            parts.append([])
        parts[-1].append(r)
    lives = [parts[0]]
    for part in parts[1:]:
        both, kept = lives[-1] + part, False
        for p in reliable:
            old, new = [r[4] for r in lives[-1] if r[0] == p and r[4]], [r[4] for r in part if r[0] == p and r[4]]
            kept |= bool(old and new and new[0] < old[-1]) or len({r[1] for r in both if r[0] == p and r[1]}) > 1
        if kept:
            lives.append(part)
        else:
            lives[-1] = both
    return [(x[0][2], x[-1][2], len(x)) for x in lives]


def test_random_against_fold(spark):
    rng = random.Random(5)
    rows, want = [], []
    for slot in range(40):
        own = [(rng.choice("abc"), rng.choice(["", "1", "2"]), rng.randrange(0, 1200), "", rng.randrange(0, 6)) for _ in range(rng.randrange(1, 40))]
        own = list({(r[2]): r for r in own}.values())
        want += [(str(slot), *x) for x in fold(own, "ab")]
        rows += [(r[2] * 1_000_000, r[4], "f", f"{r[0]}-{r[1]}", 0, k, str(slot), "", r[0], r[1], "diagnostic") for k, r in enumerate(own)]
    lives = lifecycle.split(spark.createDataFrame(rows, SCHEMA), ("a", "b"))
    got = [(r.slot, r.start_us // 1_000_000, r.end_us // 1_000_000, r.log_count) for r in lives.lifecycles.collect()]
    assert sorted(got) == sorted(want)


def test_active_periods_part_only_beyond_the_gap(spark):
    rows = spark.createDataFrame([("1", s * 1_000_000) for s in (0, 300, 601)], "slot string, ts_us long")
    got = lifecycle.active_periods(rows, ["slot"], "ts_us", 300).orderBy("period").collect()
    assert [(r.start_us, r.end_us) for r in got] == [(0, 300_000_000), (601_000_000, 601_000_000)]


@pytest.mark.parametrize("slots,expected", [
    ([("1", True, 1, True), ("2", True, 3, False), ("3", False, 0, False)], ["active", "standby", "unknown"]),
    ([("1", True, 1, False), ("2", True, 0, False)], ["active", "standby"]),
    ([("1", True, 1, False), ("2", True, 2, False)], ["unknown", "unknown"]),
    ([("1", True, 0, False), ("2", False, 0, False)], ["standby", "unknown"]),
])
def test_roles(spark, slots, expected):
    df = spark.createDataFrame(slots, "slot string, has_logs boolean, n_periods long, is_active boolean")
    assert [r.role for r in lifecycle.roles(df).orderBy("slot").collect()] == expected
