from pyspark.sql import functions as F

from slotwise.operators import correlate, intervals

M = 60_000_000
ENTRY = "entry_ord long, slot string, cpu_id string, process_name string, pid string, ts_us long, module_key string, source string, source_file string, sequence int, raw string"


def entries(spark, rows):
    return spark.createDataFrame([(k, r[0], r[1], r[2], r[3], None if r[4] is None else int(r[4] * M), "m", "diagnostic", "f", 0, str(k)) for k, r in enumerate(rows)], ENTRY)


def upstream(spark, boards, cpus=(), pids=()):
    rows = [(f"b{i}", "board", "2", None, "", i, int(s * M), int(e * M)) for i, (s, e) in enumerate(boards)]
    rows += [(f"c{i}", "cpu", "2", cpu, f"b{b}", 100 + i, int(s * M), int(e * M)) for i, (b, cpu, s, e) in enumerate(cpus)]
    cycles = spark.createDataFrame(rows, "id string, scope string, slot string, cpu_id string, parent_id string, cycle_ord int, start_us long, end_us long")
    return correlate.upstream(cycles, spark.createDataFrame(list(pids), "cycle_id string, process_name string, pid string"))


def run(spark, rows, up):
    m = correlate.matches(entries(spark, rows), up)
    final = correlate.reassigned(m, up)
    first = {r.entry_ord: (r.status, r.reason, r.board_id, r.own_id, r.pid_fallback_blocked_by_time_cycle) for r in m.collect()}
    last = {r.entry_ord: (r.board_id, r.own_id) for r in final.collect()}
    cycles = sorted((r.board_id or "", r.own_id or "", r.cpu_id or "", r.start_us and r.start_us / M, r.end_us and r.end_us / M, r.dir_name) for r in correlate.correlated_cycles(final, up).collect())
    return first, last, cycles


def test_containment_and_dispatch(spark):
    up = upstream(spark, [(0, 10)], [(0, "3", 5, 7)], [("c0", "upstream", "1")])
    rows = [("2", "3", "k", "1", 6), ("2", "3", "k", "1", 2), ("2", "", "k", "1", 10), ("9", "", "k", "", 5), ("2", "", "k", "", None), ("2", "", "k", "", 50)]
    first, _, _ = run(spark, rows, up)
    assert [first[i][:4] for i in range(6)] == [
        ("assigned", "matched_by_time", "b0", "c0"), ("assigned", "no_cpu_cycle_contains_timestamp", "b0", None), ("assigned", "matched_by_time", "b0", None),
        ("unknown", "no_upstream_slot", None, None), ("unknown", "missing_timestamp", None, None), ("unknown", "no_board_cycle_contains_timestamp", None, None),
    ]
    assert first[1][4] and not first[0][4]  # the pid is known in another cycle of the CPU


def test_reused_pid_and_widening(spark):
    up = upstream(spark, [(0, 10), (60, 70)], (), [("b0", "svc", "100"), ("b1", "svc", "100")])
    first, last, cycles = run(spark, [("2", "", "svc", "100", 5), ("2", "", "svc", "100", 65), ("2", "", "svc", "100", 20)], up)
    assert last[2] == ("b0", None) and cycles[0][3:5] == (0, 20) and cycles[1][3:5] == (60, 70)
    assert cycles[0][5] == "19700101T000000-19700101T002000"


def test_equal_distance_stays_unknown(spark):
    up = upstream(spark, [(0, 10), (20, 30)], (), [("b0", "svc", "100"), ("b1", "svc", "100")])
    first, _, _ = run(spark, [("2", "", "svc", "100", 15)], up)
    assert first[0][0] == "unknown"


def test_two_pids_then_other(spark):
    up = upstream(spark, [(0, 10), (60, 70)], (), [("b0", "left", "100"), ("b1", "right", "200")])
    first, last, cycles = run(spark, [("2", "", "left", "100", 20), ("2", "", "right", "200", 50), ("2", "", "other", "9", 35)], up)
    assert first[0][1] == "matched_by_pid" and first[1][1] == "matched_by_pid"
    assert last[2] == ("b0", None) and cycles[0][4] == 35 and cycles[1][3] == 50


def test_same_name_beats_pid_only(spark):
    up = upstream(spark, [(0, 10)], (), [("b0", "svc", "100"), ("b0", "other", "100")])
    first, _, _ = run(spark, [("2", "", "svc", "100", 20)], up)
    assert first[0][1] == "matched_by_pid"


def test_process_pull_grows_the_range(spark):
    up = upstream(spark, [(0, 10), (100, 110)])
    rows = [("2", "", "k", "1", 5), ("2", "", "k", "1", 20), ("2", "", "k", "1", 40)]
    _, last, cycles = run(spark, rows, up)
    assert last[1][0] == last[2][0] == "b0" and cycles[0][4] == 40


def test_interval_join_over_wide_and_narrow(spark):
    points = spark.createDataFrame([(k, "a", k * 7_000_000) for k in range(500)], "k long, s string, t long")
    spans = spark.createDataFrame([(0, "a", 0, 3_500_000_000), (1, "a", 10_000_000, 10_000_000), (2, "a", 5_000_000, 80_000_000), (3, "b", 0, 10**15), (4, "a", None, 5)], "i long, s string, lo long, hi long")
    got = intervals.interval_join(points, spans, ["s"], "t", "lo", "hi", 1_000_000).select("k", "i").collect()
    want = {(k, i) for k in range(500) for i, lo, hi in ((0, 0, 3_500_000_000), (1, 10_000_000, 10_000_000), (2, 5_000_000, 80_000_000)) if lo <= k * 7_000_000 <= hi}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_nearest_keeps_ties(spark):
    points = spark.createDataFrame([(0, "a", 15), (1, "a", 5), (2, "a", 100), (3, "a", 12)], "k long, s string, t long")
    spans = spark.createDataFrame([(0, "a", 0, 10), (1, "a", 20, 30), (2, "a", 3, 10)], "i long, s string, lo long, hi long")
    got = sorted((r.k, r.i, r.distance_us) for r in intervals.nearest(points, spans, ["k"], ["s"], "t", "lo", "hi").collect())
    assert got == [(0, 0, 5), (0, 1, 5), (0, 2, 5), (2, 1, 70), (3, 0, 2), (3, 2, 2)]


def test_details_name_the_nearest_three(spark):
    up = upstream(spark, [(0, 10), (20, 30), (60, 61), (90, 95)])
    m = correlate.matches(entries(spark, [("2", "", "k", "", 40), ("2", "", "k", "", 5), ("2", "", "k", "", -1)]), up)
    got = {r.entry_ord: r.detail for r in correlate.unknown_details(m, up).collect()}
    assert got == {0: "nearest=[b1:600.000000s,b2:1200.000000s,b0:1800.000000s]", 2: "nearest=[b0:60.000000s,b1:1260.000000s,b2:3660.000000s]"}


def test_half_gap_limits(spark):
    cycles = spark.createDataFrame([("a", 0, 0, 10), ("a", 1, 21, 30), ("a", 2, None, None)], "s string, o int, start_us long, end_us long")
    got = {r.o: (r.lower_us, r.upper_us) for r in intervals.half_gap_limits(cycles, ["s"], ["o"]).collect()}
    assert got == {0: (None, 16), 1: (17, None), 2: (None, None)}
    assert cycles.filter(F.col("o") == 0).count() == 1
