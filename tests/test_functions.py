import datetime as dt

import pytest
from pyspark.sql import functions as F

from slotwise.functions import text, times
from slotwise.functions.patterns import glob_pattern, portable, without_sequence
from slotwise.operators.extract import TIMESTAMP


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize("value,local,offset", [
    ("2026-01-03T00:05:00.123456", dt.datetime(2026, 1, 3, 0, 5, 0, 123456), None), ("2026-01-03 00:05:00.1234567+08:00", dt.datetime(2026, 1, 3, 0, 5, 0, 123456), 28800),
    ("2026-01-03T00:05:00-23:59", dt.datetime(2026, 1, 3, 0, 5), -86340), ("2026-1-3 00:05:00", None, None), ("2026-02-30T00:00:00", None, None), ("2026-01-03T24:00:00", None, None), ("2026-01-03T00:05:00+24:00", None, None),
])
def test_parsed(spark, value, local, offset):
    r = one(spark, value, times.parsed)
    assert (r and (r.ts_local, r.tz_offset_s)) == (local and (local, offset))
    if r:
        assert r.ts_us == int((local - dt.datetime(1970, 1, 1)).total_seconds()) * 1_000_000 + local.microsecond - (offset or 0) * 1_000_000


def test_times(spark):
    r = one(spark, "2026-01-03T00:05:00Z", times.parsed_loose)
    assert r.tz_offset_s == 0
    assert len(one(spark, "a 2026-01-03 00:00:00 b 2026-13-01 00:00:00 c 2026-01-03T00:00:01+08:00", lambda c: times.extracted(c, portable(TIMESTAMP)))) == 2
    assert one(spark, 1_767_398_700_123_400, lambda c: times.iso(times.from_us(c)), "long") == "2026-01-03T00:05:00.123400"
    assert one(spark, 1_767_398_700_000_000, lambda c: times.iso(times.from_us(c), F.lit(-19800)), "long") == "2026-01-03T00:05:00-05:30"
    assert [one(spark, b, lambda c: times.midpoint_us(F.lit(0), c), "long") for b in (10, 11, 13, 3, 1)] == [5, 6, 6, 2, 0]  # halves go to the even number
    assert one(spark, "diaglog_1_20260103070000.log.zip", lambda c: times.dump_time(c, portable(r".*_(\d{14})\..*"))) == dt.datetime(2026, 1, 3, 7)
    assert one(spark, "debug_20260103.log", lambda c: times.dump_time(c, portable(r".*_(\d{8})\..*"))) is None


def test_contains_with_open_sides(spark):
    rows = spark.createDataFrame([(0, 10, 5), (0, 10, 11), (None, 10, 5), (0, None, 5), (None, None, 5)], "s long, e long, t long")
    c = [F.col(x) for x in "set"]
    got = rows.select(times.contains(*c).alias("a"), times.contains_closed(*c).alias("b"), times.distance_us(*c).alias("d"), times.distance_closed_us(*c).alias("f")).collect()
    assert [tuple(r) for r in got] == [(True, True, 0, 0), (False, False, 1, 1), (True, False, 0, None), (True, False, 0, None), (False, False, None, None)]


def test_patterns(spark):
    p = portable(r"a=(?P<A_1>\d+)(?P=A_1)\Z")
    assert p.names == {"A_1": 1} and one(spark, "xa=77", p.found) and not one(spark, "xa=78", p.found)
    assert one(spark, "a\rb", portable("a.b").found)  # only the line feed is no character
    assert one(spark, "x[y", portable("x[[]y").found)
    assert one(spark, "Diag.ZIP", lambda c: c.rlike(glob_pattern("d?ag.*"))) and not one(spark, "diagzip", lambda c: c.rlike(glob_pattern("diag.zip")))
    assert without_sequence(r"(\S+)-(\d+) No\[(\d+)\](.+)", r"No\[(\d+)\]") == r"(\S+)-(\d+) (.+)"
    assert without_sequence(r"(a)(b)", r"No\[(\d+)\]") is None


def test_names(spark):
    assert [one(spark, v, text.safe_segment) for v in ("ok-1.x", "", None, "CON.log", "x.", "a b", "板")][:4] == ["ok-1.x", "unknown", "unknown", "CON.log~H" + one(spark, "CON.log", lambda c: F.substring(F.sha2(c.cast("binary"), 256), 1, 16))]
    assert one(spark, "a b", text.safe_segment).startswith("a~U00000020b~H") and one(spark, "板", text.safe_segment).startswith("~U0000677f~H") and one(spark, "😀", text.safe_segment).startswith("~U0001f600~H")
    rows = spark.createDataFrame([("svc", "12"), ("svc", ""), ("a b", "1")], "p string, n string").select(text.log_file_name(F.col("p"), F.col("n")).alias("f")).collect()
    assert [r.f for r in rows][:2] == ["svc-12.log", "svc.log"] and rows[2].f.endswith("~P1.log")
    assert tuple(one(spark, "slot_1_CPU_2", text.private_slot)) == ("1", "2") and tuple(one(spark, "Slot_10", text.private_slot)) == ("10", None)
    assert [tuple(one(spark, v, text.dashed_process)) for v in ("svc-1", "a-b", "a-b-22", "x")] == [("svc", "1"), ("a-b", ""), ("a-b", "22"), ("x", "")]
    assert tuple(one(spark, "svc-12", lambda c: text.dashed_process(c, 3))) == ("svc-12", "") and tuple(one(spark, "kitty[123]", text.bracket_process)) == ("kitty", "123")
    assert one(spark, "1/ 2 /", text.last_part) == "2" and one(spark, "　 x ", text.stripped) == "x"
    assert one(spark, "x" * 600, text.raw_text) == "x" * 500 and one(spark, 'a\n"b"', text.raw_preview) == "a\\n'b'"
    assert one(spark, "Straße", text.folded) == "strasse" and one(spark, "log_0012_3.txt", text.name_shape) == "log_*_3.txt"
    assert one(spark, "proc=x", lambda c: text.has_field(c, "proc")) and not one(spark, "procs=x", lambda c: text.has_field(c, "proc"))
