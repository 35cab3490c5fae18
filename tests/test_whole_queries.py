"""Queries over whole tables beside those whose SQL takes a part."""

import hashlib
import re

import pytest

from slotwise import catalog, catalog_details, catalog_packages  # noqa: F401

WHITE = "\t\n\x0b\x0c\r \x85\xa0                　"


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("small")
    spark.sql("SELECT id AS event_id, pmod(hash(id), 12) AS user_id, concat('p', id % 3) AS event_type, timestamp_ntz '2026-01-01' + make_dt_interval(0, 0, 0, id * 40 + (id div 60) * 4000) AS ts FROM range(900)").write.parquet(f"{root}/events.parquet")
    return str(root)


def slot_of(spark, small):
    return {r.event_id: r.user_id % 4 for r in spark.read.parquet(f"{small}/events.parquet").collect()}


def test_all_adjacent_pairs(spark, small):
    slot = slot_of(spark, small)
    want = {(i, n) for i in slot if (n := min((j for j in slot if j > i and slot[j] == slot[i]), default=None)) is not None}
    assert {tuple(r) for r in catalog.QUERIES["w03_all_adjacent_pairs"](spark, small).collect()} == want and max(want)[0] >= 300


def test_all_decisions(spark, small):
    rows = [r for r in catalog.event_entries(spark, small).collect()]
    boards = [(r.slot, r.ord, r.start_us, r.end_us) for r in catalog.event_cycles(spark, small).collect()]
    found = lambda r: min((b for b in boards if b[0] == r.slot and b[2] <= r.ts_us <= b[3]), key=lambda b: b[1], default=None)
    cpus = {}
    for r in rows:
        if r.source == "diagnostic" and r.cpu_id and (b := found(r)):
            cpus.setdefault((b[0], b[1], r.cpu_id), []).append(r.ts_us)
    want = []
    for r in rows:
        if r.source == "journal" and (b := found(r)):
            at = cpus.get((b[0], b[1], r.cpu_id))
            own = f"{b[0]}:{b[1]}/{r.cpu_id}" if at and min(at) <= r.ts_us <= max(at) else None
            want.append((r.ts_us, f"{b[0]}:{b[1]}", own, "no_cpu_cycle_contains_timestamp" if r.cpu_id and not own else "matched_by_time"))
    got = catalog.QUERIES["l19_all_decisions"](spark, small).collect()
    assert len(got) == len([r for r in rows if r.source == "journal"])
    by_time = [(r.ts_us, r.board_id, r.own_id, r.reason) for r in got if r.reason in ("matched_by_time", "no_cpu_cycle_contains_timestamp")]
    assert sorted(by_time, key=str) == sorted(want, key=str) and any(w[2] for w in want)


def test_all_raw_texts(spark, tmp_path):
    texts = [None, "", " \t", "  9 lives ", "\u2003\u3000été\x85", "\n- a\n", "x" * 600, "\xa0" + "日" * 501]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = dict(map(tuple, catalog.QUERIES["s27_all_raw"](spark, str(tmp_path)).collect()))
    assert got == {i: t if t is None else t.strip()[:500] for i, t in enumerate(texts)}


def segment(t):
    if not t:
        return "unknown"
    reserved = re.fullmatch(r"CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9]", t.split(".")[0].upper())
    if re.fullmatch(r"[A-Za-z0-9_.-]+", t) and t not in (".", "..") and not t.endswith(".") and not reserved:
        return t
    return "".join(c if re.match(r"[A-Za-z0-9_.-]", c) else f"~U{ord(c):08x}" for c in t) + "~H" + hashlib.sha256(t.encode()).hexdigest()[:16]


def test_whole_segments(spark, tmp_path):
    texts = [None, "", "safe-1.log", "..", "end.", "con.txt", "a/b\\c:d~e\n", "été 日本 😀 " * 20, "\t\x01\x7f", "x" * 300]
    spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert dict(map(tuple, catalog.QUERIES["s21_whole_segment"](spark, str(tmp_path)).collect())) == {i: segment(t) for i, t in enumerate(texts)}


def test_whole_order(spark, small):
    slot, want = slot_of(spark, small), set()
    for s in range(4):
        want |= {(i, str(s), n) for n, i in enumerate(sorted((i for i in slot if slot[i] == s), key=lambda i: (i % 97, i)), 1)}
    assert {tuple(r) for r in catalog.QUERIES["o01_whole_order"](spark, small).collect()} == want
