import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from slotwise.llm import exact_dedup, simhash


def normal(t):
    return re.sub(r"[\x20\x09-\x0d]+", " ", t or "")


def test_exact_query(spark, sf, empty):
    rows = [(r.doc_id, normal(r.text)) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = exact_dedup.op7_exact_dedup(spark, sf).collect()
    groups = {}
    for i, t in rows:
        groups.setdefault(t, []).append(i)
    keep = {t: min((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    want = sorted((str(i), str(keep[t]), len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in rows)
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in got) == want
    kept = [(r.doc_id, r.text_sha256) for r in got if r.kept]
    assert len(kept) == len(groups) and all(any(i == keep[t] and hashlib.sha256(t.encode()).hexdigest() == h for t in groups) for i, h in kept)
    assert exact_dedup.op7_exact_dedup(spark, empty).count() == 0


def test_exact_over_many_runs(spark, docs):
    rows = [(i, f"t{i % 7}") for i in range(400)]
    got = exact_dedup.exact_groups(docs(rows).repartition(37)).collect()
    assert {(r._id, r.keep_id, r.group_size) for r in got} == {(i, i % 7, len([j for j in range(400) if j % 7 == i % 7])) for i in range(400)}
    assert sorted(r.doc_id for r in exact_dedup.deduplicated(docs(rows)).collect()) == list(range(7))


def plain_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower())
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if sum(v >> b & 1 for v in h) * 2 > len(h))


@pytest.mark.parametrize("text", [None, "", " \t", "A", "a b c", "a b c d", "a b c d e", "É Ä b\xa0c d e f", "x " * 500])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_close_pairs_against_brute_force():
    rng = np.random.default_rng(0)
    for radius in (0, 2, 4, 6):
        sizes = np.sort(rng.integers(1, 170, 9))[::-1]
        fps = rng.integers(0, 2**63, 15).astype(np.uint64)[rng.integers(0, 15, sizes.sum())]
        for _ in range(3):
            fps = fps ^ (np.uint64(1) << rng.integers(0, 64, len(fps)).astype(np.uint64))
        got = {p for i, j in simhash.close_pairs(fps, sizes, radius) for p in zip(i.tolist(), j.tolist())}
        bucket = np.repeat(np.arange(len(sizes)), sizes)
        near = (np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius) & (bucket[:, None] == bucket[None, :])
        assert got == set(zip(*(x.tolist() for x in np.nonzero(np.triu(near, 1)))))


@pytest.mark.parametrize("n", [10, 1 << 26, 1 << 34, 1 << 60])
def test_bands_lose_nothing(n):
    sets, rng = simhash.band_sets(n), random.Random(n)
    for _ in range(300):
        differ = set(rng.sample(range(64), 4))
        assert any(all(not differ & set(range(o, o + w)) for o, w in bands) for bands in sets)


def brute_components(fps, ids):
    label = list(ids)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4
    while True:
        new = [min(label[j] for j in np.flatnonzero(near[i])) for i in range(len(ids))]
        if new == label:
            return label
        label = new


def test_near_query(spark, sf, empty, docs):
    rng = random.Random(3)
    base = [[rng.choice("abcdefghijklmnopqrstuvwxyz") * 3 + str(rng.randrange(50)) for _ in range(120)] for _ in range(12)]
    rows = []
    for i in range(240):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(120)] = "edit"
        rows.append((i * 3 % 241, " ".join(w)))
    rows += [(900, None), (901, ""), (902, " ")]
    got = {r._id: r for r in simhash.near_groups(docs(rows)).collect()}
    fps = np.array([plain_fingerprint(t) for _, t in rows], dtype=np.uint64)
    want = dict(zip([i for i, _ in rows], brute_components(fps, [i for i, _ in rows])))
    assert {i: r.component_id for i, r in got.items()} == want
    assert sum(r.kept for r in got.values()) == len(set(want.values())) == simhash.near_deduplicated(docs(rows)).count()
    assert simhash.op10_simhash(spark, sf).count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert simhash.op10_simhash(spark, empty).count() == 0


def test_large_buckets_in_chunks(spark):
    rng = np.random.default_rng(1)
    fps = np.unique(rng.integers(0, 2**62, 40).astype(np.uint64)[rng.integers(0, 40, 400)] ^ (np.uint64(1) << rng.integers(0, 9, 400).astype(np.uint64)))
    table = spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp long")
    whole = simhash.components(simhash.links(table, len(fps))).collect()
    parts = simhash.components(simhash.links(table, len(fps), chunk=3)).collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, parts)) and whole


@pytest.mark.parametrize("held", [1 << 20, 30, 5])
def test_components_of_chains(spark, monkeypatch, held):
    """In one task, and by stars over the remains of many."""
    monkeypatch.setattr(simhash, "HELD_EDGES", held)
    edges = [(i, i + 1) for i in range(50)] + [(100, 300), (300, 200)]
    rng = random.Random(4)
    rng.shuffle(edges)
    got = dict(map(tuple, simhash.components(spark.createDataFrame(edges, "u long, v long").repartition(7)).collect()))
    assert got == {i: 0 for i in range(1, 51)} | {200: 100, 300: 100}
