import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from slotwise.llm import suffix_dedup
from slotwise.llm.suffix_dedup import LevelledIndex, contexts, repeated_passages


def plain(texts, length):
    count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(t), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed, length):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdé ", k=rng.randint(1, 7)))
    passages = ["".join(word() for _ in range(length // 2)) for _ in range(6)]
    texts = []
    for _ in range(60):
        t = "".join(word() for _ in range(rng.randint(0, 120)))
        for p in rng.sample(passages, rng.randint(0, 3)):
            a = rng.randrange(len(p) // 2)
            t += p[a : a + rng.randint(1, len(p))] + word()
        texts.append(t)
    base = "".join(word() for _ in range(length))
    for _ in range(40):  # near copies with edits
        b = list(base)
        for _ in range(rng.randint(0, 3)):
            b[rng.randrange(len(b))] = "#"
        texts.append("".join(b))
    return texts + ["x" * 3 * length, "ab" * length, base * 2, "y" * (length - 1), "y" * length, ""]


@pytest.mark.parametrize("length,reach,hot", [(60, 32, 512), (60, 5, 512), (400, 256, 512), (60, 40, 1), (400, 256, 1)])
def test_against_brute_force(spark, docs, monkeypatch, length, reach, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "BAND", min(suffix_dedup.BAND, 9 if length < 100 else 32))
    texts = corpus(length + reach, length)
    rows = [(i, t) for i, t in enumerate(texts)] + [(900, None)]
    got = {r.id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeated_passages(docs(rows).repartition(4, "doc_id"), length=length, reach=reach).collect()}
    assert [got[i] for i in range(len(texts))] == plain([t.encode() for t in texts], length) and got[900][:3] == (0, 0, 0)


def test_contexts_own_every_window_once():
    rng = random.Random(1)
    for n in (399, 400, 401, 700, 5000):
        t = bytes(rng.choices(b"abc", k=n))
        fp, c1, c2, x, first, last = contexts(t)
        assert [i for a, b in zip(first, last) for i in range(a, b + 1)] == list(range(max(0, n - 399)))
        assert all(a <= p and b <= p < b + 256 and p < a + 256 for p, a, b in zip(x, first, last))


def test_levels_merge_and_find_across_batches(monkeypatch):
    rng = random.Random(2)
    base = bytes(rng.choices(b"abc", k=120))
    index, items = LevelledIndex(60, 32), []
    for _ in range(33):
        b = bytearray(base)
        b[rng.randrange(120)] = ord("#")
        items.append((bytes(b), 31, 32))
    for i in range(0, 33, 3):
        index.add(items[i : i + 3])
        sizes = [len(level.ids) for level in index.levels]
        assert all(a >= 2 * b for a, b in zip(sizes, sizes[1:]))
    for i, (data, x, windows) in enumerate(items):
        for s in range(windows):
            want = any(data[s : s + 60] == other[s : s + 60] for j, (other, _, _) in enumerate(items) if j != i)
            assert index.found[i, s] == want


def test_query_and_text(spark, sf, empty, docs, monkeypatch):
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = Counter(plain([(r.text or "").encode() for r in rows], 400))
    assert Counter((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.op3_suffix_dedup(spark, sf).collect()) == want
    assert suffix_dedup.op3_suffix_dedup(spark, empty).count() == 0
    same = repeated_passages(docs([(1, "z" * 10 + "a" * 500), (1, "a" * 500 + "y")]), with_text=True).collect()
    assert sorted(bytes(r.kept) for r in same) == [b"y", b"z" * 10]
    with pytest.raises(ValueError):
        repeated_passages(docs([(1, "x")]), length=100, reach=90)
