import numpy as np
import pytest
from pyspark.sql import functions as F

from slotwise.llm import ann

SCHEMA = "vec_id long, embedding array<float>, label int, id int, v string"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, 1, "clash") for i, v in rows], SCHEMA)


def brute(rows, k, query):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], dtype=np.float32).astype(float)
    out = {}
    for q in np.flatnonzero([query(i) for i in ids]):
        s = (x * x[q]).sum(axis=1)
        order = [j for j in np.lexsort((ids, -s)) if j != q][:k]
        out[int(ids[q])] = [int(ids[j]) for j in order]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r.vec_id)
    return out


@pytest.mark.parametrize("kind", ["random", "clustered", "unequal lengths"])
def test_recall(spark, kind):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 16))
    if kind == "clustered":
        x = x * 0.2 + rng.normal(size=(20, 16))[rng.integers(0, 20, 3000)]
    if kind == "unequal lengths":
        x *= rng.uniform(0.5, 2, (3000, 1))
    rows = [(int(i), v) for i, v in enumerate(np.float32(x))]
    want, got = brute(rows, 10, lambda i: i % 20 == 0), found(ann.search(table(spark, rows), F.col("id") % 20 == 0, 10, k=16))
    assert set(want) == set(got) and all(len(v) == 10 for v in got.values())
    assert np.mean([len(set(want[q]) & set(got[q])) / 10 for q in want]) >= 0.9


def test_scores_and_ties(spark):
    rng = np.random.default_rng(2)
    same = np.float32(rng.normal(size=8))
    rows = [(i, same) for i in range(400)] + [(1000 + i, np.float32(rng.normal(size=8))) for i in range(400)]
    df = ann.search(table(spark, rows), F.col("id") % 20 == 0, 20, k=8)
    got = found(df)
    assert got[0] == list(range(1, 21)) and got[40] == list(range(20))
    exact = float((same.astype(float) ** 2).sum())
    r = df.filter("query_id = 0").collect()
    assert all(x.score == pytest.approx(exact, abs=1e-15) for x in r) and len({x.score for x in r}) == 1


def test_unusable_vectors_and_few(spark, empty):
    rows = [(0, [1, 0]), (1, [0.5, 0]), (2, None), (3, [0, 0]), (4, [1, None]), (5, [float("nan"), 1]), (6, [float("inf"), 1]), (7, []), (8, [1, 2, 3]), (None, [1, 1]), (1, [0.5, 0]), (20, [0, 1])]
    assert found(ann.search(table(spark, rows), F.col("id") % 20 == 0, 20)) == {0: [1, 1, 20], 20: [0, 1, 1]}
    assert ann.op4_ann(spark, empty).count() == 0
    assert ann.search(table(spark, [(0, [1, 1])]), F.col("id") % 20 == 0, 20).count() == 0


def test_every_row_but_the_own_is_a_candidate(spark):
    """Repeated ids and equal rows ask and are found row by row; other lengths are searched by themselves."""
    rows = [(0, [1, 0]), (0, [0, 1]), (0, [0, 1]), (5, [2, 1]), (20, [1, 1, 1]), (6, [3, 0, 0]), (7, [4])]
    got = {}
    for r in ann.search(table(spark, rows), F.col("id") % 20 == 0, 20).collect():
        got.setdefault((r.query_id, r.query_row), []).append((r["rank"], r.vec_id, r.score))
    want = [[(1, 0, 1.0), (2, 5, 1.0), (3, 0, 0.0)]] * 2 + [[(1, 5, 2.0), (2, 0, 0.0), (3, 0, 0.0)]] + [[(1, 6, 3.0)]]
    assert sorted(sorted(v) for v in got.values()) == sorted(want)


def test_hot_id_and_hot_vector(spark):
    rng = np.random.default_rng(5)
    rows = [(i if i % 3 else 40, np.float32(rng.normal(size=6))) for i in range(1000, 1900)] + [(40, np.ones(6))] * 300
    r = ann.search(table(spark, rows), F.col("id") == 40, 5, k=4).groupBy("query_row").count().collect()
    assert len(r) == 600 and {x["count"] for x in r} == {5}


def test_sample_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(ann, "SAMPLE_ROWS", 200)
    rng = np.random.default_rng(6)
    rows = [(i, v) for i, v in enumerate(np.float32(rng.normal(size=(3000, 8))))]
    want, got = brute(rows, 10, lambda i: i % 20 == 0), found(ann.search(table(spark, rows), F.col("id") % 20 == 0, 10, k=16))
    assert np.mean([len(set(want[q]) & set(got[q])) / 10 for q in want]) >= 0.9


def test_traversal_is_in_order_and_whole():
    rng = np.random.default_rng(3)
    index = ann.Index(rng.normal(size=(7, 3)), rng.normal(size=(5, 2)))
    q = rng.normal(size=5)
    seen = list(index.traverse(q))
    a, b = index.halves(q)
    assert len({(i, j) for _, i, j in seen}) == 35 and [s for s, _, _ in seen] == sorted((x + y for x in a for y in b), reverse=True)


def test_layout_splits_large_cells():
    index = ann.Index(np.zeros((2, 1)), np.zeros((2, 1)), np.array([[9000, 3], [4, 0]]))
    index.lay_out(9007)
    assert index.parts[0] > 20 and index.bucket[1] >= index.parts[0] and index.bucket[1] == index.bucket[2]
