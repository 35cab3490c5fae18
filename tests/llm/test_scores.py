"""LM scores, toxicity and the pipeline."""

import math
import random
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from slotwise.llm import common, lm_score, toxicity


def plain_losses(docs, good, fold_of):
    """Every document by two models of its own: the other folds' targets, and a part as large of the other folds."""
    pads = [(i, fold_of[i], [0] * 4 + [c + 1 for c in (t or "").encode()] + [257]) for i, t in docs]
    models = {}
    for f in set(fold_of.values()):
        counts = {(n, m): Counter() for n in range(1, 6) for m in "tb"}
        size = Counter()
        for i, own, y in pads:
            if own == f:
                continue
            for m in "tb" if i in good else "b":
                size[m] += len(y) - 4
                for k in range(4, len(y)):
                    for n in range(1, 6):
                        counts[n, m][tuple(y[k - n + 1 : k + 1])] += 1
        share = {"t": 1, "b": size["t"] / size["b"] if size["b"] else 0}
        total, kinds = {k: Counter() for k in counts}, {k: Counter() for k in counts}
        for k, c in counts.items():
            for g, n in c.items():
                total[k][g[:-1]] += n * share[k[1]]
                kinds[k][g[:-1]] += 1 - (1 - share[k[1]]) ** n
        models[f] = counts, total, kinds, share

    @lru_cache(None)
    def p(f, g, m):
        if not g:
            return 1 / 257
        counts, total, kinds, share = models[f]
        k, low = (len(g), m), p(f, g[1:], m)
        n = total[k][g[:-1]]
        return (counts[k][g] * share[m] + kinds[k][g[:-1]] * low) / (n + kinds[k][g[:-1]]) if n else low

    return [(i, len(y) - 4, *[sum(-math.log(p(f, tuple(y[k - 4 : k + 1]), m)) for k in range(4, len(y))) / (len(y) - 4) for m in "tb"]) for i, f, y in pads]


def folds(docs):
    """The fold of every id, as hashed by Spark; rows without an id are in fold 0."""
    buckets = -(-common.bucket_count(docs, "text") // lm_score.FOLDS) * lm_score.FOLDS
    rows = docs.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).alias("b")).collect()
    return {r.doc_id: 0 if r.doc_id is None else r.b % lm_score.FOLDS for r in rows}


def test_lm_scores(spark, sf, empty):
    rows = spark.read.parquet(f"{sf}/documents.parquet")
    docs = [(r.doc_id, r.text) for r in rows.collect()]
    good = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").filter("quality = 1").collect()} - {None}
    got = sorted(((str(r.doc_id), r.n_tokens, r.target_loss, r.background_loss) for r in lm_score.op6_lm_score(spark, sf).collect()))
    want = sorted((str(i), *r) for i, *r in plain_losses(docs, good, folds(rows)))
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert np.allclose([g[2:] for g in got], [w[2:] for w in want], atol=1e-9)
    assert lm_score.op6_lm_score(spark, empty).count() == 0


def test_lm_without_targets(spark, docs):
    none = spark.createDataFrame([], "id long")
    r = lm_score.cross_entropy_difference(docs([(1, "abc"), (2, None)]), none).collect()
    assert all(x.target_loss == x.background_loss == pytest.approx(math.log(257)) and x.score == 0 for x in r)


def test_lm_scores_tell_the_target_apart(spark, docs):
    """Held out and matched in size: unlabelled texts like the targets score below others, labelled or not."""
    rng = random.Random(4)
    kinds = [[rng.choice(c) + rng.choice("aeiou") + rng.choice(c) for _ in range(40)] for c in ("bdfg", "kmpt")]
    rows = [(i, " ".join(rng.choices(kinds[i % 2], k=60))) for i in range(400)]
    good = spark.createDataFrame([(i,) for i in range(0, 100, 2)], "id long")
    got = {r.id: r.score for r in lm_score.cross_entropy_difference(docs(rows), good).collect()}
    near, far = [got[i] for i in range(0, 400, 2)], [got[i] for i in range(1, 400, 2)]
    assert max(near) < min(far)
    assert abs(np.mean([got[i] for i in range(0, 100, 2)]) - np.mean([got[i] for i in range(100, 400, 2)])) < 0.05


def toxic_corpus(n, seed=1):
    rng = random.Random(seed)
    clean = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) for _ in range(800)]
    bad = ["vilezor", "vilekan", "grunchy", "Mukk", "vilebor"]
    rows, labels = [], []
    for i in range(n):
        w, t = rng.choices(clean, k=rng.randint(20, 120)), int(rng.random() < 0.2)
        for _ in range(rng.randint(2, 6) if t else 0):
            w.insert(rng.randrange(len(w)), rng.choice(bad))
        if rng.random() < 0.1:
            w = [x.upper() + "!!" for x in w]
        rows.append((i, " ".join(w)))
        labels.append((i, 1, t))
    return rows, labels


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_toxicity_held_out(spark, docs, tmp_path):
    rows, labels = toxic_corpus(1500)
    rows += [(5000, None), (5001, ""), (None, "grunchy mukk vilezor")]
    # The labels of held-out rows are turned round: nothing may be learnt from them.
    known = spark.createDataFrame([(i, q, 1 - t if held(i) else t) for i, q, t in labels], "doc_id long, quality int, toxic int")
    docs(rows).write.parquet(str(tmp_path / "documents.parquet"))
    known.write.parquet(str(tmp_path / "labels.parquet"))
    got = {r.doc_id: r for r in toxicity.op8_toxicity(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    test = [(t, got[i]) for i, _, t in labels if held(i)]
    assert all(r.held_out for _, r in test) and np.mean([r.predicted == t for t, r in test]) > 0.98
    assert got[5000].score == got[5001].score < 0.3 and got[None].predicted == 1
    stay = toxicity.not_toxic(docs(rows), known)
    assert stay.columns == docs(rows).columns and {r.doc_id for r in stay.collect()} == {i for i, r in got.items() if not r.predicted}


def test_toxicity_without_labels(spark, sf, empty, docs):
    assert toxicity.op8_toxicity(spark, empty).count() == 0
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    assert toxicity.op8_toxicity(spark, sf).count() == n
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.not_toxic(docs([(1, "x")]), none).count() == 1


def test_disguises():
    assert toxicity.plain("St0opid!!") == "stoopid" and toxicity.plain("l-o-s-e-r") == "loser" and toxicity.plain("«Été»") == "été" and toxicity.plain("123") == "123"


def test_isotonic_is_monotone():
    rng = np.random.default_rng(0)
    raw = rng.normal(size=500)
    y = (rng.random(500) < 1 / (1 + np.exp(-2 * raw))).astype(float)
    at, score = toxicity.isotonic(raw, y)
    assert (np.diff(at) > 0).all() and (np.diff(score) >= 0).all() and 0 <= score[0] and score[-1] <= 1
    assert abs(np.interp(0.0, at, score) - 0.5) < 0.2


def test_trees_learn():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 3))
    y = ((x[:, 0] > 0.3) & (x[:, 1] < 0.5)).astype(float)
    base, trees = toxicity.grow(x, y)
    raw = np.full(2000, base) + sum(toxicity.RATE * toxicity.tree_values(t, x) for t in trees)
    assert ((raw > 0) == (y > 0)).mean() > 0.99


def test_pipeline(spark, tmp_path, docs):
    rows, labels = toxic_corpus(400, 2)
    texts = [t for _, t in rows]
    rows += [(1000 + i, texts[i]) for i in range(0, 40, 2)] + [(2000 + i, texts[i].replace(" ", " \t")) for i in range(1, 40, 2)] + [(3000, None), (3001, "")]
    df = docs([(i, t, "abcd"[(i or 0) % 4]) for i, t in rows])
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    at, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    columns = at.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, at, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        at = spark.read.parquet(str(tmp_path / name))
        seen[name] = at
        if name != "bpe":
            assert at.columns == columns
    bad = {i for i, _, t in labels if t}
    left = {n: [r.doc_id for r in seen[n].collect()] for n in seen}
    assert not bad & set(left["toxicity"]) and len(left["toxicity"]) >= len(rows) - len(bad) * 1.2 - 20
    assert len(set(left["exact_dedup"])) == len(left["exact_dedup"]) and not [i for i in left["exact_dedup"] if 1000 <= i < 3000]
    assert set(left["near_dedup"]) <= set(left["exact_dedup"]) and set(left["mixing"]) <= set(left["near_dedup"])
    assert seen["bpe"].count() == seen["mixing"].count() and seen["bpe"].filter("n_tokens * 4 <> length(ids)").count() == 0
    whole = corpus_pipeline.run(spark, str(tmp_path))
    key = lambda df: Counter((r.doc_id, r.n_tokens, r.ids_sha256) for r in df.collect())
    assert key(whole) == key(seen["bpe"])


def test_pipeline_of_nothing(spark, empty, tmp_path):
    at = common.table(spark, empty, "documents")
    for name, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, empty)
        assert at.count() == 0
