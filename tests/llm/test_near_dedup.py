import random

from slotwise.llm import near_dedup, simhash

import corpus_pipeline


def plain(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def survivors(rows):
    """Brute force over all pairs."""
    sets, label = [plain(t) for _, t in rows], list(range(len(rows)))
    near = [[j for j in range(len(rows)) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8] for i in range(len(rows))]
    while (new := [min(label[j] for j in js) for js in near]) != label:
        label = new
    groups = {}
    for (i, _), g in zip(rows, label):
        groups.setdefault(g, []).append(i)
    return sorted(min(ids) for ids in groups.values())


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"edit{rng.randrange(9999)}"
    return " ".join(words)


def test_stage_against_brute_force(spark, docs, tmp_path):
    rng = random.Random(8)
    base = [[f"w{rng.randrange(300)}" for _ in range(rng.choice([4, 20, 60, 200]))] for _ in range(30)]
    passage = [f"p{k}" for k in range(40)]
    rows = [(i * 7 % 401, edited(rng, rng.choice(base) + passage * (i % 2), rng.randrange(7))) for i in range(400)]
    rows += [(900, None), (901, ""), (902, " \t"), (903, "one two"), (904, "One  two"), (905, "one")]
    want = survivors(rows)
    assert len(want) < 300
    for n in (1, 5):
        docs(rows).repartition(n).write.parquet(f"{tmp_path}/{n}")
        assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, spark.read.parquet(f"{tmp_path}/{n}"), "").collect()) == want


def test_copies_beyond_four_bits(spark, docs, tmp_path):
    """Files, more than one, with pairs of similarity 0.8 to 0.9."""
    rng = random.Random(9)
    rows = []
    for i in range(40):
        words = [f"w{rng.randrange(5000)}" for _ in range(100)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, edited(rng, words, 1 + i % 3))]
    docs(rows).repartition(3).write.parquet(f"{tmp_path}/d")
    got = corpus_pipeline.near_dedup(spark, spark.read.parquet(f"{tmp_path}/d"), "")
    assert sorted(r.doc_id for r in got.collect()) == survivors(rows)


def test_chunks_of_large_groups(spark, docs, tmp_path):
    """Groups and buckets above the limits are cut; no link is lost."""
    rng = random.Random(10)
    words = [f"w{k}" for k in range(120)]
    rows = [(i, edited(rng, words, rng.randrange(9))) for i in range(150)]
    docs(rows).write.parquet(f"{tmp_path}/d")
    texts = near_dedup.with_node(spark.read.parquet(f"{tmp_path}/d"), near_dedup.F.col("text"))
    prints = near_dedup.sketches(texts).select("node", *near_dedup._FP, near_dedup.F.lit(0).alias("g"))
    want = {frozenset(map(tuple, simhash.components(near_dedup.verified(prints, texts, n)).collect())) for n in (1024, 40)}
    assert len(want) == 1 and len(want.pop()) == 150 - len(survivors(rows))


def test_word_and_shingle_hashes():
    rng = random.Random(11)
    texts = [b"", b" \t", b"A b\x0bc", b"a B c", b"a b c d e", b"a b c d e f", b"\xc3\x89 x\xc2\xa0y z z z z z z"] + [b" ".join(rng.choice([b"aa", b"b", b"Cc"]) for _ in range(rng.randrange(40))) for _ in range(60)]
    hashed = near_dedup.shingle_hashes(texts)
    of, plainly = {}, [plain(t.decode()) for t in texts]
    for h, s in zip(hashed, plainly):
        assert len(h) == len(s)
        of.setdefault(frozenset(h.tolist()), set()).add(frozenset(s))
    assert all(len(v) == 1 for v in of.values()) and len(of) == len({frozenset(s) for s in plainly})
    data = b" ".join(b"w%d" % (k * 7919 % 5003) for k in range(700_000))
    assert all((a == b).all() for a, b in zip(near_dedup.word_hashes(data), near_dedup._words(data)))
    assert all(near_dedup.similar(a, b) == (len(s & t) / len(s | t) >= 0.8) for a, s in zip(hashed, plainly) for b, t in zip(hashed, plainly))


def test_empty(spark, docs):
    assert near_dedup.near_deduplicated(docs([])).count() == 0
