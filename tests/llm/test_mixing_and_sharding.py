import re
import struct
import zlib
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from slotwise.llm import common, mixing, sharding


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


@pytest.mark.parametrize("text", [None, "", " ", "a", " a ", "a\tb\n", "\x0b\x0c", "a\xa0b", "  x  y  "])
def test_word_count(spark, text):
    assert spark.createDataFrame([(text,)], "t string").select(mixing.n_words(F.col("t")).alias("n")).first().n == words(text)


def plain_targets(sizes, weights=(5, 2, 1)):
    w = {s: weights[i % len(weights)] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    total, capped = sum(sizes.values()), set()
    while True:
        level = (total - sum(3 * sizes[s] for s in capped)) / max(1, sum(w[s] for s in w if s not in capped))
        over = {s for s in w if s not in capped and w[s] * level > 3 * sizes[s]}
        if not over:
            return {s: 3.0 * sizes[s] if s in capped else w[s] * level for s in w}
        capped |= over


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 5, None: 100}, {"a": 1}, {"x": 0, "y": 50}, {"a": 1, "b": 1, "c": 1000000}, {"a": 100, "b": 100, "c": 100, "d": 1}])
def test_targets(spark, sizes):
    rows = spark.createDataFrame([(s is None, s or "", n) for s, n in sizes.items()], "none boolean, src string, source_size long")
    got = {None if r.none else r.src: r.target for r in mixing.targets(rows).collect()}
    assert got == pytest.approx(plain_targets(sizes))


@pytest.mark.parametrize("block", [1, 7, 512])
def test_mix_keeps_its_promises(spark, docs, block):
    rows = [(i, " ".join(["w"] * (i * 7 % 23)), [None, "a", "b", "c", "d"][i % 5] if i % 3 else "a") for i in range(150)] + [(7, "again x", "b"), (7, "again x", "b"), (None, "y z", "d")]
    df = docs(rows).repartition(5, "doc_id")
    got = mixing.mix(df, block_words=block, shard_slots=16).collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += words(t)
    want = plain_targets(dict(sizes))
    assert len(got) == len(rows) and all(r.taken <= 3 * r.size for r in got)
    by = Counter()
    for r in got:
        by[round(r.target, 6)] += r.taken
    for target in {round(v, 6) for v in want.values()}:
        # Sources may share a target; each takes its own to the word.
        assert by[target] == sum(round(v) for v in want.values() if round(v, 6) == target)
    again = mixing.mix(df, block_words=block, shard_slots=16).collect()
    assert Counter((r.id, r.size, r.taken) for r in got) == Counter((r.id, r.size, r.taken) for r in again)
    texts = Counter()
    for r in mixing.mixed(df, block_words=block, shard_slots=16).collect():
        texts[r.doc_id] += words(r.text)
    assert texts == Counter({k: v for k, v in sum((Counter({r.id: r.taken}) for r in got), Counter()).items() if v})


def test_mixing_query(spark, sf, empty):
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = mixing.op5_mixing(spark, sf).collect()
    assert Counter((r.doc_id, r.size) for r in got) == Counter((r.doc_id, words(r.text)) for r in rows)
    assert mixing.op5_mixing(spark, empty).count() == 0 and mixing.mixed(spark.read.parquet(f"{empty}/documents.parquet")).count() == 0


def test_shard_counts_are_whole(spark, docs):
    rows = mixing.targets(spark.createDataFrame([(False, s, n) for s, n in (("a", 4000), ("b", 900), ("c", 10))], "none boolean, src string, source_size long"))
    plan = mixing._plan(rows, 8, 3, 1)
    slots = mixing.drawn_slots(plan, 3, 1, 64)
    places = [(r["shard"], r.slot) for r in slots.collect()]
    assert sorted(places) == [(i // 64, i % 64) for i in range(len(places))]
    counts = mixing.shard_counts(slots).collect()
    slots = {r.src: r._slots for r in plan.collect()}
    by_source, by_shard = Counter(), Counter()
    for r in counts:
        by_source[r.src] += r.n
        by_shard[r["shard"]] += r.n
    assert by_source == Counter(slots) and sorted(by_shard.values())[1:] == [64] * (len(by_shard) - 1)


def test_taken_against_a_plain_mix(spark, docs, tmp_path):
    """Words are taken slot by slot, by hand, from the drawn slots and the words of every source in order."""
    docs([(i, " ".join(f"d{i}w{k}" for k in range(i * 5 % 17)), "abc"[i % 3] if i % 4 else "a") for i in range(80)]).repartition(3).write.parquet(f"{tmp_path}/d")
    df = spark.read.parquet(f"{tmp_path}/d")
    measured = mixing._measured(df, "doc_id", "text", "source")
    sources = mixing.targets(measured.groupBy("none", "src").agg(F.sum("size").alias("source_size")))
    words_of = {}
    for r in sorted(df.collect(), key=lambda r: (r.source, r.doc_id)):
        words_of.setdefault(r.source, []).extend((r.doc_id, w) for w in r.text.split())
    want, in_order = Counter(), {}
    for r in mixing.drawn_slots(mixing._plan(sources, 4, 3, mixing.SEED), 2, mixing.SEED, 8).collect():
        block = words_of[r.src][r.block * 4 : r.block * 4 + 4]
        block = block if r.cut is None else block[: r.cut]
        want.update(i for i, _ in block)
        in_order[r["shard"], r.slot] = [w for _, w in block]
    got = mixing.mix(df, block_words=4, shard_slots=8).collect()
    assert {r.id: r.taken for r in got if r.taken} == dict(want)
    ids = {r._rk: r.id for r in got}
    texts = {r.doc_id: r.text.split() for r in df.collect()}
    placed = {}
    for r in mixing.mix_layout(measured, sources, 4, 8).collect():
        placed.setdefault((r["shard"], r.slot), []).append((r["at"], texts[ids[r._rk]][r.lo : r.upto]))
    assert {k: [w for _, ws in sorted(v) for w in ws] for k, v in placed.items()} == in_order


def hashed(*values):
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest(struct.pack("<q", v), h)
    return h - (1 << 64) if h >> 63 else h


@pytest.mark.parametrize("n", [1, 2, 3, 5, 24, 100, 4097])
def test_permutation(spark, n):
    df = spark.range(n).withColumnRenamed("id", "x").withColumn("n", F.lit(n).cast("long"))
    out = common.permuted(df, "x", "n", F.lit(9).cast("long"), "p")
    back = common.permuted(out.drop("x"), "p", "n", F.lit(9).cast("long"), "x", inverse=True)
    rows = back.collect()
    forward = {r.x: r.p for r in out.collect()}
    assert sorted(forward.values()) == list(range(n)) and all(forward[r.x] == r.p for r in rows)


def test_sharding_query(spark, sf, empty):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = sharding.op9_sharding(spark, sf).collect()
    want = Counter((r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    slots = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(r.law == "rows" and r.grown_shard is None for r in got) and sharding.op9_sharding(spark, empty).count() == 0


def test_shuffle_does_not_depend_on_layout(spark, docs):
    rows = [(i, str(i)) for i in range(300)]
    one = sharding.feistel_shards(docs(rows), ["doc_id"], 24)
    two = sharding.feistel_shards(docs(rows[::-1]).repartition(7), ["doc_id"], 24)
    place = lambda df: {r.doc_id: (r["shard"], r.slot, r.row_no) for r in df.collect()}
    assert place(one) == place(two)
    back = sharding.row_of(one.select("doc_id", "shard", "slot"), 300, 24).collect()
    assert all(r.row_no == r.doc_id for r in back)


def test_prefix_sums_over_many_partitions(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        rows = common.ordered(spark.range(500).withColumn("g", F.when(F.col("id") % 7 == 0, "b").otherwise("a")).withColumn("v", F.col("id") % 5), "g", "id")
        got = common.prefix_sums(rows, ["g"], {"s": "v", "k": "id"}).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "2")
    for r in got:
        before = [i for i in range(r.id) if (i % 7 == 0) == (r.id % 7 == 0)]
        assert (r.s, r.k) == (sum(i % 5 for i in before), sum(before))
