"""Near-dedup on word shingles: texts whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more are linked.

SimHash, of WIDTH bits here, with the bit-sliced comparison of ``simhash`` finds the pairs, and the sets decide:

1. A prefix filter makes the buckets, so no pair is lost: in any one order of all shingles, two sets of that
   similarity share a shingle among the first n // 5 + 1 of each (n: size of the set).  The order is by how often
   a shingle's slot of a fixed table of counts over all documents was hit, rare ones first, which keeps buckets small.
2. In a bucket, fingerprints within RADIUS bits are connected.  Two texts of that similarity differ in 39 of 256 bits
   on average with a deviation of 6, so a pair beyond 96 bits has a chance of about 1e-18, well below that of a
   collision among 64-bit hashes; unlike texts differ in 128.
3. The texts of what is connected so come together, and every pair within RADIUS that is not yet joined is decided by
   its sets.  Larger groups are cut into chunks, and each pair of chunks is a task's work.

Equal sets (by 128-bit digest) are one text through all of this.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwise.llm.common import bucket_count, checkpointed, file_table, only, packed, row_key, stored, unpacked
from slotwise.llm.simhash import close_pairs, compared, components

SHINGLE, WIDTH, RADIUS = 5, 256, 96
#: Slots of the table of counts (as bits), and bytes of text that are hashed at once.
SLOT_BITS, PART_BYTES = 18, 1 << 18
#: Texts of a group, and fingerprints of a bucket, that one task compares with each other at most (or with as many others).
GROUP_CHUNK, BUCKET_CHUNK = 1024, 1024
#: Multipliers of the hashes and the seed of their byte table.
_B, _C, _SEED = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), 11
_MIX = np.random.default_rng(_SEED).integers(0, 2**63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_WORDS = np.random.default_rng(_SEED + 1).integers(0, 2**63, WIDTH // 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTES = np.random.default_rng(_SEED + 2).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTES[ord("A") : ord("Z") + 1] = _BYTES[ord("a") : ord("z") + 1]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTES[_SPACE] = 0


def _stir(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _C
    h = (h ^ (h >> np.uint64(29))) * _B
    return h ^ (h >> np.uint64(32))


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words start, and a hash of each in which A-Z count as a-z; only ASCII white space parts words."""
    if len(data) > 2 * PART_BYTES:  # a very long text goes in pieces that end at white space
        cut = max(data.rfind(bytes([c]), PART_BYTES, 2 * PART_BYTES) for c in b" \t\n\v\f\r")
        if cut > 0:
            starts, hashes, at = [], [], 0
            while at < len(data):
                end = len(data)
                if end - at > 2 * PART_BYTES:
                    cut = max(data.rfind(bytes([c]), at + PART_BYTES, at + 2 * PART_BYTES) for c in b" \t\n\v\f\r")
                    end = cut if cut > 0 else end
                s, h = word_hashes(data[at:end]) if at or end < len(data) else _words(data)
                starts.append(s + at)
                hashes.append(h)
                at = end
            return np.concatenate(starts), np.concatenate(hashes)
    return _words(data)


def _words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    b = np.frombuffer(data, np.uint8)
    inside = ~_SPACE[b]
    starts = np.flatnonzero(inside & np.concatenate([[True], ~inside[:-1]]))
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    b = b[starts[0] :]
    lengths = np.diff(np.append(starts - starts[0], len(b)))
    power = np.full(int(lengths.max()), _B, np.uint64)
    power[0] = 1
    place = np.arange(len(b)) - np.repeat(starts - starts[0], lengths)
    return starts, _stir(np.add.reduceat(_BYTES[b] * np.multiply.accumulate(power)[place], starts - starts[0]))


def shingle_hashes(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted set of every text's shingle hashes.  Fewer words than a shingle make one of all; wordless texts are alike."""
    ends = np.cumsum([len(t) + 1 for t in texts])
    starts, words = word_hashes(b" ".join(texts))
    n = np.diff(np.concatenate([[0], np.searchsorted(starts, ends)]))
    room = np.maximum(n, SHINGLE)  # short texts are filled up with zeros
    first = np.cumsum(room) - room
    slots = np.zeros(int(room.sum()) + SHINGLE, np.uint64)
    slots[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(len(words))] = words
    h = np.zeros(len(slots) - SHINGLE, np.uint64)
    for j in range(SHINGLE):
        h += slots[j : j + len(h)] * _MIX[j]
    h = _stir(h)
    return [np.unique(h[a : a + m - SHINGLE + 1]) for a, m in zip(first.tolist(), room.tolist())]


def sets_of(texts: Iterable[bytes]) -> Iterator[np.ndarray]:
    """``shingle_hashes`` of any number of texts, a bounded number of bytes at a time."""
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size > PART_BYTES:
            yield from shingle_hashes(held)
            held, size = [], 0
    if held:
        yield from shingle_hashes(held)


def fingerprint(h: np.ndarray) -> np.ndarray:
    """SimHash of a set of hashes: WIDTH // 64 words; a bit is 1 if it is set in over half the stirred hashes."""
    counts, step = np.zeros(WIDTH, np.int64), 1 << 14
    for k in range(0, len(h), step):
        wide = _stir(h[k : k + step, None] * _WORDS)
        counts += np.unpackbits(wide.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(counts * 2 > len(h), bitorder="little").view(np.uint64)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Jaccard similarity of 0.8 or more, in integers; the sets are sorted."""
    if 5 * min(len(a), len(b)) < 4 * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort()
    return 9 * int((both[1:] == both[:-1]).sum()) >= 4 * len(both)


def with_node(docs: DataFrame, *cols) -> DataFrame:
    """_node, one long that names the row of a file table (number of the file and row in it), with _rk and ``cols``.

    The files are listed by the driver, which planned the read from that same list.
    """
    rows = docs.select(row_key().alias("_rk"), *cols)
    files = sorted(r[0] for r in rows.select("_rk.f").distinct().collect())
    numbers = rows.sparkSession.createDataFrame(list(zip(files, range(len(files)))) or [(0, 0)], "_f long, _no long")
    named = rows.join(F.broadcast(numbers), F.col("_rk.f") == F.col("_f")) if len(files) > 1 else rows.withColumn("_no", F.lit(0).cast("long"))
    return named.withColumn("_node", F.shiftleft("_no", 40).bitwiseOR(F.col("_rk.i"))).drop("_f", "_no")


def slot_counts(texts: DataFrame) -> np.ndarray:
    """How often the shingles of all documents hit each slot of a table of fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SLOT_BITS, np.int64)
        for batch in batches:
            for h in sets_of((x.as_py() or "").encode() for x in batch.column(0)):
                np.add.at(total, (h >> np.uint64(64 - SLOT_BITS)).view(np.int64), 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["slot", "n"])

    found = texts.select("text").mapInArrow(run, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << SLOT_BITS, np.int64)
    out[found.column("slot").to_numpy()] = found.column("n").to_numpy()
    return out


_FP = [f"w{k}" for k in range(WIDTH // 64)]


def sketches(texts: DataFrame) -> DataFrame:
    """(node, d1, d2, w0 to w3, prefix) of every text: digest of the set, fingerprint, and the prefix's shingles."""
    counts = texts.sparkSession.sparkContext.broadcast(slot_counts(texts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = counts.value
        for batch in batches:
            for k in range(0, batch.num_rows, 2048):
                part = batch.slice(k, 2048)
                digests, fps, heads = [], [], []
                for h in sets_of((x.as_py() or "").encode() for x in part.column(1)):
                    digests.append(hashlib.blake2b(h.tobytes(), digest_size=16).digest())
                    fps.append(fingerprint(h))
                    heads.append(h[np.argsort(often[(h >> np.uint64(64 - SLOT_BITS)).view(np.int64)], kind="stable")[: len(h) // 5 + 1]])
                d = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                w = np.array(fps, np.uint64).view(np.int64).reshape(-1, len(_FP))
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in heads])]).astype(np.int32)
                prefix = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(heads).view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(d[:, 0]), pa.array(d[:, 1]), *(pa.array(w[:, i]) for i in range(len(_FP))), prefix], ["node", "d1", "d2", *_FP, "prefix"])

    shape = "node long, d1 long, d2 long, " + ", ".join(f"{w} long" for w in _FP) + ", prefix array<long>"
    return stored(texts.select("_node", "text").mapInArrow(run, shape))


def verified(groups: DataFrame, texts: DataFrame, chunk: int = GROUP_CHUNK) -> DataFrame:
    """(u, v): similar pairs that connect all nodes of a group which similar pairs connect.  ``groups``: g, node, w0 to w3.

    Every node goes with its text to the task of its group, or of each pair of chunks that its chunk is part of.
    """
    large = checkpointed(groups.groupBy("g").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > chunk))
    one = F.array(F.struct(F.lit(0).alias("a"), F.lit(0).alias("b")))
    if large.isEmpty():
        places = groups.withColumn("to", one)
    else:
        chunks = F.ceil(F.col("n") / chunk).cast("int")
        own = F.pmod(F.xxhash64("node"), chunks).cast("int")
        pairs = F.transform(F.sequence(F.lit(0), chunks - 1), lambda c: F.struct(F.least(c, own).alias("a"), F.greatest(c, own).alias("b")))
        places = groups.join(large, "g", "left").withColumn("to", F.when(F.col("n").isNull(), one).otherwise(pairs))
    buckets = bucket_count(texts, "text")
    at = F.pmod(F.xxhash64("node"), F.lit(buckets)).cast("int")
    wanted = places.select(at.alias("b"), "node", "g", *_FP, "to")
    packs = packed(texts.select(F.col("_node").alias("node"), "text"), at)

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        of = dict(zip(right.column("node").to_pylist(), range(right.num_rows)))
        g, to, rows, data = right.column("g").to_pylist(), right.column("to").to_pylist(), [], []
        for node, text in unpacked(left) if of else ():
            if (r := of.get(node)) is not None:
                for p in to[r]:
                    rows.append((r, g[r], p["a"], p["b"], node))
                    data.append(text)
        r, *keys = list(zip(*rows)) or [()] * 5
        fps = [right.column(w).take(pa.array(r, pa.int64())) for w in _FP]
        return pa.table([pa.array(k, pa.int64()) for k in keys] + fps + [pa.array(data, pa.binary())], ["g", "a", "b", "node", *_FP, "text"])

    shape = "g long, a long, b long, node long, " + ", ".join(f"{w} long" for w in _FP) + ", text binary"
    sent = packs.groupBy("b").cogroup(wanted.groupBy("b")).applyInArrow(cut, shape)
    sent = sent.repartition("g", "a", "b").sortWithinPartitions("g", "a", "b", "node")

    def decided(nodes: list[int], fps: list[tuple], texts: list[bytes]) -> Iterator[tuple[int, int]]:
        sets, root = list(sets_of(texts)), list(range(len(nodes)))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = i = root[root[i]]
            return i

        words = np.array(fps, np.int64).view(np.uint64).reshape(len(nodes), -1)
        for left, right in close_pairs(words, np.array([len(nodes)]), RADIUS):
            for i, j in zip(left.tolist(), right.tolist()):
                x, y = find(i), find(j)
                if x != y and similar(sets[i], sets[j]):
                    root[y] = x
                    yield nodes[i], nodes[j]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nodes, fps, texts = None, [], [], []

        def close() -> pa.RecordBatch:
            u, v = list(zip(*decided(nodes, fps, texts))) or ((), ())
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns[:-1]]
            for *k, node, w0, w1, w2, w3, text in zip(*columns, batch.column(batch.num_columns - 1)):
                if k != key:
                    if len(nodes) > 1:
                        yield close()
                    key, nodes, fps, texts = k, [], [], []
                nodes.append(node)
                fps.append((w0, w1, w2, w3))
                texts.append(text.as_py())
        if len(nodes) > 1:
            yield close()

    return checkpointed(sent.mapInArrow(run, "u long, v long"))


def near_links(texts: DataFrame) -> DataFrame:
    """(u, v): v is the smallest node that u is connected to by similar texts; nodes without links have no row.

    ``texts``: _node, text.  The tables of shared shingles and of equal sets are written out, so that the joins
    with them read plain exchanges and a shingle or a set that very many texts have is split there.
    """
    all_ = sketches(texts)
    equal = stored(all_.groupBy("d1", "d2").agg(F.min("node").alias("v"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"))
    copies = stored(all_.select("node", "d1", "d2").join(equal, ["d1", "d2"]).filter("node <> v").select(F.col("node").alias("u"), "v"))
    reps = all_ if copies.isEmpty() else stored(all_.join(copies.select(F.col("u").alias("node")), "node", "left_anti"))
    shingles = reps.select("node", F.explode("prefix").alias("key"))
    shared = stored(shingles.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"))
    together = stored(shingles.join(shared, "key"))
    prints = reps.select("node", *_FP)
    close = components(compared(together.join(prints, "node").select(F.lit(0).alias("t"), "key", "node", *_FP), RADIUS, BUCKET_CHUNK))
    groups = close.select(F.col("u").alias("node"), F.col("v").alias("g")).unionByName(close.select(F.col("v").alias("node"), F.col("v").alias("g")).distinct())
    links = verified(stored(groups.join(prints, "node")), texts)
    return components(links.unionByName(copies))


def near_deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each set of texts that similar texts connect, with all columns of ``docs``, whatever their names.

    The row of the smallest id stays (null last, then by row key).  Null counts as empty, and texts without words are
    alike; repeated rows are texts like others.  An empty table gives no rows.  ``docs`` that is no file table is
    written out first, so that its rows keep their keys.
    """
    docs = file_table(docs)
    links = near_links(with_node(docs, F.col(text_col).alias("text")))
    members = links.select(F.col("u").alias("_node"), "v").unionByName(links.select(F.col("v").alias("_node"), "v").distinct())
    own = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("_rk").alias("rk"))
    rows = stored(with_node(docs, F.col(id_col).alias("id")).join(members, "_node").select("v", own.alias("row")))
    first = stored(rows.groupBy("v").agg(F.min("row").alias("first")))
    gone = rows.join(first, "v").filter("row.rk <> first.rk").select(F.col("row.rk").alias("_rk"))
    return only(docs, gone, "left_anti")
