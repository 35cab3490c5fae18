"""SimHash near-dedup with bit-sliced comparison.

A fingerprint has 64 bits over hashed 4-word shingles.  Two fingerprints within ``RADIUS`` bits agree
in at least one of RADIUS + 1 bands (or in one of the larger sets of bands used for large tables), so only
buckets of an equal band are compared, in full.  In a task the fingerprints of many buckets stand in
sorted order as bit planes: word w of plane b holds bit b of 64 neighbours.  Shifting all planes by d lanes
sets every fingerprint against its d-th successor, and carry-save counters, themselves bit planes, add up
the differing bits of 64 pairs at a time; words whose lanes have all gone beyond the radius are dropped
between steps.  A bucket too large for one task is cut into chunks, and each pair of chunks is a task's work.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotwise.llm.common import checkpointed, file_table, only, table, with_row_key

RADIUS, SHINGLE, HASH_SEED = 4, 4, 42
#: Buckets of more fingerprints are compared chunk by chunk.
CHUNK = 8192
#: Edges that a task contracts at once.
HELD_EDGES = 1 << 20


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Null and wordless texts give 0; fewer words than a shingle make one shingle of all of them."""
    words = (text or "").encode().lower().split()  # bytes: A-Z and the six ASCII white-space bytes only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = (ends - np.fromiter(map(len, words), np.int64, len(words)) - 1).tolist()
    n = max(1, len(words) - shingle + 1)
    ends = (ends - 1)[min(shingle, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    counts, step = np.zeros(64, np.int64), 1 << 16
    for k in range(0, n, step):
        h = np.array([digest(joined[a:b], HASH_SEED) for a, b in zip(starts[k : k + step], ends[k : k + step])], dtype="<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, _rk, fp): fp holds the 64 bits as a signed long."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(x.as_py()) for x in batch.column(3)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(fps.view(np.int64))], ["_id", "_f", "_i", "fp"])

    rows = with_row_key(docs.select(*dict.fromkeys([id_col, text_col])))
    rows = rows.select(F.col(id_col).alias("_id"), F.col("_rk.f").alias("_f"), F.col("_rk.i").alias("_i"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"_id {kind}, _f long, _i long, fp long")


# -- bit-sliced comparison of buckets ---------------------------------------------------------------


def _planes(fps: np.ndarray, spare: int) -> np.ndarray:
    """One plane of packed lanes a bit, with ``spare`` empty words behind; ``fps`` has a row of 64-bit words a fingerprint."""
    lanes, width = -(-len(fps) // 64) * 64, 8 * fps.shape[1]
    bits = np.zeros((lanes, width), np.uint8)
    bits[: len(fps)] = np.ascontiguousarray(fps).view(np.uint8).reshape(-1, width)
    planes = np.packbits(np.ascontiguousarray(np.unpackbits(bits, axis=1, bitorder="little").T), axis=1, bitorder="little").view("<u8")
    return np.concatenate([planes, np.zeros((len(planes), spare), "<u8")], axis=1)


def _add(counts: np.ndarray, over: np.ndarray, x: np.ndarray, level: int = 0) -> None:
    """Adds the planes of ``x`` (weight 2 ** level) to the counters by carry-save adders; what the highest carries sets ``over``.

    Two planes and the counter make one carry, so a level passes half as many planes to the next.
    """
    own, carries = counts[level], []
    for k in range(0, len(x) - 1, 2):
        half = x[k] ^ x[k + 1]
        carries.append((x[k] & x[k + 1]) | (own & half))
        own ^= half
    if len(x) % 2:
        carries.append(own & x[-1])
        own ^= x[-1]
    if level + 1 < len(counts):
        _add(counts, over, carries, level + 1)
    else:
        for carry in carries:
            over |= carry


def _beyond(counts: np.ndarray, over: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose count is over ``radius``: the bit planes compared with it from the highest on."""
    more, same = over.copy(), ~over
    for level in reversed(range(len(counts))):
        if radius >> level & 1:
            same &= counts[level]
        else:
            more |= same & counts[level]
            same &= ~counts[level]
    return more


def close_pairs(fps: np.ndarray, sizes: np.ndarray, radius: int = RADIUS, step: int = 16) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j) of all fingerprints within ``radius`` in the same bucket.

    ``fps`` (uint64, a row of words each, or one word) holds the buckets one after another, largest first;
    ``sizes`` are their sizes.  So the lanes that still have a d-th successor in their bucket lie in a prefix
    that shrinks as d grows.
    """
    if not len(sizes) or sizes[0] < 2:
        return
    planes = _planes(fps.reshape(len(fps), -1), int(sizes[0]) // 64 + 2)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(fps)) - 1  # successors in the bucket
    ends = np.cumsum(sizes)
    for d in range(1, int(sizes[0])):
        lanes = int(ends[np.searchsorted(-sizes, -d, side="left") - 1])
        words, q, r = -(-lanes // 64), d // 64, np.uint64(d % 64)
        valid = np.zeros(words * 64, bool)
        valid[:lanes] = left[:lanes] >= d
        alive, at = np.packbits(valid, bitorder="little").view("<u8"), np.arange(words)
        counts, over = np.zeros((max(1, radius.bit_length()), words), "<u8"), np.zeros(words, "<u8")
        for b in range(0, len(planes), step):
            p = planes[b : b + step]
            x = p[:, at + q] >> r
            if r:
                x |= p[:, at + q + 1] << (np.uint64(64) - r)
            x ^= p[:, at]
            _add(counts, over, x)
            over = _beyond(counts, over, radius)
            alive = alive & ~over
            keep = np.flatnonzero(alive)
            if len(keep) < len(at):  # abandon words without a lane inside the radius
                alive, at, over, counts = alive[keep], at[keep], over[keep], counts[:, keep]
            if not len(at):
                break
        if len(at):
            hit = np.flatnonzero(np.unpackbits(alive.view(np.uint8), bitorder="little"))
            i = at[hit // 64] * 64 + hit % 64
            yield i, i + d


def _joined(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``root`` with the sets of i and j united; the smallest index is a set's root."""
    while True:
        a, b = root[i], root[j]
        differ = a != b
        if not differ.any():
            return root
        a, b = a[differ], b[differ]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


def bucket_links(nodes: np.ndarray, fps: np.ndarray, sizes: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Every node that is linked in its bucket, with the first one of what it is connected to there."""
    order = np.argsort(-sizes, kind="stable")
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])[order]
    sizes = sizes[order]
    place = np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(int(sizes.sum()))
    nodes, fps = nodes[place], fps[place]
    root = np.arange(len(fps))
    for i, j in close_pairs(fps, sizes, radius):
        root = _joined(root, i, j)
    linked = np.flatnonzero(root != np.arange(len(fps)))
    return nodes[linked], nodes[root[linked]]


# -- the distributed part ---------------------------------------------------------------------------


def band_sets(n: int, radius: int = RADIUS, most: int = 1 << 12) -> list[list[tuple[int, int]]]:
    """Sets of (offset, width) such that fingerprints within ``radius`` agree in all bands of one set.

    Of radius + k bands at least k agree.  k is the smallest that leaves ``most`` random fingerprints a bucket
    at most, or 4.
    """
    for k in range(1, 5):
        bands, cuts = radius + k, [64 * i // (radius + k) for i in range(radius + k + 1)]
        if n >> (64 * k // bands) <= most or k == 4:
            return [[(cuts[i], cuts[i + 1] - cuts[i]) for i in chosen] for chosen in itertools.combinations(range(bands), k)]
    raise AssertionError


def links(distinct: DataFrame, n: int, radius: int = RADIUS, chunk: int = CHUNK) -> DataFrame:
    """(u, v): links between different fingerprints that connect all that lie within ``radius``; no link is lost."""
    keys = []
    for t, bands in enumerate(band_sets(n, radius)):
        key, width = F.lit(0).cast("long"), 0
        for offset, bits in bands:
            key, width = key + F.shiftleft(F.shiftrightunsigned("fp", offset).bitwiseAND((1 << bits) - 1), width), width + bits
        keys.append(F.struct(F.lit(t).alias("t"), key.alias("key")))
    keyed = distinct.select("fp", F.explode(F.array(*keys)).alias("k"))
    return compared(keyed.select("k.t", "k.key", F.col("fp").alias("node"), F.col("fp").alias("w0")), radius, chunk)


def compared(keyed: DataFrame, radius: int, chunk: int = CHUNK) -> DataFrame:
    """(u, v): links that connect all nodes of a bucket (t, key) whose fingerprints lie within ``radius``.

    ``keyed`` has t, key, node and the words of the fingerprint, w0 and on.  Nodes of a bucket differ.
    """
    words = [c for c in keyed.columns if c not in ("t", "key", "node")]
    large = checkpointed(keyed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > chunk))
    one = F.array(F.struct(F.lit(0).alias("a"), F.lit(0).alias("b")))
    if large.isEmpty():
        keyed = keyed.withColumn("c", one[0])
    else:
        keyed = keyed.join(large, ["t", "key"], "left")
        chunks = F.ceil(F.col("n") / chunk).cast("int")
        own = F.pmod(F.xxhash64("node"), chunks).cast("int")
        pairs = F.transform(F.sequence(F.lit(0), chunks - 1), lambda c: F.struct(F.least(c, own).alias("a"), F.greatest(c, own).alias("b")))
        keyed = keyed.withColumn("c", F.explode(F.when(F.col("n").isNull(), one).otherwise(pairs)))
    dealt = keyed.select("t", "key", "c.a", "c.b", "node", *words).repartition("t", "key", "a", "b").sortWithinPartitions("t", "key", "a", "b")
    block = 1 << 18 >> len(words).bit_length() - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def linked(k: np.ndarray) -> pa.RecordBatch:
            starts = np.flatnonzero(np.concatenate([[True], (k[1:, :4] != k[:-1, :4]).any(axis=1)]))
            fps = np.ascontiguousarray(k[:, 5:]).view(np.uint64)
            u, v = bucket_links(k[:, 4], fps, np.diff(np.append(starts, len(fps))), radius)
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

        held: list[np.ndarray] = []
        rows = 0
        for batch in batches:
            part = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], axis=1)
            held.append(part)
            rows += len(part)
            if rows >= block:
                k = np.concatenate(held)
                # The last bucket may go on in the next batch.
                cut = int(np.flatnonzero((k[:, :4] != k[-1, :4]).any(axis=1))[-1:].sum() + (k[:, :4] != k[-1, :4]).any())
                if cut:
                    yield linked(k[:cut])
                held, rows = [k[cut:]], len(k) - cut
        if rows:
            yield linked(np.concatenate(held))

    return dealt.mapInArrow(run, "u long, v long")


def contracted(edges: DataFrame) -> DataFrame:
    """(u, v, part): the edges of a task, some at a time, as stars around the smallest node of what they connect."""

    most = HELD_EDGES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        task, part = TaskContext.get().partitionId(), 0

        def stars() -> pa.RecordBatch:
            nodes, at = np.unique(np.concatenate(held), return_inverse=True)
            at = at.reshape(-1, 2)
            root = _joined(np.arange(len(nodes)), at[:, 0], at[:, 1])
            linked = np.flatnonzero(root != np.arange(len(nodes)))
            return pa.RecordBatch.from_arrays([pa.array(nodes[linked]), pa.array(nodes[root[linked]]), pa.array(np.full(len(linked), task << 32 | part, np.int64))], ["u", "v", "part"])

        for batch in batches:
            held.append(np.stack([c.to_numpy() for c in batch.columns], axis=1))
            if sum(map(len, held)) >= most:
                yield stars()
                held, part = [], part + 1
        if held:
            yield stars()

    return edges.select("u", "v").mapInArrow(run, "u long, v long, part long")


def components(edges: DataFrame) -> DataFrame:
    """(u, v): v is the smallest node of u's component, for every node but that one.

    Every task first makes stars of what its edges connect, HELD_EDGES of them at a time; then tasks that hold so many
    each do it again with what is left.  Where one such task does, that is the result.
    Else alternating large and small stars go on: a large star links a node's larger neighbours to its smallest one,
    a small star the node and its smaller neighbours; both keep the components, and in the end every edge leads to
    the smallest node.  The smallest neighbours are combined before the shuffle and kept as a table, so the joins
    with them read plain exchanges and a hub with very many edges is split there.
    """

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    stars = checkpointed(contracted(edges.filter("u <> v").repartition("u")))
    tasks = -(-stars.count() // HELD_EDGES)
    stars = checkpointed(contracted(stars.coalesce(max(1, tasks))))
    if tasks < 2 and stars.agg(F.max("part").bitwiseAND(0xFFFFFFFF)).first()[0] in (None, 0):
        return stars.select("u", "v")
    edges = checkpointed(stars.select("u", "v").distinct())
    before = mark(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = checkpointed(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = checkpointed(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = checkpointed(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = checkpointed(small.distinct())
        after = mark(edges)
        if after == before:
            break
        before = after
    return edges


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row per input row: _id, _rk, fp, component_id (smallest id reachable over links, null if none has an id), kept.

    ``kept`` holds for one row of each component: the one of the smallest id (null last, then by row key).
    Null, empty and wordless texts all have fingerprint 0.  Rows with equal ids are separate rows.  An empty
    table gives no rows; other columns are ignored.  ``docs`` that is no file table is written out first, so
    that its rows keep their keys.
    """
    rows = checkpointed(fingerprints(file_table(docs), id_col, text_col))
    least = F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_f").alias("f"), F.col("_i").alias("i"))
    distinct = checkpointed(rows.groupBy("fp").agg(F.min(least).alias("least")))
    to = components(links(distinct.select("fp"), distinct.count(), radius))
    # Only fingerprints with links go through the joins by component; the tables joined are plain files, so a large
    # component is split there.
    joint = checkpointed(to.select(F.col("u").alias("fp"), "v").unionByName(to.select(F.col("v").alias("fp"), "v").distinct()))
    firsts = checkpointed(joint.join(distinct, "fp").groupBy("v").agg(F.min("least").alias("first")))
    placed = joint.join(firsts, "v").select("fp", "first")
    placed = checkpointed(distinct.join(placed, "fp", "left").select("fp", F.coalesce("first", "least").alias("first")))
    out = rows.join(placed, "fp")
    kept = (F.col("_f") == F.col("first.f")) & (F.col("_i") == F.col("first.i"))
    return out.select("_id", F.struct(F.col("_f").alias("f"), F.col("_i").alias("i")).alias("_rk"), "fp", F.col("first.id").alias("component_id"), kept.alias("kept"))


def near_deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row of each component, with all columns of ``docs`` as they are, whatever their names."""
    docs = file_table(docs)
    return only(docs, near_groups(docs, id_col, text_col, radius).filter("kept").select("_rk"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_groups(table(spark, sf_dir, "documents"))
    return groups.select(F.col("_id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
