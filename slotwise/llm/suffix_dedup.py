"""Removal of long repeated passages by a logarithmic family of suffix arrays.

A passage is a string of ``LENGTH`` bytes that starts at two places at least.  Each window of that length
is owned by an anchor, the place among its first ``REACH`` whose 16 bytes hash lowest; equal windows have
their anchors at equal offsets.  A run of windows with one anchor, and the bytes they cover, is a context.

1. Per anchor, the bytes that all its windows share are hashed to a fingerprint.  Contexts whose
   fingerprint comes once hold no passage.
2. The others come with their bytes, by fingerprint, to tasks that keep a family of index levels; equal contexts
   come once with a mark, and are entered twice.  A new batch of contexts gets suffix arrays at its anchors, one of
   the strings from the anchors on, one of those before them read backwards.  It is merge-scanned against each
   level: lengths of common prefixes of neighbours tell for every window which other ones are equal, byte by byte.
   Then the batch becomes a level, and levels of about equal size are merged, so there are few of them.
   The number of tasks grows with the contexts, so a task's index is of bounded size.
   Where very many contexts have one fingerprint, as in a large group of near copies, each is cut into
   parts of BAND window starts, counted from the anchor.  A part's windows share more bytes, whose hash
   deals the parts out, so equal windows still meet and the group spreads over many tasks.
3. The windows found go back to all occurrences of their contexts, and to the documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotwise.llm.common import bucket_count, file_table, packed, stored, table, unpacked, with_row_key

LENGTH, REACH, GRAM = 400, 256, 16
#: Contexts in a batch of the index; contexts of one fingerprint from which they are split, and window starts in a part.
BATCH, HOT, BAND = 4096, 512, 32
#: Contexts in a task's index, about.
TASK_CONTEXTS = 1 << 15
#: Odd multipliers of the hashes, and the seed of their byte table.
_A, _B, _C, _SEED = (np.uint64(v) for v in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 7))
_table = np.random.default_rng(int(_SEED)).integers(0, 2**63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of both multipliers and of their inverses, at least n of each."""
    if not _powers or len(_powers[0]) < n:
        n = max(n, 1 << 16, 2 * len(_powers[0]) if _powers else 0)
        _powers[:] = []
        for base in (int(_A), int(_B), pow(int(_A), -1, 2**64), pow(int(_B), -1, 2**64)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _powers.append(np.cumprod(p, dtype=np.uint64))
    return _powers


def _stir(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _C
    return h ^ (h >> np.uint64(32))


def contexts(text: bytes, length: int = LENGTH, reach: int = REACH) -> tuple[np.ndarray, ...]:
    """fp, c1, c2, anchor, first and last window start of every context of a text; empty for shorter texts."""
    n, m = len(text), len(text) - length + reach
    if n < length:
        return (np.zeros(0, np.uint64),) * 3 + (np.zeros(0, np.int64),) * 3
    b = np.frombuffer(text, np.uint8)
    eights = np.lib.stride_tricks.as_strided(np.frombuffer(text + bytes(8), np.uint8)[:8].view("<u8"), shape=(n,), strides=(1,))
    h = _stir(eights[:m] * _A + np.roll(_stir(eights[: m + 8] * _B), -8)[:m])
    # The hash's upper half and the place, so that of equal hashes the first place is lowest.
    keys = np.full(-(-m // reach) * reach, ~np.uint64(0))
    keys[:m] = (h >> np.uint64(32) << np.uint64(32)) | np.arange(m, dtype=np.uint64)
    keys = keys.reshape(-1, reach)
    ahead = np.minimum.accumulate(keys, axis=1).ravel()
    behind = np.minimum.accumulate(keys[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = n - length + 1
    owner = (np.minimum(behind[:windows], ahead[reach - 1 : reach - 1 + windows]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    last = np.append(first[1:], windows) - 1
    x = owner[first]
    pa_, pb, ia, ib = _power_tables(n)
    sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(t[b] * p[:n], dtype=np.uint64)]) for t, p in zip(_table, (pa_, pb))]
    fp = _stir((sums[0][x + length - reach + 1] - sums[0][x]) * ia[x])
    c1 = _stir((sums[0][last + length] - sums[0][first]) * ia[first] + (last - first).astype(np.uint64) * _C)
    c2 = _stir((sums[1][last + length] - sums[1][first]) * ib[first] + (x - first).astype(np.uint64) * _C)
    return fp, c1, c2, x, first, last


# -- the index of a task ----------------------------------------------------------------------------


class Level:
    """Contexts as rows: bytes from the anchor on, bytes before it backwards, and the orders of both."""

    def __init__(self, ids: np.ndarray, on: np.ndarray, back: np.ndarray, low: np.ndarray, high: np.ndarray):
        self.ids, self.on, self.back, self.low, self.high = ids, on, back, low, high  # windows begin low to high bytes before the anchor
        self.by_on, self.by_back = _order(on), _order(back)


def _strings(rows: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").ravel()


def _order(rows: np.ndarray) -> np.ndarray:
    return np.argsort(_strings(rows), kind="stable")


def _common(rows: np.ndarray) -> np.ndarray:
    """Lengths of the common prefixes of neighbours."""
    differ = rows[1:] != rows[:-1]
    return np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])


def _merged(a: Level, b: Level) -> Level:
    """Both levels as one; their sorted orders are merged, not sorted anew."""
    out = Level.__new__(Level)
    out.ids, out.on, out.back, out.low, out.high = (np.concatenate([getattr(a, n), getattr(b, n)]) for n in ("ids", "on", "back", "low", "high"))
    for name, rows in (("by_on", out.on), ("by_back", out.back)):
        runs = np.concatenate([getattr(a, name), getattr(b, name) + len(a.ids)])
        setattr(out, name, runs[np.argsort(_strings(rows[runs]), kind="stable")])  # merges the two runs it finds
    return out


def equal_windows(level: Level, length: int) -> Iterator[tuple[int, np.ndarray]]:
    """(o, rows): contexts whose window that begins o bytes before the anchor equals another one's.

    Two such windows are equal if length - o bytes from the anchor on and o before it are.
    """
    on, back = np.zeros(len(level.ids), np.int64), np.zeros(len(level.ids), np.int64)
    common_on, common_back = _common(level.on[level.by_on]), _common(level.back[level.by_back])
    for o in range(int(level.low.min()), int(level.high.max()) + 1):
        rows = np.flatnonzero((level.low <= o) & (level.high >= o))
        if len(rows) < 2:
            continue
        on[level.by_on[1:]] = np.cumsum(common_on < length - o)
        back[level.by_back[1:]] = np.cumsum(common_back < o)
        on[level.by_on[0]] = back[level.by_back[0]] = 0
        group = on[rows] * len(level.ids) + back[rows]
        order = np.argsort(group, kind="stable")
        same = group[order][1:] == group[order][:-1]
        yield o, rows[order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]]


class LevelledIndex:
    """A family of levels, each at least twice as large as the next, and the windows found so far."""

    def __init__(self, length: int = LENGTH, reach: int = REACH):
        self.length, self.reach, self.levels = length, reach, []
        self.found = np.zeros((0, reach), bool)

    def add(self, items: list[tuple[bytes, int, int]]) -> None:
        """A batch of (bytes, anchor, windows): the windows begin at 0 to windows - 1."""
        m, start = len(items), len(self.found)
        self.found = np.concatenate([self.found, np.zeros((m, self.reach), bool)])
        on, back = np.zeros((m, self.length), np.uint8), np.zeros((m, max(1, self.reach - 1)), np.uint8)
        for i, (data, x, _) in enumerate(items):
            a = np.frombuffer(data, np.uint8)
            on[i, : min(self.length, len(a) - x)] = a[x : x + self.length]
            back[i, :x] = a[:x][::-1]
        anchors, windows = np.array([x for _, x, _ in items]), np.array([w for _, _, w in items])
        new = Level(np.arange(start, start + m), on, back, anchors - windows + 1, anchors)
        self._mark(new)
        for level in self.levels:
            self._mark(_merged(level, new))
        while self.levels and len(self.levels[-1].ids) < 2 * len(new.ids):
            new = _merged(self.levels.pop(), new)
        self.levels.append(new)

    def _mark(self, level: Level) -> None:
        for o, rows in equal_windows(level, self.length):
            self.found[level.ids[rows], level.high[rows] - o] = True


# -- the distributed part ---------------------------------------------------------------------------

_CONTEXT = "c1 long, c2 long, f long, i long, p long"


def _place(x: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """First window, anchor less first window, and last less first window, in one long."""
    return first << 20 | (x - first) << 10 | (last - first)


def _occurrences(rows: DataFrame, length: int, reach: int, distinct: bool) -> DataFrame:
    """All contexts, or with ``distinct`` (fp, context, n) once per Arrow batch with their number there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fs, numbers = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            found = []
            for f, i, text in zip(fs, numbers, batch.column(2)):
                fp, c1, c2, x, first, last = contexts((text.as_py() or "").encode(), length, reach)
                if len(fp):
                    found.append((fp.view(np.int64), c1.view(np.int64), c2.view(np.int64), np.full(len(fp), f), np.full(len(fp), i), _place(x, first, last)))
            if not found:
                continue
            fp, c1, c2, f, i, p = (np.concatenate(c) for c in zip(*found))
            if distinct:
                order = np.lexsort((c2, c1))
                head = np.flatnonzero(np.concatenate([[True], (c1[order][1:] != c1[order][:-1]) | (c2[order][1:] != c2[order][:-1])]))
                n, at = np.diff(np.append(head, len(order))), order[head]
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in (fp[at], c1[at], c2[at], f[at], i[at], p[at], n)], ["fp", "c1", "c2", "f", "i", "p", "n"])
            else:
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in (c1, c2, f, i, p)], ["c1", "c2", "f", "i", "p"])

    return rows.select("_rk.f", "_rk.i", "_text").mapInArrow(run, f"fp long, {_CONTEXT}, n long" if distinct else _CONTEXT)


def candidates(rows: DataFrame, length: int, reach: int) -> DataFrame:
    """(fp, context, n, k): contexts of fingerprints that come more than once; k contexts of one fingerprint differ.

    Both counts combine on the map side, and the join back can be split, so no fingerprint weighs on one task.
    """
    seen = _occurrences(rows, length, reach, True)
    merged = seen.groupBy("fp", "c1", "c2").agg(F.sum("n").alias("n"), *[F.first(c).alias(c) for c in ("f", "i", "p")])
    # The counts look at every column, so that both sides of the join read one and the same exchange.
    every = F.max(F.xxhash64("c1", "c2", "f", "i", "p"))
    of = merged.groupBy("fp").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("all"), every.alias("every"))
    of = of.filter((F.col("all") > 1) & F.col("every").isNotNull()).select("fp", "k")
    return merged.join(of, "fp")


def found_windows(known: DataFrame, packs: DataFrame, buckets: int, length: int, reach: int) -> DataFrame:
    """(c1, c2, lo, hi): runs of windows, from the context's first, that equal a window of this or another context."""
    wanted = known.select(F.pmod(F.xxhash64("f", "i"), F.lit(buckets)).cast("int").alias("b"), "fp", "c1", "c2", "f", "i", "p", "k", (F.col("n") > 1).cast("long").alias("again"))
    split = HOT
    entered = known.agg(F.sum(F.when(F.col("n") > 1, 2).otherwise(1))).first()[0] or 0

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        columns = {n: right.column(n).to_pylist() for n in ("fp", "c1", "c2", "f", "i", "p", "k", "again")}
        of: dict[tuple, list[int]] = {}
        for r, key in enumerate(zip(columns["f"], columns["i"])):
            of.setdefault(key, []).append(r)
        at, keys, places, data = [], [], [], []
        for f, i, _, text in unpacked(left) if right.num_rows else ():
            for r in of.get((f, i), ()):
                p = columns["p"][r]
                first, ahead, more = p >> 20, p >> 10 & 1023, p & 1023
                x, least = first + ahead, ahead - more  # windows begin least to ahead bytes before the anchor
                wide = columns["k"][r] <= split
                for band in [0] if wide else range(least // BAND, ahead // BAND + 1):
                    lo, hi = (least, ahead) if wide else (max(least, band * BAND), min(ahead, band * BAND + BAND - 1))
                    shared = b"" if wide else text[x - band * BAND : x - band * BAND - BAND + 1 + length]
                    at.append(r)
                    keys.append(columns["fp"][r] if wide else int.from_bytes(hashlib.blake2b(shared, digest_size=8, key=band.to_bytes(2, "little")).digest(), "little", signed=True))
                    places.append((ahead - hi) << 20 | hi << 10 | (hi - lo))
                    data.append(text[x - hi : x - lo + length])
        take = lambda n: pa.array([columns[n][r] for r in at], pa.int64())
        return pa.table({"fp": pa.array(keys, pa.int64()), "c1": take("c1"), "c2": take("c2"), "p": pa.array(places, pa.int64()), "again": take("again"), "data": pa.array(data, pa.binary())})

    cuts = packs.groupBy("b").cogroup(wanted.groupBy("b")).applyInArrow(cut, "fp long, c1 long, c2 long, p long, again long, data binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, names, held = LevelledIndex(length, reach), [], []
        for batch in batches:
            for c1, c2, p, again, data in zip(*(batch.column(k).to_pylist() for k in range(1, 5)), batch.column(5)):
                for copy in range(1 + again):
                    names.append((c1, c2, p >> 20, copy))
                    held.append((data.as_py(), p >> 10 & 1023, (p & 1023) + 1))
                if len(held) >= BATCH:
                    index.add(held)
                    held = []
        if held:
            index.add(held)
        if names:
            edge = np.diff(index.found.astype(np.int8), axis=1, prepend=0, append=0)
            row, lo = np.nonzero(edge == 1)
            _, hi = np.nonzero(edge == -1)
            key = np.array(names, np.int64)[row].reshape(-1, 4)
            first = key[:, 3] == 0  # the copy has the same windows
            key, lo, hi = key[first], lo[first], hi[first]
            yield pa.RecordBatch.from_arrays([pa.array(key[:, 0]), pa.array(key[:, 1]), pa.array(key[:, 2] + lo), pa.array(key[:, 2] + hi - 1)], ["c1", "c2", "lo", "hi"])

    return cuts.repartition(max(1, -(-entered // TASK_CONTEXTS)), "fp").mapInArrow(run, "c1 long, c2 long, lo long, hi long")


def spans_of(text: bytes, intervals: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal removed runs of a text: the union of half-open byte intervals; touching ones are one run."""
    out: list[list[int]] = []
    for lo, hi in sorted(intervals):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, reach: int = REACH, with_text: bool = False) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, spans[, kept]) of every row of ``docs``.

    Removed is each byte covered by a ``length``-byte string that also starts anywhere else in the table,
    in the same or another row, judged on the input.  Null texts count as empty; texts shorter than
    ``length`` keep all; repeated rows remove each other's passages.  An empty table gives no rows.  Texts go
    as bytes, so ``kept`` is binary: a cut may fall inside a character.
    """
    if not 0 < reach < 1024 or length - reach < GRAM:
        raise ValueError("reach must be under 1024 and leave 16 bytes of the length")
    docs = file_table(docs)
    rows = with_row_key(docs.select(*dict.fromkeys([id_col, text_col]))).select("_rk", F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = docs.schema[id_col].dataType.simpleString()
    buckets = bucket_count(rows, "_text")
    packs = packed(rows.select(F.col("_rk.f").alias("f"), F.col("_rk.i").alias("i"), "_id", "_text"), F.pmod(F.xxhash64("f", "i"), F.lit(buckets)))

    known = stored(candidates(rows, length, reach))
    verdicts = found_windows(known, packs, buckets, length, reach)
    at = F.shiftright("p", 20)
    hits = _occurrences(rows, length, reach, False).join(verdicts, ["c1", "c2"])
    hits = hits.select(F.pmod(F.xxhash64("f", "i"), F.lit(buckets)).cast("int").alias("b"), "f", "i", (at + F.col("lo")).alias("lo"), (at + F.col("hi") + length).alias("hi"))

    def remove(left: pa.Table, right: pa.Table) -> pa.Table:
        of: dict[tuple, list] = {}
        for f, i, lo, hi in zip(*(right.column(n).to_pylist() for n in ("f", "i", "lo", "hi"))):
            of.setdefault((f, i), []).append((lo, hi))
        rows: list[tuple] = []
        for f, i, doc, text in unpacked(left) if left.num_rows else ():
            spans = spans_of(text, of.get((f, i), []))
            edges = [0, *(e for s in spans for e in s), len(text)]
            kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
            rows.append((doc, len(text), len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), [{"lo": a, "hi": b} for a, b in spans], kept))
        columns = list(zip(*rows)) or [()] * 7
        return pa.table([pa.array(c, t) for c, t in zip(columns, types)], names)

    from pyspark.sql.pandas.types import to_arrow_type

    names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"] + ["kept"] * with_text
    types = [to_arrow_type(docs.schema[id_col].dataType), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))] + [pa.binary()] * with_text
    shape = f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<lo: long, hi: long>>" + ", kept binary" * with_text
    return packs.groupBy("b").cogroup(hits.groupBy("b")).applyInArrow(remove, shape)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeated_passages(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")
