"""Approximate nearest neighbours by an inverted multi-index over two vector halves.

Each half has its own codebook of k centroids, so k * k cells, one per centroid pair, hold the vectors.
A query's centroid pairs are visited in order of summed score, kept by a heap over the two sorted lists,
until the visited cells hold enough entries; these are ranked again by exact inner products.  How many are
enough is measured: some queries are answered by brute force over all rows, and the depth at which the
index would have found ``RECALL`` of their neighbours holds for all.

Cells are packed into buckets of about even size; a cell too large for one is spread over several.  A
query goes, with the score of its last visited cell, to the buckets that hold one of its cells; a task
holds one bucket and lets the queries stream past it.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from slotwise.llm.common import file_table, table

#: Centroids a half for K_ROWS rows (see ``centroids``) and at most, as the sample bears no more.
K, K_ROWS, MOST_K = 64, 10_000, 1024
#: Rows that the codebooks are fitted on, about; brute-force queries; recall they must reach.
SAMPLE_ROWS, TRIALS, RECALL = 20_000, 128, 0.96
#: Entries in a bucket where there are many, and buckets at least.
BUCKET_ROWS, LEAST_BUCKETS = 8192, 24
ROUNDS = 12


def centroids(rows: int) -> int:
    """Centroids a half: cells grow with the square root of the rows, and so do the rows of a cell."""
    return min(MOST_K, max(K, round(K * (rows / K_ROWS) ** 0.25)))


def codebook(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k-means by a fixed seed; empty clusters start anew at a data point."""
    rng = np.random.default_rng(seed)
    points = np.unique(x, axis=0)
    if len(points) <= k:
        return points
    c = points[rng.choice(len(points), k, replace=False)]
    for _ in range(ROUNDS):
        near = nearest(x, c)
        n = np.bincount(near, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], points[rng.choice(len(points), k)])
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c**2).sum(axis=1) - 2 * x @ c.T).argmin(axis=1)


@dataclass
class Index:
    first: np.ndarray
    second: np.ndarray
    counts: np.ndarray | None = None  # entries by (first, second)
    bucket: np.ndarray | None = None  # the cell's first bucket
    parts: np.ndarray | None = None  # over how many buckets it is spread
    depth: int = 0

    def cells(self, x: np.ndarray) -> np.ndarray:
        h = self.first.shape[1]
        return nearest(x[:, :h], self.first) * len(self.second) + nearest(x[:, h:], self.second)

    def halves(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A query's scores of the centroids of either half; no BLAS, so that every task gets the same bits."""
        h = self.first.shape[1]
        return (self.first * q[:h]).sum(axis=1), (self.second * q[h:]).sum(axis=1)

    def traverse(self, q: np.ndarray) -> Iterator[tuple[float, int, int]]:
        """Centroid pairs by falling summed score: a pair is pushed once both pairs before it were popped."""
        a, b = self.halves(q)
        i, j = np.argsort(-a, kind="stable").tolist(), np.argsort(-b, kind="stable").tolist()
        x, y = a[i].tolist(), b[j].tolist()
        heap, popped = [(-(x[0] + y[0]), 0, 0)], [0] * len(i)  # popped: how many pairs of each row
        while heap:
            s, u, v = heapq.heappop(heap)
            yield -s, i[u], j[v]
            popped[u] = v + 1
            if v + 1 < len(y) and (u == 0 or popped[u - 1] > v + 1):
                heapq.heappush(heap, (-(x[u] + y[v + 1]), u, v + 1))
            if u + 1 < len(x) and popped[u + 1] == v:
                heapq.heappush(heap, (-(x[u + 1] + y[v]), u + 1, v))

    def visit(self, q: np.ndarray) -> tuple[float, list[int]]:
        """Score of the last visited cell, and the visited cells that hold entries."""
        seen, cells, counts, last = 0, [], self.counts, math.inf
        for last, i, j in self.traverse(q):
            n = counts[i, j]
            if n:
                seen += n
                cells.append(i * len(self.second) + j)
            if seen >= self.depth:
                break
        return last, cells

    def lay_out(self, rows: int) -> None:
        """Packs cells in order into buckets; neighbours by the first half come together."""
        many = max(LEAST_BUCKETS, -(-rows // BUCKET_ROWS))
        most = max(1, -(-rows // many))
        at, room = 0, most
        flat = self.counts.ravel()
        self.bucket, self.parts = np.zeros(len(flat), np.int64), np.ones(len(flat), np.int64)
        for cell in np.flatnonzero(flat):
            n = int(flat[cell])
            if n > most:  # buckets of its own
                at, room = at + (room < most), most
                self.bucket[cell], self.parts[cell] = at, -(-n // most)
                at += int(self.parts[cell])
                continue
            if n > room:
                at, room = at + 1, most
            self.bucket[cell] = at
            room -= n


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, row, draw, v) of a file table's rows but those with null, zero and non-finite vectors or without an id.

    ``row`` names the row, so repeated ids and equal rows all stay; ``draw`` is a hash that picks samples.
    """
    v = F.col("v")
    key = F.xxhash64("_metadata.file_path", "_metadata.row_index")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), key.alias("row"), F.xxhash64(F.col(id_col).cast("long"), "_metadata.row_index").alias("draw"), F.col(vector_col).cast("array<double>").alias("v"))
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf)) & F.exists(v, lambda x: x != 0)
    return rows.filter(F.col("id").isNotNull() & v.isNotNull() & good)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(column), -1)


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, max(1, x.shape[1])), pa.int32()), pa.array(x.ravel()))


def exact(q: np.ndarray, v: np.ndarray) -> float:
    """The correctly rounded inner product."""
    return math.fsum((q * v).tolist())


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k largest, and of all within rounding of the last of them."""
    if len(scores) <= k:
        return np.arange(len(scores))
    last = np.partition(scores, len(scores) - k)[len(scores) - k]
    return np.flatnonzero(scores >= last - 1e-9 * max(1.0, abs(last)))


def fit(rows: DataFrame, n: int, k: int, neighbours: int) -> Index:
    """The index without entries: codebooks from a sample, cell counts over all ``n`` rows, depth from brute-force queries.

    The sample is drawn by a hash, each row with the same chance, so no task and not the driver holds more than it.
    """
    drawn = rows if n <= SAMPLE_ROWS else rows.filter(F.shiftrightunsigned("draw", 1) < int(SAMPLE_ROWS / n * (1 << 63)))
    sample = sorted((r["draw"], r["id"], r["row"], r["v"]) for r in drawn.collect()) or [tuple(r) for r in rows.select("draw", "id", "row", "v").limit(1).collect()]
    x = np.array([r[3] for r in sample])
    h = x.shape[1] // 2
    index = Index(codebook(x[:, :h], k, 1), codebook(x[:, h:], k, 2))
    spark = rows.sparkSession

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(index.first) * len(index.second), np.int64)
        for b in batches:
            if b.num_rows:
                total += np.bincount(index.cells(_matrix(b.column(0))), minlength=len(total))
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total[cells])], ["cell", "n"])

    counts = np.zeros(len(index.first) * len(index.second), np.int64)
    for r in rows.select("v").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        counts[r["cell"]] = r["n"]
    index.counts = counts.reshape(len(index.first), len(index.second))

    trials = spark.sparkContext.broadcast((np.array([r[2] for r in sample[:TRIALS]]), x[:TRIALS]))

    def brute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, q = trials.value
        for b in batches:
            own, v = b.column(0).to_numpy(), _matrix(b.column(1)) if b.num_rows else np.zeros((0, q.shape[1]))
            if not len(own):
                continue
            cells, scores = index.cells(v), q @ v.T
            scores[asked[:, None] == own[None, :]] = -np.inf
            top = np.argsort(-scores, axis=1, kind="stable")[:, :neighbours]
            t = np.repeat(np.arange(len(asked)), top.shape[1])
            s = np.take_along_axis(scores, top, 1).ravel()
            keep = np.isfinite(s)
            yield pa.RecordBatch.from_arrays([pa.array(t[keep]), pa.array(s[keep]), pa.array(cells[top.ravel()][keep])], ["t", "s", "cell"])

    found = rows.select("row", "v").mapInArrow(brute, "t long, s double, cell long")
    found = found.withColumn("r", F.row_number().over(W.partitionBy("t").orderBy(F.desc("s")))).filter(F.col("r") <= neighbours)
    wanted: dict[int, list[int]] = {}
    for r in found.select("t", "cell").collect():
        wanted.setdefault(r["t"], []).append(r["cell"])
    needed: list[int] = []
    for t, cells in wanted.items():
        seen, left = 0, {c: cells.count(c) for c in set(cells)}
        for _, i, j in index.traverse(x[t]):
            seen += int(index.counts[i, j])
            needed += [seen] * left.pop(i * len(index.second) + j, 0)
            if not left:
                break
    index.depth = max(int(np.quantile(needed, RECALL, method="higher")) if needed else n, neighbours + 1)
    index.lay_out(n)
    return index


def search(vectors: DataFrame, is_query, neighbours: int, id_col: str = "vec_id", vector_col: str = "embedding", k: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score, query_row): the nearest found of every query row by largest inner product, ties to the smaller id.

    ``is_query`` is a condition on ``id``; ``k`` centroids a half, else as ``centroids`` says.  Every row but
    the query's own is a candidate, rows of the same id and equal rows as well; several query rows of one id
    are told apart by ``query_row``, a number of the row in its file table.  Vectors of different lengths
    have no inner product, so each length is searched by itself, with an index of its own.  See ``usable``
    for rows that take no part; tables without usable rows give none.  Fewer candidates than ``neighbours``
    are all returned.
    """
    rows = usable(file_table(vectors), id_col, vector_col)
    sizes = sorted((r["n"], r["count"]) for r in rows.groupBy(F.size("v").alias("n")).count().collect())
    found = [_search(rows.filter(F.size("v") == size), n, is_query, neighbours, k or centroids(n)) for size, n in sizes]
    if not found:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double, query_row long")
    return reduce(DataFrame.unionAll, found)


def _search(rows: DataFrame, n: int, is_query, neighbours: int, k: int) -> DataFrame:
    """``search`` over the ``n`` usable rows of one length."""
    index = fit(rows, n, k, neighbours)
    sent = rows.sparkSession.sparkContext.broadcast(index)

    names = ["bucket", "kind", "id", "row", "v", "cell", "least"]

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = sent.value
        for b in batches:
            if b.num_rows:
                own, v = b.column(1).to_numpy(), _matrix(b.column(2))
                cell = ix.cells(v)
                yield pa.RecordBatch.from_arrays([pa.array(ix.bucket[cell] + own % ix.parts[cell]), pa.array(np.zeros(len(own), np.int32)), *b.columns, pa.array(cell), pa.array(np.zeros(len(own)))], names)

    def queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = sent.value
        for b in batches:
            for part in (b.slice(i, 256) for i in range(0, b.num_rows, 256)):
                v, at, least, to = _matrix(part.column(2)), [], [], []
                for i, q in enumerate(v):
                    last, cells = ix.visit(q)
                    cells = np.array(cells, np.int64)
                    one = [np.unique(ix.bucket[cells[ix.parts[cells] == 1]])] + [ix.bucket[c] + np.arange(ix.parts[c]) for c in cells[ix.parts[cells] > 1]]
                    one = np.concatenate(one)
                    to.append(one)
                    at.append(np.full(len(one), i))
                    least.append(np.full(len(one), last))
                to, at, least = np.concatenate(to), np.concatenate(at), np.concatenate(least)
                m = len(to)
                yield pa.RecordBatch.from_arrays([pa.array(to), pa.array(np.ones(m, np.int32)), part.column(0).take(pa.array(at)), part.column(1).take(pa.array(at)), _lists(v[at]), pa.array(np.zeros(m, np.int64)), pa.array(least)], names)

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = sent.value
        now, parts, held = None, [], None

        def close() -> tuple:
            """The bucket as distinct vectors by cell; of equal vectors the smallest ids suffice."""
            none = np.zeros(0, np.int64)
            ids, own, v, cell = (np.concatenate(c) for c in zip(*parts)) if parts else (none, none, np.zeros((0, 1)), none)
            order = np.lexsort((own, ids))
            distinct: dict[bytes, int] = {}
            members: list[list[tuple[int, int]]] = []
            rows = []
            for r in order.tolist():
                key = v[r].tobytes()
                at = distinct.setdefault(key, len(members))
                if at == len(members):
                    members.append([])
                    rows.append(r)
                if len(members[at]) <= neighbours:
                    members[at].append((int(ids[r]), int(own[r])))
            cell = cell[rows]
            by = np.argsort(cell, kind="stable")
            return v[rows][by], [members[i] for i in by], cell[by]

        def answer(qid: np.ndarray, qrow: np.ndarray, q: np.ndarray, least: np.ndarray) -> pa.RecordBatch:
            v, members, cell = held
            out: list[tuple[int, int, int, int, float]] = []
            if len(v):
                cells, inverse = np.unique(cell, return_inverse=True)
                i, j = cells // len(ix.second), cells % len(ix.second)
                scores = q @ v.T
                for r in range(len(q)):
                    a, b = ix.halves(q[r])
                    inside = np.flatnonzero((a[i] + b[j] >= least[r])[inverse])
                    near = inside[_best(scores[r, inside], neighbours + 1)]
                    found = sorted((-exact(q[r], v[c]), *m) for c in near for m in members[c] if m[1] != qrow[r])[:neighbours]
                    out += [(int(qid[r]), int(qrow[r]), m, row, -s) for s, m, row in found]
            columns = list(zip(*out)) or [()] * 5
            kinds = [pa.int64()] * 4 + [pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["query_id", "query_row", "vec_id", "row", "score"])

        for b in batches:
            bucket, kind = b.column(0).to_numpy(), b.column(1).to_numpy()
            ids, own, v, cell, least = b.column(2).to_numpy(), b.column(3).to_numpy(), _matrix(b.column(4)) if b.num_rows else None, b.column(5).to_numpy(), b.column(6).to_numpy()
            edges = np.flatnonzero(np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (kind[1:] != kind[:-1]), [True]])) if b.num_rows else []
            for lo, hi in zip(edges, edges[1:]):
                if bucket[lo] != now:
                    now, parts, held = bucket[lo], [], None
                if kind[lo] == 0:
                    parts.append((ids[lo:hi], own[lo:hi], v[lo:hi], cell[lo:hi]))
                else:
                    held = held or close()
                    for part in (slice(i, min(hi, i + 1024)) for i in range(lo, hi, 1024)):
                        yield answer(ids[part], own[part], v[part], least[part])

    shape = "bucket long, kind int, id long, row long, v array<double>, cell long, least double"
    rows = rows.select("id", "row", "v")
    both = rows.mapInArrow(entries, shape).unionByName(rows.filter(is_query).mapInArrow(queries, shape))
    found = both.repartition("bucket").sortWithinPartitions("bucket", "kind").mapInArrow(rank, "query_id long, query_row long, vec_id long, row long, score double")
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("query_id", "query_row").orderBy(F.desc("score"), "vec_id", "row")))
    return ranked.filter(F.col("rank") <= neighbours).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score", "query_row")


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, 20)
