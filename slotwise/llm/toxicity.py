"""Toxicity scores: gradient-boosted trees over dense text features, with isotonic calibration.

Three passes.  The first counts, over a bounded sample of labelled rows, in how many toxic and other
documents each word and word beginning occurs, and keeps as lexicon what is toxic beyond chance given how
many were tried.  The second computes the sample's features, from which the driver grows the trees and
fits the calibration on rows that the trees have not seen.  The third scores every whole text.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotwise.llm.common import bounded_batches, table

#: Labelled rows to fit on at most, lexicon entries kept at most, and score from which a text counts as toxic.
SAMPLE_ROWS, LEXICON_SIZE, THRESHOLD = 20_000, 20_000, 0.3
TREES, DEPTH, RATE, BINS, LEAF_ROWS, RIDGE = 80, 3, 0.15, 32, 10, 1.0
PREFIXES = (4, 5)
#: Of 64 marks for groups of similar texts, how many a term must have for all its documents to count.
GROUPS = 48
#: Terms that a task holds before it sends their counts.
HELD_TERMS = 150_000
CACHE_WORDS = 100_000
#: Second-person forms of the corpus's languages.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine deinen deiner ihr euch euer tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split())
#: Characters that stand for letters in disguised words.
DISGUISE = str.maketrans("013457@$!|", "oieastasil")
WORD_HIT, PREFIX_HIT, PERSON, OBFUSCATED, CAPITALS = 1, 2, 4, 8, 16
NEAR = 5
N_FEATURES = 14


def plain(token: str) -> str:
    """A token in lower case without signs at its ends, disguises undone inside."""
    word = token.strip(".,;:!?\"'()[]{}<>|-_*…«»¿¡").lower()
    if word.isalpha():
        return word
    core = "".join(c for c in word.translate(DISGUISE) if c.isalpha())
    return core if any(c.isalpha() for c in word) else word


@dataclass
class Model:
    words: frozenset = frozenset()
    starts: frozenset = frozenset()
    base: float = 0.0
    trees: list = field(default_factory=list)
    raw_at: np.ndarray = field(default_factory=lambda: np.array([0.0]))
    score_at: np.ndarray = field(default_factory=lambda: np.array([0.0]))

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.raw_at, self.score_at), 0.0, 1.0)

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for tree in self.trees:
            out += RATE * tree_values(tree, x)
        return out


class _Codes(dict):
    """Flags of a token; bounded, as texts have ever new words."""

    def __init__(self, words: frozenset, starts: frozenset):
        self.words, self.starts = words, starts

    def __missing__(self, token: str) -> int:
        word = plain(token)
        low = token.lower()
        inner = token.strip(".,;:!?\"'()[]{}<>|-_*…«»¿¡")
        code = WORD_HIT * (word in self.words) | PREFIX_HIT * any(word[:n] in self.starts for n in PREFIXES if len(word) >= n)
        code |= PERSON * (word in SECOND_PERSON) | OBFUSCATED * (len(inner) > 2 and not inner.isalpha() and any(c.isalpha() for c in inner) and not inner.replace("'", "").replace("-", "").isalpha())
        code |= CAPITALS * (len(inner) > 1 and inner.isupper() and low != inner)
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[token] = code
        return code


_UPPER, _DIGIT, _PUNCT = (np.array([f(chr(i)) for i in range(256)], bool) for f in (lambda c: "A" <= c <= "Z", lambda c: "0" <= c <= "9", lambda c: c < "\x7f" and not c.isalnum() and not c.isspace()))


def features(text: str | None, codes: _Codes) -> list[float]:
    """Dense features of a whole text; a null text counts as empty and gives zeros."""
    data = (text or "").encode()
    tokens = (text or "").split()
    if not tokens:
        return [0.0] * N_FEATURES
    c = np.frombuffer(bytes(map(codes.__getitem__, tokens)), np.uint8)
    n, size = len(c), len(data)
    hit = np.flatnonzero(c & (WORD_HIT | PREFIX_HIT))
    person = np.flatnonzero(c & PERSON)
    near = 0
    if len(hit) and len(person):
        k = np.searchsorted(person, hit)
        gap = np.minimum(np.abs(person[np.minimum(k, len(person) - 1)] - hit), np.abs(person[np.maximum(k - 1, 0)] - hit))
        near = int((gap <= NEAR).sum())
    flags = np.bincount(c, minlength=32)
    of = lambda bit: int(flags[[i for i in range(32) if i & bit]].sum())
    bytes_of = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    words, starts = of(WORD_HIT), of(PREFIX_HIT)
    return [
        words / n, math.log1p(words), starts / n, math.log1p(starts), len(hit) / n, near / n, near / max(1, len(hit)), len(person) / n,
        float(bytes_of[_UPPER].sum()) / size, of(CAPITALS) / n, float(bytes_of[_PUNCT].sum()) / size, float(bytes_of[33]) / size, float(bytes_of[_DIGIT].sum()) / size,
        of(OBFUSCATED) / n,
    ]


# -- trees and calibration --------------------------------------------------------------------------


def tree_values(tree: tuple, x: np.ndarray) -> np.ndarray:
    """Values of a complete tree: (feature, threshold) arrays by node, then leaf values."""
    feature, threshold, leaves = tree
    node = np.zeros(len(x), np.int64)
    for _ in range(int(math.log2(len(leaves)))):
        node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > threshold[node])
    return leaves[node - len(feature)]


def grow(x: np.ndarray, y: np.ndarray) -> tuple[float, list]:
    """Boosted trees for log loss, by histograms over quantile bins."""
    rate = np.clip(y.mean(), 1e-4, 1 - 1e-4)
    base = float(np.log(rate / (1 - rate)))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    # Rare features have nearly all quantiles at one value; their own larger values need bins too.
    edges = [np.unique(np.concatenate([e, np.quantile(v, np.linspace(0, 1, BINS // 2))[:-1]])) if len(v := x[x[:, f] > 0, f]) else e for f, e in enumerate(edges)]
    edges = [e if x[:, f].min() >= e[0] or not len(e) else np.unique(np.concatenate([[x[:, f].min()], e])) for f, e in enumerate(edges)]
    bins = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    width = max(map(len, edges)) + 1
    raw, trees = np.full(len(y), base), []
    inner = 2**DEPTH - 1
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, p * (1 - p)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            first, many = 2**level - 1, 2**level
            best = np.full(many, 1e-9)
            for f, e in enumerate(edges):
                if not len(e):
                    continue
                at = (node - first) * width + bins[:, f]
                sums = [np.bincount(at, w, many * width).reshape(many, width).cumsum(axis=1) for w in (g, h, None)]
                left, total = [s[:, : len(e)] for s in sums], [s[:, -1:] for s in sums]
                right = [t - s for s, t in zip(left, total)]
                gain = left[0] ** 2 / (left[1] + RIDGE) + right[0] ** 2 / (right[1] + RIDGE) - total[0] ** 2 / (total[1] + RIDGE)
                gain[(left[2] < LEAF_ROWS) | (right[2] < LEAF_ROWS)] = 0
                k = gain.argmax(axis=1)
                top = gain[np.arange(many), k]
                for i in np.flatnonzero(top > best):
                    best[i], feature[first + i], threshold[first + i] = top[i], f, e[k[i]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > threshold[node])
        leaf = node - inner
        leaves = np.bincount(leaf, g, 2**DEPTH) / (np.bincount(leaf, h, 2**DEPTH) + RIDGE)
        trees.append((feature, threshold, leaves))
        raw += RATE * leaves[leaf]
    return base, trees


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing fit of y to raw: pool adjacent violators, equal raws together."""
    at, inverse, count = np.unique(raw, return_inverse=True, return_counts=True)
    blocks: list[list[float]] = []  # mean, weight, first raw, last raw
    for r, total, n in zip(at, np.bincount(inverse, y), count):
        blocks.append([total / n, n, r, r])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            mean, n2, _, last = blocks.pop()
            b = blocks[-1]
            b[0], b[1], b[3] = (b[0] * b[1] + mean * n2) / (b[1] + n2), b[1] + n2, last
    # Shrunk towards the mean by one row a block, so that small pure blocks don't claim certainty.
    base = float(y.mean())
    knots = [(r, (b[0] * b[1] + base) / (b[1] + 1)) for b in blocks for r in dict.fromkeys((b[2], b[3]))]
    return np.array([k[0] for k in knots]), np.maximum.accumulate([k[1] for k in knots])


def fit_trees(x: np.ndarray, y: np.ndarray, model: Model) -> Model:
    """Trees on three quarters of the sample, calibration on the rest; with one class only, a constant."""
    if not len(y) or y.min() == y.max():
        model.score_at = np.array([float(y.mean()) if len(y) else 0.0])
        return model
    held = np.arange(len(y)) % 4 == 3
    if y[held].min() == y[held].max() or y[~held].min() == y[~held].max():
        held[:] = False
    model.base, model.trees = grow(x[~held], y[~held])
    rows = held if held.any() else ~held
    model.raw_at, model.score_at = isotonic(model.raw(x[rows]), y[rows])
    return model


# -- the distributed part ---------------------------------------------------------------------------


def is_held_out(id_col: str = "doc_id"):
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def term_counts(rows: DataFrame) -> DataFrame:
    """(term, kind, toxic, other, groups) over (text, toxic): documents of either class, and groups of similar toxic ones.

    A text's group is its lowest word hash, which copies and near copies mostly share, so that the words
    of one text that was copied often do not look like words of many.  Groups are 64 marks, united over all
    tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, other, groups = defaultdict(int), defaultdict(int), defaultdict(int)

        def out() -> pa.RecordBatch:
            keys = [k for k in toxic.keys() | other.keys() if len(k) > 1]
            columns = [
                pa.array([k[1:] for k in keys], pa.string()), pa.array([int(k[0]) for k in keys], pa.int32()), pa.array([toxic.get(k, 0) for k in keys], pa.int64()),
                pa.array([other.get(k, 0) for k in keys], pa.int64()), pa.array(np.array([groups.get(k, 0) for k in keys], np.uint64).view(np.int64)),
            ]
            for d in (toxic, other, groups):
                d.clear()
            return pa.RecordBatch.from_arrays(columns, ["term", "kind", "toxic", "other", "groups"])

        for batch in batches:
            for text, label in zip(batch.column(0), batch.column(1)):
                words = [plain(w) for w in (text.as_py() or "").split()]
                starts = [[f"0{w}", *(f"{n}{w[:n]}" for n in PREFIXES if len(w) >= n)] for w in words]
                counts = toxic if label.as_py() else other
                for term in {t for s in starts for t in s}:
                    counts[term] += 1
                if label.as_py():
                    group = min((zlib.crc32(w.encode()) for w in words), default=0)
                    for term in {t for s in starts for t in s}:
                        groups[term] |= 1 << (group * 0x9E3779B1 >> 8 & 63)
                if len(toxic) + len(other) > HELD_TERMS:
                    yield out()
        yield out()

    parts = rows.select("text", "toxic").mapInArrow(run, "term string, kind int, toxic long, other long, groups long")
    return parts.groupBy("term", "kind").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"), F.bit_count(F.bit_or("groups")).cast("long").alias("groups"))


def lexicon(rows: DataFrame, size: int = LEXICON_SIZE) -> tuple[frozenset, frozenset]:
    """Words and word beginnings that occur in toxic documents beyond chance: log-likelihood ratio over ln(terms) + 3."""
    n = rows.groupBy("toxic").count().collect()
    by = {r["toxic"]: r["count"] for r in n}
    if not by.get(1) or not by.get(0):
        return frozenset(), frozenset()
    share = by[1] / (by[0] + by[1])
    counts = term_counts(rows).filter("toxic >= 3").persist()
    terms = max(counts.count(), 1)
    t, c = F.when(F.col("groups") < GROUPS, F.least("toxic", "groups")).otherwise(F.col("toxic")), F.col("other")
    llr = t * F.log(t / ((t + c) * share)) + F.when(c > 0, c * F.log(c / ((t + c) * (1 - share)))).otherwise(0.0)
    chosen = counts.filter((t / (t + c) > 0.5) & (llr > math.log(terms) + 3)).orderBy(llr.desc(), "term", "kind").limit(size).collect()
    counts.unpersist()
    return frozenset(r["term"] for r in chosen if r["kind"] == 0), frozenset(r["term"] for r in chosen if r["kind"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> Model:
    """The model from labelled rows that are not held out: ``sample_rows`` of them at most, the first by hash of the id.

    Null labels and ids are left out; of several labels of one id the largest counts.
    """
    bounded_batches(docs.sparkSession)
    known = labels.select(F.col(id_col).alias("_id"), F.col("toxic").cast("int").alias("toxic")).filter("_id is not null and toxic is not null")
    known = known.filter(~is_held_out("_id")).groupBy("_id").agg(F.max("toxic").alias("toxic"))
    sample = known.orderBy(F.xxhash64("_id"), "_id").limit(sample_rows)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "_id").persist()
    model = Model(*lexicon(rows))
    words, starts = model.words, model.starts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = _Codes(words, starts)
        for batch in batches:
            x = [features(t.as_py(), codes) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], ["toxic", "x"])

    got = rows.select("toxic", "text", F.xxhash64("_id").alias("h")).select("toxic", "text").mapInArrow(run, "toxic int, x array<double>").collect()
    rows.unpersist()
    got = sorted((r["toxic"], r["x"]) for r in got)
    return fit_trees(np.array([r[1] for r in got]).reshape(-1, N_FEATURES), np.array([r[0] for r in got], float), model)


def scored(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """(row, score): all columns of every row of ``docs`` in one struct, and its score; null and empty texts are scored like any other."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    frame, at = docs.select(F.struct("*").alias("row")), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = _Codes(sent.value.words, sent.value.starts)
        for batch in batches:
            x = np.array([features(t.as_py(), codes) for t in batch.column(0).flatten()[at]]).reshape(-1, N_FEATURES)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sent.value.scores(x))], ["row", "score"])

    return frame.mapInArrow(run, docs.select(F.struct("*").alias("row")).schema.add("score", "double"))


def not_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score is below ``threshold``, with all their columns, whatever their names."""
    return scored(docs, fit(docs, labels, id_col, text_col), text_col).filter(F.col("score") < threshold).select("row.*")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = scored(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("row.doc_id", is_held_out("row.doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
