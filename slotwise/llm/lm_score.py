"""Document scores by cross-entropy difference between a target and a background n-gram model.

Tokens are the UTF-8 bytes of a text and an end mark, so both models share one vocabulary in which nothing
is unknown.  Every n-gram of every document is counted; the lower orders are sums of the highest one,
because texts are padded in front.  Probabilities are Witten-Bell estimates, order by order, in joins.

Both models are held out: documents are in FOLDS folds, and those of one are scored by the counts of the
others, so no document is scored by a model that has counted it.  They are matched in size: the background
is the larger corpus, so it enters with the counts to be expected of a random part of it that has as many
tokens as the target (a count c by the share r: c * r; a gram among the kinds: 1 - (1 - r) ** c).  All
documents take part in that; none is drawn.

Documents are dealt to buckets of bounded size, packed and compressed for the shuffle.  A bucket's distinct
n-grams are counted once for all its documents; later the bucket gets the losses of just these n-grams
back, so neither a table of all n-grams nor a row per document and n-gram is ever sent to a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotwise.llm.common import bucket_count, checkpointed, packed, stored, table, unpacked

ORDER, BITS, END, VOCABULARY = 5, 9, 257, 257
FOLDS = 4


def grams(text: bytes) -> np.ndarray:
    """One key per token: the token and the ORDER - 1 before it, BITS bits each; 0 stands before the text."""
    x = np.zeros(len(text) + ORDER, np.uint64)
    x[ORDER - 1 : -1] = np.frombuffer(text, np.uint8)
    x[ORDER - 1 : -1] += np.uint64(1)
    x[-1] = END
    n = len(text) + 1
    keys = x[:n].copy()
    for i in range(1, ORDER):
        keys <<= np.uint64(BITS)
        keys |= x[i : i + n]
    return keys


class _Counts:
    """Counts of keys, merged whenever enough have come."""

    def __init__(self) -> None:
        self.keys, self.n, self.new, self.held = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0

    def add(self, keys: np.ndarray) -> None:
        self.new.append(keys)
        self.held += len(keys)
        if self.held > 1 << 22:
            self.merge()

    def merge(self) -> None:
        if self.new:
            keys, n = np.unique(np.concatenate(self.new), return_counts=True)
            both = np.concatenate([self.keys, keys])
            self.keys, at = np.unique(both, return_inverse=True)
            self.n = np.bincount(at, np.concatenate([self.n, n]), len(self.keys)).astype(np.int64)
            self.new, self.held = [], 0


def losses(counts: DataFrame, shares: list[float]) -> DataFrame:
    """(g, lt, lb): by fold, negative log probabilities of a gram's last token in the target and background models.

    ``counts`` has the arrays t and n by fold, which hold what is *not* in that fold; ``shares`` are the parts
    of the background that are as large as the target.  Witten-Bell: a context's distinct successors are the
    weight of the next lower order; under a context that a model has never seen, the lower order holds
    alone; below the first order all tokens are equal.
    """
    folds = range(FOLDS)
    counts = counts.select("g", *[F.col(m)[f].alias(f"{m}{f}") for m in "tn" for f in folds])
    models = [(f"t{f}", 1.0) for f in folds] + [(f"n{f}", shares[f]) for f in folds]
    lower = None
    for n in range(1, ORDER + 1):
        c = counts.groupBy(F.col("g").bitwiseAND((1 << BITS * n) - 1).alias("g")).agg(*[F.sum(m).alias(m) for m, _ in models]) if n < ORDER else counts
        c = c.withColumn("h", F.shiftright("g", BITS)).withColumn("s", F.col("g").bitwiseAND((1 << BITS * (n - 1)) - 1))
        kinds = [(F.count(F.when(F.col(m) > 0, 1)).cast("double") if r == 1 else F.sum(1 - F.pow(F.lit(1 - r), F.col(m)))).alias(f"k_{m}") for m, r in models]
        c = c.join(c.groupBy("h").agg(*[F.sum(m).alias(f"c_{m}") for m, _ in models], *kinds), "h")
        c = c.join(lower, "s") if lower is not None else c.withColumns({f"p_{m}": F.lit(1 / VOCABULARY) for m, _ in models})

        def mixed(m: str, r: float):
            kinds, below = F.col(f"k_{m}"), F.col(f"p_{m}")
            return F.when((F.col(f"c_{m}") > 0) & F.lit(r > 0), (F.col(m) * r + kinds * below) / (F.col(f"c_{m}") * r + kinds)).otherwise(below)

        lower = c.select(F.col("g").alias("s"), *[mixed(m, r).alias(f"p_{m}") for m, r in models])
    return lower.select(F.col("s").alias("g"), *[F.array(*[-F.log(f"p_{m}{f}") for f in folds]).alias(f"l{m}") for m in "tn"]).withColumnRenamed("ln", "lb")


def cross_entropy_difference(docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, target_loss, background_loss, score) of every row of ``docs``; losses are per token, in nats.

    ``targets`` lists in ``id`` the documents the target model is learnt from; the background is all of
    ``docs``.  Both are without the fold of the scored document (by a hash of its id; rows without an id are
    in fold 0) and of one size.  ``score`` is the target's loss less the background's: the lower, the closer to the target.
    A null text counts as empty, of which only the end mark is scored.  Rows of one id all count.  Without
    targets both models know nothing but the vocabulary, as does a model without other folds.  An empty table gives no rows.
    """
    buckets = -(-bucket_count(docs, text_col) // FOLDS) * FOLDS  # a bucket is of one fold: its number mod FOLDS
    packs = packed(docs.select(id_col, text_col), F.when(F.col(id_col).isNull(), 0).otherwise(F.pmod(F.xxhash64(id_col), F.lit(buckets))))
    kind = docs.schema[id_col].dataType.simpleString()
    wanted = targets.select(F.col("id").cast(kind).alias("id")).filter("id is not null").distinct()
    wanted = wanted.select(F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int").alias("b"), "id")

    def count(left: pa.Table, right: pa.Table) -> pa.Table:
        chosen = set(right.column("id").to_pylist())
        every, target = _Counts(), _Counts()
        for key, text in unpacked(left):
            keys = grams(text)
            every.add(keys)
            if key in chosen:
                target.add(keys)
        every.merge()
        target.merge()
        t = np.zeros(len(every.keys), np.int64)
        t[np.searchsorted(every.keys, target.keys)] = target.n
        b = left.column("b")[0].as_py() if left.num_rows else right.column("b")[0].as_py()
        return pa.table({"b": pa.array(np.full(len(t), b, np.int32)), "g": pa.array(every.keys.view(np.int64)), "t": pa.array(t), "n": pa.array(every.n)})

    counted = stored(packs.groupBy("b").cogroup(wanted.groupBy("b")).applyInArrow(count, "b int, g long, t long, n long"))
    fold = F.col("b") % FOLDS
    sizes = {r["f"]: (r["t"], r["n"]) for r in counted.groupBy(fold.alias("f")).agg(F.sum("t").alias("t"), F.sum("n").alias("n")).collect()}
    others = [[sum(v[m] for g, v in sizes.items() if g != f) for m in (0, 1)] for f in range(FOLDS)]
    outside = [F.array(*[F.sum(F.when(fold != f, F.col(m)).otherwise(0)) for f in range(FOLDS)]).alias(m) for m in "tn"]
    model = losses(checkpointed(counted.groupBy("g").agg(*outside)), [t / n if n else 0.0 for t, n in others])
    needed = counted.select("b", "g").join(model, "g").select("b", "g", F.col("lt")[fold].alias("lt"), F.col("lb")[fold].alias("lb"))

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        g = right.column("g").to_numpy().view(np.uint64)
        order = np.argsort(g)
        g, lt, lb = g[order], right.column("lt").to_numpy()[order], right.column("lb").to_numpy()[order]
        rows = []
        for key, text in unpacked(left):
            at = np.searchsorted(g, grams(text))
            rows.append((key, len(at), float(lt[at].sum()) / len(at), float(lb[at].sum()) / len(at)))
        cols = list(zip(*rows)) or [[], [], [], []]
        t, b = np.array(cols[2], float), np.array(cols[3], float)
        return pa.table({"id": pa.array(cols[0], left_type), "n_tokens": pa.array(cols[1], pa.int64()), "target_loss": pa.array(t), "background_loss": pa.array(b), "score": pa.array(t - b)})

    from pyspark.sql.pandas.types import to_arrow_type

    left_type = to_arrow_type(docs.schema[id_col].dataType)
    return packs.groupBy("b").cogroup(needed.groupBy("b")).applyInArrow(score, f"id {kind}, n_tokens long, target_loss double, background_loss double, score double")


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: the documents that are labelled as of good quality."""
    good = table(spark, sf_dir, "labels").filter("quality = 1").select(F.col("doc_id").alias("id"))
    return cross_entropy_difference(table(spark, sf_dir, "documents"), good).withColumnRenamed("id", "doc_id")
