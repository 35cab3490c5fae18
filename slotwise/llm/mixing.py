"""Mixing sources to target weights over fixed-length blocks, in DataFrame functions only.

Every source's words, in one global order, are packed into blocks of ``block_words`` words.  The mix is a
row of block slots cut into output shards of ``shard_slots``.  The sources' counts in a shard are drawn: a
multinomial draw under the condition that the totals meet the targets to the word, which is what one
pseudorandom permutation of all slots over the shards gives.  The q-th slot of a source takes, in each round
over the source's blocks, the block that another permutation names, and a join by index gives its words.
The last slot of a source takes only as many words as its target still lacks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from slotwise.llm.common import WS, checkpointed, file_table, ordered, permuted, prefix_sums, rows_with_key, table, with_row_key

BLOCK_WORDS, SHARD_SLOTS, SEED, WEIGHTS, MOST = 512, 4096, 20260102, (5, 2, 1), 3
CHUNK = 8192


def n_words(text: Column) -> Column:
    """Number of words between ASCII white space; null has none.  Each word with the space around it becomes one mark."""
    marks = F.length(F.regexp_replace(text, f"[{WS}]*[^{WS}]+[{WS}]*", "x"))
    return F.when(text.rlike(f"[^{WS}]"), marks).otherwise(0).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Adds ``target`` to (none, src, source_size): shares by weight of all words, none above ``most`` times its source.

    Weights repeat over the sources by code point, null last.  Where the share stops at the limit, the
    excess is shared out by weight again until none is above: with sources in order of limit to weight,
    those before some point stand at their limit and the rest get one and the same amount per weight.
    One row a source goes through these windows, never a row a document.
    """
    by_name, by_limit = W.orderBy("none", "src"), W.orderBy("_limit", "none", "src")
    rows = sources.withColumn("_i", F.row_number().over(by_name) - 1)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("_i") % len(weights) + 1).cast("int"))
    rows = rows.withColumn("_w", weight.cast("double")).withColumn("_limit", most * F.col("source_size") / F.col("_w"))
    before, after = by_limit.rowsBetween(W.unboundedPreceding, -1), by_limit.rowsBetween(0, W.unboundedFollowing)
    total = F.sum("source_size").over(W.partitionBy())
    level = (total - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("_w").over(after)
    rows = rows.withColumn("_level", level).withColumn("_capped", F.col("_limit") <= F.col("_level"))
    # The first source below its limit sets the level of all behind it.
    rows = rows.withColumn("_common", F.min(F.when(~F.col("_capped"), F.struct("_limit", "none", "src", "_level"))).over(W.partitionBy())["_level"])
    target = F.when(F.col("_capped"), (most * F.col("source_size")).cast("double")).otherwise(F.col("_w") * F.col("_common"))
    return rows.withColumn("target", target).drop("_i", "_w", "_limit", "_level", "_capped", "_common")


def _plan(sources: DataFrame, block: int, most: int, seed: int) -> DataFrame:
    """Adds the source's blocks, full rounds, slots, first slot of all and the words of the last slot."""
    size, words = F.col("source_size"), F.col("_words")
    rows = sources.withColumn("_words", F.least(F.round("target").cast("long"), most * size))
    rows = rows.withColumn("_blocks", F.ceil(size / block).cast("long")).filter("_blocks > 0")
    rows = rows.withColumn("_rounds", F.floor(words / size).cast("long")).withColumn("_rest", F.pmod(words, size))
    rows = rows.withColumn("_lacks", F.col("_blocks") * block - size).withColumn("_tail", F.col("_blocks") - 1)
    # Where the short last block comes in the last round decides how many slots the rest of the words takes.
    rows = permuted(rows, "_tail", "_blocks", _seed(seed, F.col("none"), F.col("src"), F.col("_rounds")), "_at", inverse=True)
    plain = F.ceil(F.col("_rest") / block).cast("long")
    short = F.ceil((F.col("_rest") + F.col("_lacks")) / block).cast("long")
    rows = rows.withColumn("_more", F.when(plain <= F.col("_at"), plain).otherwise(short))
    given = (F.col("_more") - 1) * block - F.when(F.col("_more") - 1 > F.col("_at"), F.col("_lacks")).otherwise(0)
    rows = rows.withColumn("_cut", F.col("_rest") - given)
    rows = rows.withColumn("_more", F.when(F.col("_rest") == 0, 0).otherwise(F.col("_more")))
    rows = rows.withColumn("_slots", F.col("_rounds") * F.col("_blocks") + F.col("_more"))
    first = F.sum("_slots").over(W.orderBy("none", "src").rowsBetween(W.unboundedPreceding, -1))
    return rows.withColumn("_first", F.coalesce(first, F.lit(0))).withColumn("_all", F.sum("_slots").over(W.partitionBy())).drop("_words", "_tail", "_at", "_lacks", "_rest")


def _seed(seed: int, *cols: Column) -> Column:
    return F.xxhash64(F.lit(seed), *cols)


def _spread(rows: DataFrame, count: str, name: str, parts: int) -> DataFrame:
    """Each row ``count`` times with ``name`` from 0, in chunks that go round all tasks."""
    last = F.floor((F.col(count) - 1) / CHUNK).cast("long")
    chunks = rows.filter(F.col(count) > 0).withColumn("_c", F.explode(F.sequence(F.lit(0).cast("long"), last))).repartition(parts, "none", "src", "_c")
    low, high = F.col("_c") * CHUNK, F.least((F.col("_c") + 1) * CHUNK, F.col(count)) - 1
    return chunks.withColumn(name, F.explode(F.sequence(low, high))).drop("_c")


def drawn_slots(plan: DataFrame, parts: int, seed: int, shard_slots: int) -> DataFrame:
    """(none, src, shard, slot, block, cut) of every slot; ``cut`` is the words taken of the block, null for all of them."""
    slots = _spread(plan, "_slots", "_q", parts).withColumn("_place", F.col("_first") + F.col("_q"))
    slots = permuted(slots, "_place", "_all", F.lit(seed).cast("long"), "_out")
    slots = slots.withColumn("_round", F.floor(F.col("_q") / F.col("_blocks")).cast("long")).withColumn("_k", F.pmod("_q", F.col("_blocks")))
    slots = permuted(slots, "_k", "_blocks", _seed(seed, F.col("none"), F.col("src"), F.col("_round")), "block")
    partial = (F.col("_q") == F.col("_slots") - 1) & (F.col("_more") > 0)
    return slots.select("none", "src", F.floor(F.col("_out") / shard_slots).cast("long").alias("shard"), F.pmod("_out", F.lit(shard_slots)).cast("long").alias("slot"), "block", F.when(partial, F.col("_cut")).alias("cut"))


def shard_counts(slots: DataFrame) -> DataFrame:
    """(none, src, shard, n): the sources' drawn counts per output shard."""
    return slots.groupBy("none", "src", "shard").agg(F.count(F.lit(1)).alias("n"))


def _measured(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(id, _rk, none, src, size) of every row of a file table."""
    rows = with_row_key(docs.select(*dict.fromkeys([id_col, text_col, source_col])))
    return checkpointed(rows.select(F.col(id_col).alias("id"), "_rk", F.col(source_col).isNull().alias("none"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("src"), n_words(F.col(text_col)).alias("size")))


def mix_layout(rows: DataFrame, sources: DataFrame, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = SEED, most: int = MOST) -> DataFrame:
    """(shard, slot, at, _rk, lo, hi, upto): the mix itself.  Place ``at`` of a slot begins words lo to upto of a document.

    ``hi`` is where the block's part of the document ends; ``upto`` is less in the slot that is cut.
    """
    plan = checkpointed(_plan(sources, block_words, most, seed))
    slots = plan.agg(F.max("_all")).first()[0] or 0
    slots = drawn_slots(plan, max(1, min(4096, -(-slots // CHUNK))), seed, shard_slots)
    laid = prefix_sums(ordered(rows, "none", "src", "id", "size", "_rk"), ["none", "src"], {"_at": "size"})
    first, last = F.floor(F.col("_at") / block_words).cast("long"), F.floor((F.col("_at") + F.col("size") - 1) / block_words).cast("long")
    spans = laid.filter("size > 0").withColumn("block", F.explode(F.sequence(first, last)))
    low = F.greatest(F.col("block") * block_words, F.col("_at"))
    high = F.least((F.col("block") + 1) * block_words, F.col("_at") + F.col("size"))
    spans = spans.select("none", "src", "block", "_rk", (low - F.col("_at")).alias("lo"), (high - F.col("_at")).alias("hi"), (low - F.col("block") * block_words).alias("at"))
    # The slots grow with the words, so they are never broadcast, however small a run makes them look.
    joined = spans.join(slots.hint("merge"), ["none", "src", "block"])
    upto = F.when(F.col("cut").isNull(), F.col("hi")).otherwise(F.least(F.col("hi"), F.col("lo") + F.greatest(F.col("cut") - F.col("at"), F.lit(0))))
    return joined.withColumn("upto", upto).filter("upto > lo").select("shard", "slot", "at", "_rk", "lo", "hi", "upto")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = SEED, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(_rk, id, size, source_size, target, taken, pieces): every row of ``docs`` and the words the mix takes of it.

    ``pieces`` lists (lo, hi, times, cut): words lo to hi of the document, taken ``times`` times, and the
    first ``cut`` of them once more; these sum up the document's places in ``mix_layout``.  Nulls: text as
    empty, source as a source of its own, id as an id.  A document without words takes nothing, as does a
    table without words.  Rows with equal ids are separate documents.  Reruns agree: the order is by source,
    id, size and row key.  ``docs`` that is no file table is written out first, so that its rows keep their keys.
    """
    rows = _measured(file_table(docs), id_col, text_col, source_col)
    sources = checkpointed(targets(rows.groupBy("none", "src").agg(F.sum("size").alias("source_size")), weights, most))
    # Both groupings go by row, so one exchange does.
    places = mix_layout(rows, sources, block_words, shard_slots, seed, most).repartition("_rk")
    whole = F.col("upto") == F.col("hi")
    places = places.groupBy("_rk", "lo", "hi").agg(F.count(F.when(whole, 1)).alias("times"), F.coalesce(F.max(F.when(~whole, F.col("upto") - F.col("lo"))), F.lit(0)).cast("long").alias("cut"))
    taken = F.sum((F.col("hi") - F.col("lo")) * F.col("times") + F.col("cut"))
    per_doc = places.groupBy("_rk").agg(taken.alias("taken"), F.sum(F.col("hi") - F.col("lo")).alias("_seen"), F.sort_array(F.collect_list(F.struct("lo", "hi", "times", "cut"))).alias("pieces"))
    out = rows.join(per_doc, "_rk", "left").join(sources, ["none", "src"])
    return out.select("_rk", "id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "pieces", "_seen")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents with the columns of ``docs``: whole texts once per full round, then what the last round takes.

    A document of which the mix takes nothing is left out; a part of a document is its taken words with
    single spaces, and ``n_chars``, where there is such a column, follows the text.  Other columns stay as
    they are, whatever their names.
    """
    text, docs = options.get("text_col", "text"), file_table(docs)
    # Blocks that the mix takes nothing of are missing from the pieces; then no round is whole.
    whole = F.when(F.col("_seen") == F.col("size"), F.array_min("pieces.times")).otherwise(F.lit(0).cast("long"))
    takes = mix(docs, **options).filter("taken > 0").select("_rk", "pieces", whole.alias("whole"))
    more = F.filter(
        F.transform("pieces", lambda p: F.struct(p["lo"].alias("lo"), F.when(p["times"] > F.col("whole"), p["hi"]).otherwise(p["lo"] + p["cut"]).alias("hi"))),
        lambda p: p["hi"] > p["lo"],
    )
    rows = rows_with_key(docs).join(takes.select("_rk", "whole", more.alias("more")), "_rk")
    none = F.array().cast("array<int>")
    copies = F.concat(F.when(F.col("whole") > 0, F.sequence(F.lit(1), F.col("whole").cast("int"))).otherwise(none), F.when(F.size("more") > 0, F.array(F.lit(0))).otherwise(none))
    rows = rows.select("_row", "more", F.explode(copies).alias("copy"))
    words = F.filter(F.split(F.col("_row")[text], f"[{WS}]+", -1), lambda w: w != "")
    rows = rows.withColumn("words", F.when(F.col("copy") == 0, words))
    part = F.array_join(F.flatten(F.transform("more", lambda p: F.slice(F.col("words"), (p["lo"] + 1).cast("int"), (p["hi"] - p["lo"]).cast("int")))), " ")
    rows = rows.withColumn("new", F.when(F.col("copy") == 0, part).otherwise(F.col("_row")[text]))
    changed = {text: F.col("new")} | ({"n_chars": F.length("new").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return rows.select(*[changed.get(c, F.col("_row")[c]).alias(c) for c in docs.columns])


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")
