"""Exact dedup by a tree merge of sorted digest runs, in DataFrame functions only.

Each input partition yields a run: one row per digest, in digest order, with the smallest identifier and the number
of rows.  In each round neighbouring runs exchange their rows, every task takes some digests of all runs of its group,
sorts them (which merges the sorted stretches) and folds equal ones in one streaming pass, a sort aggregate, so the
number of runs falls by the fan-in until one is left, spread over all tasks.  The fan-in grows with the cube root of
the number of runs, so that three rounds do for any number beyond 64.

A digest is SHA-256 of the normalised text.  Its length and a 64-bit hash of another kind verify it: they are part of
the key at every level, so rows whose digests agree by chance would stay apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slotwise.llm.common import WS, checkpointed, file_table, only, stored, table, with_row_key

FAN_IN = 4
KEY = ["_digest", "_length", "_check"]


def normalised(text: Column) -> Column:
    """Null counts as empty; each stretch of ASCII white space becomes one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"[{WS}]+", " ")


def digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, _rk, _digest, _length, _check, _run) of every row; the run is the partition that read the row."""
    text = normalised(F.col(text_col))
    return with_row_key(docs.select(*dict.fromkeys([id_col, text_col]))).select(
        F.col(id_col).alias("_id"),
        "_rk",
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("_digest"),
        F.octet_length(text).alias("_length"),
        F.xxhash64(text).alias("_check"),
        F.spark_partition_id().alias("_run"),
    )


def merge_runs(rows: DataFrame, fan_in: int | None = None) -> DataFrame:
    """(_digest, _length, _check, _least, _n) of every group; ``_least`` is (no id, id, row key) of its first row."""
    least = F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_rk").alias("rk"))
    runs = rows.groupBy("_run", *KEY).agg(F.min(least).alias("_least"), F.count(F.lit(1)).alias("_n"))
    left = (rows.agg(F.max("_run")).first()[0] or 0) + 1
    fan_in = fan_in or max(FAN_IN, round(left ** (1 / 3) + 0.5))
    while left > 1:
        merged = runs.withColumn("_run", (F.col("_run") / fan_in).cast("int"))
        runs = merged.groupBy("_run", *KEY).agg(F.min("_least").alias("_least"), F.sum("_n").alias("_n"))
        left = -(-left // fan_in)
    return runs.drop("_run")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: _id, _rk, _digest, keep_id, group_size, kept.

    Of rows with equal texts the one with the smallest id stays (null after all others); if several rows
    share that id, the first of them by row key.  An empty table gives no rows.  Other columns are ignored.
    ``docs`` that is no file table is written out first, so that its rows keep their keys.
    """
    rows = checkpointed(digests(file_table(docs), id_col, text_col))
    # Texts that come once need no join; the others' groups are a table of their own, so a large group is split in the join.
    groups = stored(merge_runs(rows).filter("_n > 1"))
    joined = rows.drop("_run").join(groups, KEY, "left")
    alone = F.col("_n").isNull()
    return joined.select(
        "_id", "_rk", "_digest", F.when(alone, F.col("_id")).otherwise(F.col("_least.id")).alias("keep_id"), F.coalesce("_n", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("_rk") == F.col("_least.rk"))).alias("kept"),
    )


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, whatever their names."""
    docs = file_table(docs)
    return only(docs, exact_groups(docs, id_col, text_col).filter("kept").select("_rk"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_groups(table(spark, sf_dir, "documents"))
    return groups.select(F.col("_id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("_digest")).alias("text_sha256"))


OP7_SQL = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""
