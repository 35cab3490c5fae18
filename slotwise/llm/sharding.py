"""Reproducible shuffle into shards by a Feistel permutation with cycle walking over global row numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotwise.llm.common import checkpointed, ordered, permuted, row_numbers, table

SHARDS, SEED = 24, 20260101


def feistel_shards(rows: DataFrame, order: list, shards: int, seed: int = SEED) -> DataFrame:
    """Adds row_no (global, by ``order``), shard and slot; shard sizes differ by one row at most.

    The permuted row number p gives shard p mod ``shards`` and slot p div ``shards``, so either can be
    computed from a row number alone, and ``row_of`` goes back.  ``order`` must be total up to
    interchangeable rows.  An empty table gives no rows.
    """
    numbered = row_numbers(ordered(rows, *order), "row_no")
    n = rows.count()
    placed = permuted(numbered.withColumn("_n", F.lit(n).cast("long")), "row_no", "_n", F.lit(seed).cast("long"), "_place")
    return placed.withColumn("shard", F.pmod("_place", F.lit(shards)).cast("int")).withColumn("slot", F.floor(F.col("_place") / shards).cast("long")).drop("_n", "_place", "_pid", "_pos")


def row_of(places: DataFrame, n: int, shards: int, seed: int = SEED) -> DataFrame:
    """Adds to rows with shard and slot the global row number that lies there."""
    named = places.withColumn("_place", F.col("slot") * shards + F.col("shard")).withColumn("_n", F.lit(n).cast("long"))
    return permuted(named, "_place", "_n", F.lit(seed).cast("long"), "row_no", inverse=True).drop("_place", "_n")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Global order: doc_id (nulls first), then size, text hash and checksum, so it doesn't depend on the files' layout."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("_hash"))
    rows = checkpointed(docs.withColumn("_mid", F.monotonically_increasing_id()))
    placed = feistel_shards(rows, ["doc_id", "size", "_hash", "text_crc32", "_mid"], SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
