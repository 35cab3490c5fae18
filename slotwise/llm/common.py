"""Helpers shared by the corpus operators: stable row keys, checkpoints, global order, permutations."""

from __future__ import annotations

import atexit
import math
import pickle
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The six ASCII white-space bytes that separate words.
WS = r"\x20\x09-\x0D"
WALK = 64
#: Text bytes in a bucket of packed documents, buckets at least, and bytes that a task holds before it sends its packs.
BUCKET_BYTES, LEAST_BUCKETS, HELD_BYTES = 8 << 20, 24, 48 << 20
BATCH_BYTES, _BATCH = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of BATCH_BYTES at most, where the session keeps Spark's own default.

    Texts may be long, and both sides of a Python task hold batches several times over.
    """
    if spark.conf.get(_BATCH) in ("67108864b", "64MB"):
        spark.conf.set(_BATCH, f"{BATCH_BYTES}b")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` cut from its lineage by files in the shared checkpoint folder.

    The folder comes from ``spark.checkpoint.dir``; only where that is unset on one machine (tests) a
    temporary one is made.  On a cluster that is an error.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; see ``checkpointed``."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.getCheckpointDir():
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="slotwise-checkpoint-"))
    return named or spark.sparkContext.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to a Parquet table in the shared folder and read again: smaller than a checkpoint.

    The table goes when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/slotwise-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)

    def drop() -> None:
        if spark.sparkContext._jsc is not None:
            hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)

    atexit.register(drop)
    return spark.read.schema(df.schema).parquet(path)


#: Plan nodes that keep the rows of a file as they are, at most one result row a row.
_ROW_NODES = {"Relation", "LogicalRelation", "Project", "Filter", "SubqueryAlias"}


def _is_file_table(df: DataFrame) -> bool:
    """Whether each row of ``df`` is one row of a Parquet file, so that file and row index name it."""
    plans = [df._jdf.queryExecution().analyzed()]
    while plans:
        plan = plans.pop()
        if plan.nodeName().split(" ")[0].split("(")[0] not in _ROW_NODES:
            return False
        children = plan.children()
        plans += [children.apply(i) for i in range(children.size())]
    try:
        df.select("_metadata.row_index", "_metadata.file_path").schema  # noqa: B018  resolves the columns
    except AnalysisException:
        return False
    return "_metadata" not in df.columns


def file_table(df: DataFrame) -> DataFrame:
    """``df`` if it is a plain view of Parquet files, else a copy of it in such files.

    Operators that read a table more than once and join on row keys start from this: only rows of files
    have keys that do not depend on the plan.
    """
    bounded_batches(df.sparkSession)
    return df if _is_file_table(df) else stored(df)


def with_row_key(df: DataFrame, name: str = "_rk") -> DataFrame:
    """Adds the key of a file table's row: (hash of the file's path, row index in the file), however files are split.

    ``df`` comes from ``file_table``; other tables raise an error.
    """
    return df.withColumn(name, row_key())


def row_key() -> Column:
    return F.struct(F.xxhash64("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("i"))


def rows_with_key(df: DataFrame, *more: Column) -> DataFrame:
    """(_row, _rk, more): all columns of ``df`` in one struct, so that no name of theirs meets another one."""
    return df.select(F.struct("*").alias("_row"), row_key().alias("_rk"), *more)


def only(docs: DataFrame, keys: DataFrame, how: str = "left_semi") -> DataFrame:
    """The rows of a file table whose key is in ``keys`` (with ``left_anti``: is not), with all their columns."""
    return rows_with_key(docs).join(keys, "_rk", how).select("_row.*")


def ordered(df: DataFrame, *order) -> DataFrame:
    """``df`` range-partitioned and sorted by ``order``, with ``_pid`` (partition) and ``_pos`` (order in all).

    ``order`` must be total up to interchangeable rows.  The result is checkpointed, so later passes see
    the same partitions.
    """
    out = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_pos", F.monotonically_increasing_id())
    return checkpointed(out).withColumn("_pid", F.shiftright("_pos", 33))


def prefix_sums(rows: DataFrame, group: list[str], sums: dict[str, str]) -> DataFrame:
    """Adds to ``rows`` (from ``ordered``), by name in ``sums``, the sum of a column over the earlier rows of the group.

    Sums run inside range partitions; one row a partition and group then carries the totals across, so a
    group that holds most rows is still spread over all partitions.  Group columns must not be null.
    """
    inside = W.partitionBy("_pid", *group).orderBy("_pos").rowsBetween(W.unboundedPreceding, -1)
    across = W.partitionBy(*group).orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)
    totals = rows.groupBy("_pid", *group).agg(*[F.sum(v).alias(f"_t_{n}") for n, v in sums.items()])
    before = totals.select("_pid", *group, *[F.coalesce(F.sum(f"_t_{n}").over(across), F.lit(0)).alias(f"_b_{n}") for n in sums])
    local = rows.select("*", *[F.coalesce(F.sum(v).over(inside), F.lit(0)).alias(f"_i_{n}") for n, v in sums.items()])
    out = local.join(before, ["_pid", *group]).withColumns({n: F.col(f"_i_{n}") + F.col(f"_b_{n}") for n in sums})
    return out.drop(*[f"_{x}_{n}" for n in sums for x in "ib"])


def row_numbers(rows: DataFrame, name: str) -> DataFrame:
    """Adds the 0-based global row number to ``rows`` from ``ordered``; the table that is joined has a row a partition."""
    totals = rows.groupBy("_pid").agg(F.count(F.lit(1)).alias("_t"))
    before = F.coalesce(F.sum("_t").over(W.orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = totals.select("_pid", before.alias("_before"))
    return rows.join(F.broadcast(starts), "_pid").withColumn(name, F.col("_before") + F.col("_pos").bitwiseAND((1 << 33) - 1)).drop("_before")


def bucket_count(docs: DataFrame, text_col: str) -> int:
    """Buckets of BUCKET_BYTES of text each, LEAST_BUCKETS at least."""
    return max(LEAST_BUCKETS, math.ceil((docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0) / BUCKET_BYTES))


def packed(docs: DataFrame, bucket: Column) -> DataFrame:
    """(b, pack): the rows of a bucket as compressed lists of tuples, which shuffle at a fraction of the texts' size.

    Strings in the last column go as bytes (null as none); ``unpacked`` gives the tuples back.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        size, press = 0, zstandard.ZstdCompressor(level=3).compress

        def out() -> pa.RecordBatch:
            packs = [press(pickle.dumps(v, protocol=5)) for v in held.values()]
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array(packs, pa.binary())], ["b", "pack"])

        for batch in batches:
            firsts = [c.to_pylist() for c in batch.columns[:-1]]
            for *values, text in zip(*firsts, batch.columns[-1]):
                data = (text.as_py() or "").encode()
                held.setdefault(values[0], []).append((*values[1:], data))
                size += len(data) + 64
                if size > HELD_BYTES:
                    yield out()
                    held, size = {}, 0
        if held:
            yield out()

    bounded_batches(docs.sparkSession)
    return docs.select(bucket.cast("int").alias("_b"), "*").mapInArrow(run, "b int, pack binary")


def unpacked(packs: pa.Table) -> Iterator[tuple]:
    for pack in packs.column("pack"):
        yield from pickle.loads(zstandard.decompress(pack.as_py(), max_output_size=1 << 31))


def _shape(n: Column) -> tuple[Column, Column]:
    a = F.greatest(F.ceil(F.sqrt(n.cast("double"))), F.lit(1)).cast("long")
    return a, F.greatest(F.ceil(n.cast("double") / a), F.lit(1)).cast("long")


def _rounds(x: Column, n: Column, seed: Column, rounds: int, inverse: bool) -> Column:
    """One pass of the Feistel network over Z_a x Z_b, a*b >= n and a*b - n < a."""
    a, b = _shape(n)
    sign = -1 if inverse else 1
    order = list(range(rounds))[::sign]

    def step(s: Column, i: Column) -> Column:
        left = F.struct(F.pmod(s["l"] + sign * F.pmod(F.xxhash64(seed, i, s["r"]), a), a).alias("l"), s["r"].alias("r"))
        right = F.struct(s["l"].alias("l"), F.pmod(s["r"] + sign * F.pmod(F.xxhash64(seed, i, s["l"]), b), b).alias("r"))
        return F.when(i % 2 == 0, left).otherwise(right)

    start = F.struct((x / b).cast("long").alias("l"), F.pmod(x, b).alias("r"))
    return F.aggregate(F.array(*[F.lit(i) for i in order]), start, step, lambda s: s["l"] * b + s["r"])


def permuted(df: DataFrame, x: str, n: str, seed: Column, name: str, inverse: bool = False, rounds: int = 6) -> DataFrame:
    """Adds a pseudorandom permutation of [0, n) at ``x``: a Feistel network with cycle walking, in SQL functions.

    ``x`` and ``n`` name long columns, ``seed`` is a long expression.  A value beyond n walks on along
    its cycle.  Fewer than sqrt(n) + 1 values lie beyond, so a walk of WALK steps always ends while n is
    at most WALK squared and else fails with a chance under n ** -WALK / 2; such a row raises an error.
    """
    c, size = F.col(x), F.col(n)
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), F.col("_p"), lambda v, _: F.when(v < size, v).otherwise(_rounds(v, size, seed, rounds, inverse)))
    out = df.withColumn("_p", _rounds(c, size, seed, rounds, inverse)).withColumn("_p", F.when(F.col("_p") < size, F.col("_p")).otherwise(walk))
    return out.withColumn(name, F.when(F.col("_p") < size, F.col("_p")).otherwise(F.raise_error(F.lit("cycle walk did not end")).cast("long"))).drop("_p")
