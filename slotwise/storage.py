"""Tables cut from their lineage, in the shared folder of the cluster."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only where that is unset on one machine (tests), a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.getCheckpointDir():
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="slotwise-checkpoint-"))
    return named or spark.sparkContext.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: for tables that are read often, in part of their columns.

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


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in files that outlive executors, with a plan that starts there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
