"""Parquet tables: reading them over all cores, and writing intermediate ones once in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over all cores: a table of fewer parts than cores, such as one file of one row group, is dealt out before dear work on its rows. A table of enough parts is left as it is, so a large one isn't shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def scratch_dir(spark: SparkSession) -> str:
    """This application's folder below the shared one that spark.checkpoint.dir names. Where that is unset, a temporary folder serves a local session; a cluster has no folder to share and is refused."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = f"file://{tempfile.gettempdir()}/quarrywise-scratch"
    return f"{shared.rstrip('/')}/quarrywise-{spark.sparkContext.applicationId}"


def release_scratch(spark: SparkSession) -> None:
    """Removes the tables that materialize wrote in this application. Results that are still to be computed from them are lost, so it is for the end of a job."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(scratch_dir(spark))
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def materialize(df: DataFrame, *partition_by: str) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it back.

    The lineage is cut without keeping blocks on executors, so a lost executor costs nothing,
    and the shuffle files of the query that made the table are released as soon as it ends.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/table-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.partitionBy(*partition_by).parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)
