"""Where intermediate tables go, and how lineage is cut."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

BROADCAST_ROWS = 50_000  # of a table written in between, of which joins may make a broadcast


def shared_dir(spark: SparkSession) -> str:
    """A folder of this session that all executors can reach, deleted when the session's JVM ends.

    It lies in the folder that ``spark.checkpoint.dir`` names, else in the warehouse.
    """
    context = spark.sparkContext
    if not hasattr(context, "_colloquy_shared_dir"):
        parent = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
        # Unset, the warehouse is a folder of the driver's machine, which executors elsewhere cannot reach.
        if parent.startswith(("file:", "/")) and not context.master.startswith("local") and not (
                spark.conf.get("spark.checkpoint.dir", None) or context.getConf().contains("spark.sql.warehouse.dir")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = f"{parent.rstrip('/')}/colloquy-{uuid.uuid4().hex}"
        folder = context._jvm.org.apache.hadoop.fs.Path(path)
        system = folder.getFileSystem(context._jsc.hadoopConfiguration())
        system.mkdirs(folder)
        system.deleteOnExit(folder)
        context._colloquy_shared_dir = path
    return context._colloquy_shared_dir


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path no other run uses, so a retried job never reads half of an older one."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage through a table in the shared folder, which outlives lost executors.

    Joins are planned from the size of its files, and a few MB of compressed files can be hundreds of MB of rows. So
    a table of more than ``BROADCAST_ROWS`` rows is marked for a merge join, which never gathers it in the driver.
    """
    path = fresh_path(df.sparkSession, "table")
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)  # a third of the disk less than the default
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    return table.hint("merge") if table.count() > BROADCAST_ROWS else table


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """The same rows dealt over all cores by ``keys``, for work that is heavy for its bytes.

    Spark joins the partitions of a shuffle until they hold some MB, so rows that are small but costly would all be one task.
    """
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


def has_rows(df: DataFrame) -> bool:
    return not df.isEmpty()
