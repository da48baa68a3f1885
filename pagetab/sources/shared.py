"""Tables written to the cluster's shared folder.

Long plans are cut by writing a table and reading it back. Unlike an in-memory
cut, a written table outlives lost executors, and its file sizes tell the
optimizer whether a later join may broadcast it.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder for one run, below the folder named by ``spark.checkpoint.dir``."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        root = tempfile.mkdtemp(prefix="pagetab-")
    return f"{root.rstrip('/')}/pagetab-{uuid.uuid4().hex}"


def dropped(spark: SparkSession, *paths: str) -> None:
    """Delete tables that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def written(df: DataFrame, path: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` as a new Parquet table and return the table.

    With ``partition_by`` the rows are rebalanced on that column first: adaptive
    execution merges small partitions and splits a partition that one value fills.
    """
    writer = df.write if partition_by is None else df.hint("rebalance", partition_by).write.partitionBy(partition_by)
    writer.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
