"""Session helpers: table access, partition counts and tables in the shared folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of the data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    """The session's shuffle width; operators that fix a width follow it, so it scales with the deployment."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def shared_folder(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: the session's ``spark.checkpoint.dir``.

    Where that is unset, a temporary folder serves a session in one process
    (``local[..]``), as in tests; on a cluster that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return os.path.join(tempfile.gettempdir(), "gristdex-shared")


def fresh_path(spark: SparkSession) -> str:
    """A new path in the shared folder, removed when the session's file system is closed, at the end of the application at the latest."""
    path = f"{shared_folder(spark)}/gristdex-{uuid.uuid4().hex}"
    # Marked on a file system of this user, as Spark's own writers use it.
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def written(df: DataFrame) -> DataFrame:
    """The rows of ``df`` from a table written to the shared folder: computed once, whatever reads it, and safe from lost executors."""
    path = fresh_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def placed(df: DataFrame, *order: Column | str) -> DataFrame:
    """The rows of ``df`` with ``place``, their number from 0 in an order; ties are numbered in any order.

    Rows are range-sorted and written once, which fixes their places; a row's
    place is that in its partition plus the rows of the partitions before, so no
    task sees the whole table.
    """
    rows = written(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_at", 33))
    ahead = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("n"))  # a row a partition
    before = ahead.select("_part", F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    place = F.col("_before") + F.col("_at") - F.shiftleft("_part", 33)
    return rows.join(before, "_part").select(*df.columns, place.alias("place"))
