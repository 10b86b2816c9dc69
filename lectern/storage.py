"""Reading the input tables and cutting lineage on shared storage.

Intermediate tables go to the folder named by ``spark.checkpoint.dir``, which
every executor can read.  Only where a session on one machine names none is a
folder of our own used; any other session must name one.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, by Spark's own reader so any file system works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="lectern-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, asked of the file system that the path names."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def materialize(
    df: DataFrame, name: str, *, partition_by: tuple[str, ...] = (), buckets: tuple[int, str] | None = None
) -> DataFrame:
    """Write ``df`` as Parquet on shared storage and read it back.

    The result has no lineage, survives the loss of any executor, and keeps the
    columns' order (partition columns move to the end, as Spark reads them).
    With ``buckets``, a number and a column, later joins and groups on that
    column find the rows in place and don't shuffle them again.
    """
    spark = df.sparkSession
    own = f"{name}-{uuid.uuid4().hex}"
    path = f"{scratch_root(spark)}/lectern/{own}"
    writer = df.write.mode("errorifexists").format("parquet")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if buckets:
        table_name = f"lectern_{own.replace('-', '_')}"
        writer.bucketBy(*buckets).option("path", path).saveAsTable(table_name)
        out = spark.table(table_name)
    else:
        writer.save(path)
        out = spark.read.schema(df.schema).parquet(path)
    out._lectern_path = path
    return out


def release(*frames: DataFrame) -> None:
    """Delete tables written by :func:`materialize` that no later plan reads."""
    for df in frames:
        path = getattr(df, "_lectern_path", None)
        if path:
            spark = df.sparkSession
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)

