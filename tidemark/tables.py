"""Tables in the folder that all executors share: lineage is cut by writing, never by local checkpoints."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The application's own folder in spark.checkpoint.dir; Spark removes it when the application ends.

    Where that is unset, the folder given to SparkContext.setCheckpointDir. Where there is none either, a
    session of one machine gets one of its own, and a cluster raises: no folder of one machine serves it.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
        root = context.getCheckpointDir()
    folder = f"{root.rstrip('/')}/tidemark-{context.applicationId}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        files.mkdirs(path)
        files.deleteOnExit(path)  # results are read lazily, so only the end of the application is late enough
    return folder


def write_table(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage: write df to the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._shared_path = path
    return out


def drop_table(*tables: DataFrame) -> None:
    """Remove tables of write_table that nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._shared_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
