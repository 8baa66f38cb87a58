"""Tables written once in the shared folder, so that nothing is computed again when an executor is lost."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; one is made only where the session has none, and only in local mode."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    wanted = spark.conf.get("spark.checkpoint.dir", None)
    if not wanted:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        wanted = tempfile.mkdtemp(prefix="memloom-checkpoint-")
    sc.setCheckpointDir(wanted)
    return sc.getCheckpointDir()


def place(spark: SparkSession, path: str):
    """A path and its file system."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def written(df: DataFrame) -> DataFrame:
    """df from a table in the shared folder, with no lineage. The files go when the session ends."""
    spark = df.sparkSession
    path = os.path.join(shared_folder(spark), f"table-{uuid.uuid4().hex}")
    df.write.parquet(path)
    at, fs = place(spark, path)
    fs.deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def rename_new(spark: SparkSession, source: str, target: str) -> bool:
    """Renames a folder to a name that nothing has; False if something has it."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    fs = jvm.org.apache.hadoop.fs
    a, b = fs.Path(source), fs.Path(target)
    context = fs.FileContext.getFileContext(b.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        context.rename(a, b, gateway.new_array(getattr(fs, "Options$Rename"), 0))
    except Exception as e:  # noqa: BLE001  py4j wraps the one that says the target exists
        if "FileAlreadyExists" in str(e):
            return False
        raise
    return True
