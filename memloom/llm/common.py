"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The words of the word-level contracts: maximal runs of anything but ASCII white space.
WORD_SPLIT = "[\\x20\\x09-\\x0D]+"

TOKENIZER_FILE = "word_bpe_49k.json"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = TOKENIZER_FILE) -> str:
    """Place of an installed public vocabulary file; on executors it is resolved there."""
    import public_tokenizers

    return public_tokenizers.path(name)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; one is set only where the session has none."""
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


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder once and returns a frame that reads it, with no lineage.

    The files go when the session ends: a result that is still to be read may need them.
    """
    base = ensure_checkpoint_dir(df.sparkSession)
    path = os.path.join(base, f"cut-{uuid.uuid4().hex}")
    df.write.parquet(path)
    at, fs = _at(df.sparkSession, path)
    fs.deleteOnExit(at)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _at(spark: SparkSession, path: str):
    """A path and its file system."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def drop_cut(df: DataFrame) -> None:
    """Deletes the files behind a frame made by :func:`cut`."""
    for f in {os.path.dirname(x) for x in df.inputFiles()}:
        at, fs = _at(df.sparkSession, f)
        fs.delete(at, True)


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row, whatever the optimizer inlines."""
    return F.element_at(F.transform(F.array(value), body), 1)


def sha256_hex(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def with_row_id(df: DataFrame, name: str) -> DataFrame:
    """df with a row's identity, the same in every evaluation: its file and place, or a number written once.

    Numbers given out while a plan runs may differ between two runs of it (after an executor is
    lost, splits can fall otherwise), so they are never joined unless they were written.
    """
    try:
        out = df.withColumn(name, F.struct(F.xxhash64("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("i")))
        out.schema  # noqa: B018  resolves the metadata now
        return out
    except AnalysisException:
        return cut(df.withColumn(name, F.struct(F.lit(0).cast("bigint").alias("f"), F.monotonically_increasing_id().alias("i"))))
