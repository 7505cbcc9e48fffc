"""Shared table access and intermediate tables of the training-data operators."""

from __future__ import annotations

import os
import uuid
import weakref

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

# Texts of some KB each: so many rows a batch are some MB on either side of a Python worker's pipe.
ARROW_ROWS = 1000
ARROW_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_FOLDERS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def workers_find_package(spark: SparkSession) -> None:
    """Let Python workers started on this machine import the package from where the driver did, and get small batches.

    On a cluster the package is shipped by spark-submit; a path that an executor does not have is ignored.
    """
    rows = int(spark.conf.get(ARROW_KEY))
    spark.conf.set(ARROW_KEY, str(min(rows, ARROW_ROWS) if rows > 0 else ARROW_ROWS))
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in known:
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, known)])


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a fresh Parquet table in the shared folder and read it back.

    Cuts the lineage in storage every executor sees, so a lost executor costs the
    tasks it ran and nothing that is already written. The shuffle files of the job go with it.
    """
    spark = df.sparkSession
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
    before = spark.conf.get(SHUFFLE_CLEANUP)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    _FOLDERS[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what ``materialize`` wrote for ``tables``; nothing that is still to run may read them. Other tables are left alone."""
    for df in tables:
        path = _FOLDERS.pop(df, None)
        if path:
            jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
            folder = jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(conf).delete(folder, True)


def crc_mod(col: str, n: int) -> Column:
    """crc32 of the value as text, modulo ``n``; null for a null value."""
    return F.pmod(F.crc32(F.col(col).cast("string")), F.lit(n))


def sha256_text(col: Column) -> Column:
    return F.sha2(col.cast("binary"), 256)
