"""Bucketed Parquet tables: rows of one key in one file, so that joins and groupings by it need no exchange.

A bucketed table is a folder of files plus its bucket spec in the session's catalog. The name is derived from the
folder, so any session that knows the folder can declare the table again (``open_bucketed``) over the files.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession


def buckets(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _name(path: str) -> str:
    return "marketlens_" + hashlib.sha256(path.encode()).hexdigest()[:24]


def write_bucketed(df: DataFrame, path: str, key: str, n: int, partition_by: str | None = None, dealt: bool = False) -> None:
    """Write ``df`` hashed by ``key`` into ``n`` buckets, one file each; ``dealt`` says that its rows lie so already."""
    w = (df if dealt else df.repartition(n, key)).write.mode("overwrite").format("parquet").bucketBy(n, key).sortBy(key).option("path", path)
    if partition_by:
        w = w.partitionBy(partition_by)
    w.saveAsTable(_name(path))


def open_bucketed(spark: SparkSession, path: str, key: str, n: int, partition_by: str | None = None) -> DataFrame:
    """The table at ``path``, declared in this session's catalog if it is not yet."""
    name = _name(path)
    if not spark.catalog.tableExists(name):
        schema = spark.read.parquet(path).schema
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        parts = f"PARTITIONED BY ({partition_by})" if partition_by else ""
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet {parts} CLUSTERED BY ({key}) SORTED BY ({key}) INTO {n} BUCKETS "
                  f"LOCATION '{path}'")
        if partition_by:
            spark.catalog.recoverPartitions(name)
    return spark.table(name)
