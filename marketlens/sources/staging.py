"""Staging (W01): every bound role is written once; what the checks need to know is observed on the way.

``DataFrame.observe`` collects row counts, nulls, ranges, sums and rule violations of each role while its rows pass to
the writer, so no later query reads the lines for them. Order, line and return rows are bucketed by order key. The
profile and the bucket count are written beside the roles.
"""

from __future__ import annotations

import os
from concurrent.futures import ThreadPoolExecutor
from threading import RLock

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from . import profile as PR
from .binding import ROLES, Sources
from .bucketed import buckets, open_bucketed, write_bucketed

BY_ORDER = ("sale", "sale_item", "return_item")


class Staged:
    """Source roles read back from the staging folder, and their ``profile`` as observed at the write."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path
        self._c: dict[str, DataFrame] = {}

    @property
    def profile(self) -> DataFrame:
        return self.spark.read.schema(PR.SCHEMA).parquet(os.path.join(self.path, "_observed", "profile")).coalesce(1)

    def _buckets(self) -> int:
        return self.spark.read.parquet(os.path.join(self.path, "_observed", "buckets")).first()[0]

    def __getattr__(self, role: str) -> DataFrame:
        if role.startswith("_") or role not in ROLES:
            raise AttributeError(role)
        if role not in self._c:
            path = os.path.join(self.path, role)
            self._c[role] = open_bucketed(self.spark, path, "sale_id", self._buckets()) if role in BY_ORDER \
                else self.spark.read.parquet(path)
        return self._c[role]


def _write(source: Sources, role: str, df: DataFrame, path: str, n: int) -> list[tuple]:
    """Write one role as ``df``; its profile rows as observed on the way."""
    seen = Observation()
    out = df.observe(seen, *PR.measures(role, df)).drop(*PR.EXTRA.get(role, ()))
    to = os.path.join(path, role)
    if role in BY_ORDER:
        write_bucketed(out, to, "sale_id", n, dealt=role == "sale_item")
    else:
        out.write.mode("overwrite").parquet(to)
    return PR.rows_of(role, df, seen.get)


def _write_roles(source: Sources, names, path: str, n: int, threads: int) -> list[tuple]:
    """Write several roles at once; where lines are among them, the bound lines are kept for this step only."""
    lines = source._lines.persist(StorageLevel.MEMORY_AND_DISK) if "sale_item" in names else None

    def write(role: str) -> list[tuple]:
        return _write(source, role, source.sale_with_lines_total if role == "sale" else getattr(source, role), path, n)

    with ThreadPoolExecutor(max_workers=threads) as pool:
        rows = [r for part in pool.map(write, sorted(names, key=lambda r: r != "sale_item")) for r in part]
    if lines is not None:
        lines.unpersist()
    return rows


def stage(source: Sources, path: str, threads: int = 8) -> Staged:
    """Write all roles of ``source`` under ``path``. The bound lines feed five roles: they are kept for this step only."""
    spark = source.spark
    n = buckets(spark)
    rows = _write_roles(source, ROLES, path, n, threads)
    PR.profile_frame(spark, rows).coalesce(1).write.mode("overwrite").parquet(os.path.join(path, "_observed", "profile"))
    spark.range(1).select(F.lit(n).alias("buckets")).write.mode("overwrite").parquet(os.path.join(path, "_observed", "buckets"))
    return Staged(spark, path)


class StagedAsUsed(Staged):
    """Staging of a context: a role is written when it is first read, all of them when the profile is.

    Lines and returns share the bound lines and are written together (with the orders, if those are not there yet). Orders
    read alone take store and line total from a grouping of the raw lines; product-offer pairs come from the written lines.
    """

    def __init__(self, source: Sources, path: str, threads: int = 8):
        super().__init__(source.spark, path)
        self._source = source
        self._n = buckets(source.spark)
        self._threads = threads
        self._rows: list[tuple] = []
        self._done: set[str] = set()
        self._profile: DataFrame | None = None
        self._lock = RLock()

    def _buckets(self) -> int:
        return self._n

    def _ensure(self, *roles: str) -> None:
        with self._lock:
            missing = [r for r in roles if r not in self._done]
            if {"sale_item", "return_item"} & set(missing):
                self._stage([r for r in BY_ORDER if r not in self._done])
                self._source.__dict__["sale_item"] = self.sale_item
            elif "product_offer" in missing:
                self._ensure("sale_item")
            if "sale" in missing and "sale" not in self._done:
                self._rows += _write(self._source, "sale", self._source.sale_with_raw_lines_total, self.path, self._n)
                self._done.add("sale")
            self._stage([r for r in missing if r not in self._done])

    def _stage(self, names: list[str]) -> None:
        if names:
            self._rows += _write_roles(self._source, names, self.path, self._n, self._threads)
            self._done.update(names)

    @property
    def profile(self) -> DataFrame:
        with self._lock:
            if self._profile is None:
                self._ensure(*ROLES)
                PR.profile_frame(self.spark, self._rows).coalesce(1).write.mode("overwrite").parquet(
                    os.path.join(self.path, "_observed", "profile"))
                self._profile = super().profile
        return self._profile

    def __getattr__(self, role: str) -> DataFrame:
        if role in ROLES and role not in self._c:
            self._ensure(role)
        return super().__getattr__(role)
