"""End-to-end pipelines: W13 ``build_warehouse`` and B42 ``report_bundle``.

Every step writes Parquet and the next step reads it back, so lineage is cut at each
layer and a lost executor only recomputes the current step. A run writes a folder of
its own and is published at its end by one small file that names it: runs beside each
other and runs that fail leave the published one as it is. The default output folder
lives under the shared ``spark.checkpoint.dir`` of the session.

Sales and returns are bucketed by order: joins of lines with their orders and returns and
groupings by (something, order) read them without an exchange.
"""

from __future__ import annotations

import os
import time
import uuid
from concurrent.futures import ThreadPoolExecutor
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import checks as V
from ..operators import mart as M
from ..operators import segmentation as S
from ..operators.warehouse import Warehouse
from ..session import own_session, scratch_path
from ..sources.binding import ROLES, Sources
from ..sources.bucketed import open_bucketed, write_bucketed
from ..sources.staging import Staged, stage
from ..sources.tables import Tables

WAREHOUSE_TABLES = ("dim_date", "dim_customer", "dim_product", "dim_store", "dim_zone", "dim_offer",
                    "dim_return_reason", "fact_sales", "fact_returns")


CURRENT = "current"  # no leading underscore: Spark does not read such files


def publish(spark: SparkSession, base: str, run: str) -> None:
    """Make ``run`` the published run of ``base``: one small file, replaced by an atomic rename."""
    jvm = spark._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    target, fresh = (jvm.org.apache.hadoop.fs.Path(f"{base}/{n}") for n in (CURRENT, f"{CURRENT}.{run}"))
    out = target.getFileSystem(conf).create(fresh, True)
    out.write(bytearray(run.encode()))
    out.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf).rename(fresh, target, options)


def published(spark: SparkSession, base: str) -> str:
    """Folder of the published run of ``base``."""
    return f"{base}/{spark.read.text(f'{base}/{CURRENT}').first()[0]}"


class BuiltWarehouse:
    """Warehouse tables read back from Parquet; same attribute names as ``Warehouse``."""

    def __init__(self, spark: SparkSession, path: str, n_buckets: int):
        self.spark = spark
        self.path = path
        self.n_buckets = n_buckets
        self._c: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in WAREHOUSE_TABLES:
            raise AttributeError(name)
        if name not in self._c:
            path = os.path.join(self.path, name)
            self._c[name] = open_bucketed(self.spark, path, "sale_id", self.n_buckets, "year") if name == "fact_sales" \
                else self.spark.read.parquet(path)
        return self._c[name]


class BuiltContext:
    """Reads a run written by ``build_warehouse``; reports run on it."""

    def __init__(self, spark: SparkSession, out_dir: str):
        self.spark = own_session(spark)
        self.out_dir = out_dir
        self.src = Staged(self.spark, os.path.join(out_dir, "stg"))
        self.wh = BuiltWarehouse(self.spark, os.path.join(out_dir, "dwh"), self.src._buckets())

    @classmethod
    def latest(cls, spark: SparkSession, base: str) -> "BuiltContext":
        """The published run of ``base``."""
        return cls(spark, published(spark, base))

    @property
    def profile(self) -> DataFrame:
        return self.src.profile

    @cached_property
    def mart(self) -> DataFrame:
        return self.spark.read.parquet(os.path.join(self.out_dir, "marts", "customer_360"))

    def with_fact(self) -> "BuiltContext":
        return self

    @cached_property
    def customer_zone(self) -> DataFrame:
        return M.customer_zone(self.wh.fact_sales, self.wh.dim_zone)


def _write(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def _write_all(jobs: list[tuple[DataFrame, str]], threads: int = 8) -> None:
    """Independent writes submitted as concurrent Spark jobs (one thread each)."""
    with ThreadPoolExecutor(max_workers=threads) as pool:
        for f in [pool.submit(_write, df, path) for df, path in jobs]:
            f.result()


def build_warehouse(spark: SparkSession, sf_dir: str, out_dir: str | None = None, *,
                    n_init: int = 10, expected_counts: dict | None = None,
                    rows_per_bucket: int | None = None) -> dict:
    """Stage -> dimensions -> facts -> checks -> mart -> clusters.

    Failed checks are reported, not fatal (the run continues, as in the original
    ETL). The run writes ``out_dir``/<run> and is published when it is complete. Returns the run's folder, per-step
    timings and the check summary.
    """
    base, run = out_dir or scratch_path(spark, "warehouse"), f"run-{uuid.uuid4().hex}"
    out_dir = f"{base}/{run}"
    spark = own_session(spark)
    timings, t0 = {}, time.time()
    staged = stage(Sources(Tables(spark, sf_dir)), os.path.join(out_dir, "stg"))
    timings["stage"] = time.time() - t0

    t = time.time()
    wh = Warehouse(staged, rows_per_bucket)
    dwh = os.path.join(out_dir, "dwh")
    _write_all([(getattr(wh, n), os.path.join(dwh, n)) for n in WAREHOUSE_TABLES if n.startswith("dim_")])
    timings["dimensions"] = time.time() - t

    # Facts are built against the written dimensions (no recomputation of keys).
    t = time.time()
    built = BuiltWarehouse(spark, dwh, staged._buckets())
    fs = Warehouse(staged, rows_per_bucket)
    for name in WAREHOUSE_TABLES:
        if name.startswith("dim_"):
            fs.__dict__[name] = getattr(built, name)
    write_bucketed(fs.fact_sales.withColumn("year", F.call_function("div", F.col("date_sk"), F.lit(10000)).cast("int")),
                   os.path.join(dwh, "fact_sales"), "sale_id", built.n_buckets, partition_by="year")
    fs.__dict__["fact_sales"] = built.fact_sales.drop("year")
    _write(fs.fact_returns, os.path.join(dwh, "fact_returns"))
    timings["facts"] = time.time() - t

    bw = BuiltWarehouse(spark, dwh, built.n_buckets)
    bw._c["fact_sales"] = built.fact_sales.drop("year")

    def run_checks():
        t = time.time()
        report = V.check_report(V.all_checks(bw, staged, expected_counts))
        _write(report, os.path.join(dwh, "check_report"))
        timings["checks"] = time.time() - t

    # The checks and the mart -> clusters chain only read the written warehouse:
    # they run as concurrent Spark jobs.
    with ThreadPoolExecutor(max_workers=1) as pool:
        checks_done = pool.submit(run_checks)
        t = time.time()
        marts = os.path.join(out_dir, "marts")
        _write(M.customer_360(bw.fact_sales, bw.dim_date, bw.dim_customer), os.path.join(marts, "customer_360_base"))
        timings["mart"] = time.time() - t

        t = time.time()
        mart = spark.read.parquet(os.path.join(marts, "customer_360_base"))
        labels, _, _ = S.segment(mart, n_init=n_init)
        _write(M.assign_clusters(mart, labels), os.path.join(marts, "customer_360"))
        timings["clusters"] = time.time() - t
        checks_done.result()
    summary = spark.read.parquet(os.path.join(dwh, "check_report")).select("total", "passed", "failed").first()
    publish(spark, base, run)
    timings["total"] = time.time() - t0
    return {"out_dir": out_dir, "timings": timings,
            "checks": {"total": summary["total"], "passed": summary["passed"], "failed": summary["failed"]}}


def _count_rows(df: DataFrame, **labels) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("row_count")).select(
        *[F.lit(v).alias(k) for k, v in labels.items()], "row_count")


def warehouse_summary(spark: SparkSession, out_dir: str) -> DataFrame:
    """Row count of every table ``build_warehouse`` wrote, counted from the files."""
    layers = (("stg", ROLES), ("dwh", WAREHOUSE_TABLES), ("marts", ("customer_360",)))
    parts = [_count_rows(spark.read.parquet(os.path.join(out_dir, layer, n)), layer=layer, table_name=n)
             for layer, names in layers for n in names]
    return reduce(DataFrame.unionByName, parts)


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def report_bundle(ctx, out_dir: str, sections: dict) -> DataFrame:
    """All report sections as JSON rows, one after another into a folder per section.

    Each section is a job of its own whose shuffle files go when it ends, so the disk holds those of one section
    and not of all. ``sections`` maps a section name to a callable(ctx) -> DataFrame. Returns what was written: section,
    row (JSON).
    """
    before = ctx.spark.conf.get(SHUFFLE_CLEANUP)
    ctx.spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        mode = "overwrite"
        for name, fn in sections.items():
            rows = fn(ctx).select(F.lit(name).alias("section"), F.to_json(F.struct("*")).alias("row"))
            rows.write.mode(mode).partitionBy("section").text(out_dir)
            mode = "append"
    finally:
        ctx.spark.conf.set(SHUFFLE_CLEANUP, before)
    return ctx.spark.read.schema("value string, section string").text(out_dir).select("section", F.col("value").alias("row"))


def bundle_values(bundle: DataFrame) -> DataFrame:
    """Per section and column: the number of values, the sum of the numbers and the length of all other values."""
    cells = bundle.select("section", F.explode(F.from_json("row", "map<string,string>")).alias("column_name", "value")).where("value is not null")
    number = F.expr("try_cast(value as double)")
    return cells.groupBy("section", "column_name").agg(
        F.count(F.lit(1)).alias("n_values"), F.round(F.sum(number), 3).alias("total"),
        F.coalesce(F.sum(F.when(number.isNull(), F.length("value"))), F.lit(0)).alias("chars"))
