"""Per-run context: bound sources, lazily built warehouse and mart."""

from __future__ import annotations

import uuid
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from ..operators import mart as M
from ..operators.warehouse import Warehouse
from ..session import own_session, scratch_path
from ..sources.binding import Sources, roles
from ..sources.profile import profile_of
from ..sources.staging import StagedAsUsed
from ..sources.tables import Tables


class Context:
    """Sources, warehouse and mart for one scale-factor folder.

    ``Context.shared`` memoises one context per (session, folder): its sources are staged once, each when it is first
    read, in a folder of its own under the shared checkpoint folder, and its tables persisted, so the registered queries of one run share them.
    Contexts of an application that has ended are let go.
    """

    _shared: dict = {}

    def __init__(self, spark: SparkSession, sf_dir: str, rows_per_bucket: int | None = None,
                 persist: bool = False):
        self.spark = spark
        self.sf_dir = sf_dir
        self.persist = persist
        self.raw = Tables(spark, sf_dir)
        bound = Sources(self.raw)
        self.src = StagedAsUsed(bound, scratch_path(spark, f"staged-{uuid.uuid4().hex}")) if persist else bound
        self.wh = Warehouse(self.src, rows_per_bucket, persist)

    @classmethod
    def shared(cls, spark: SparkSession, sf_dir: str) -> "Context":
        app = spark.sparkContext.applicationId
        key = (app, spark._jsparkSession.sessionUUID(), sf_dir)
        if key not in cls._shared:
            for old in [k for k in cls._shared if k[0] != app]:
                del cls._shared[old]
            cls._shared[key] = cls(own_session(spark), sf_dir, persist=True)
        return cls._shared[key]

    @cached_property
    def profile(self) -> DataFrame:
        """Profile of the sources: observed where they were staged, else one pass a table."""
        return self.src.profile if self.persist else profile_of(roles(self.src))

    @cached_property
    def mart(self) -> DataFrame:
        """The kept mart. It reads the fact once and does not keep it: queries that read both say so by ``with_fact``."""
        w = self.wh
        m = M.customer_360(w.fact_sales_read_once(), w.dim_date, w.dim_customer)
        return m.persist() if self.persist else m

    def with_fact(self) -> "Context":
        """This context with its fact kept, so that a mart built next reads the kept rows."""
        self.wh.fact_sales
        return self

    @cached_property
    def segmentation(self):
        """(labels, pca points, explained variance) from one K-Means run per context."""
        from ..operators import segmentation as S
        labels, pts, var = S.segment(self.mart)
        if self.persist:
            labels = labels.persist()
        return labels, pts, var

    @cached_property
    def customer_zone(self) -> DataFrame:
        return M.customer_zone(self.wh.fact_sales, self.wh.dim_zone)
