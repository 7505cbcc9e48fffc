"""Warehouse operators (W): star schema with surrogate keys and unknown members.

Join strategy: no dimension carries a hint. Dimensions are stored (written by the
pipeline, or cached and filled when a query first needs them) before a fact joins
them, so the planner knows their size in bytes and decides between a broadcast and
a shuffle join by ``spark.sql.autoBroadcastJoinThreshold``; AQE splits skewed keys of
the latter.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from decimal import Decimal
from functools import cached_property, reduce
from operator import and_

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import date_key, day_name, iso_dow, month_name
from ..functions.exact import MONEY, round_div
from ..functions.ordering import dense_keys
from ..session import scratch_path
from ..sources.binding import Sources

# A line's key: line ids alone may meet those of another order.
LINE_KEY = ("sale_id", "sale_item_id")
UNKNOWN_SK = 1
UNKNOWN_NK = -1
UNKNOWN_POSTAL = "00000"


def _unknown_row(spark, schema_ddl: str, values: tuple) -> DataFrame:
    """One literal row; built on ``range(1)`` so the planner knows it is tiny."""
    fields = [f.strip().rsplit(" ", 1) for f in _split_ddl(schema_ddl)]
    cols = [F.lit(v).cast(t).alias(n) for (n, t), v in zip(fields, values)]
    return spark.range(1).select(*cols)


def _split_ddl(ddl: str) -> list[str]:
    out, depth, cur = [], 0, ""
    for ch in ddl:
        if ch == "," and depth == 0:
            out.append(cur)
            cur = ""
            continue
        depth += ch == "("
        depth -= ch == ")"
        cur += ch
    return out + [cur]


def _small_dim_keys(df: DataFrame, order_col: str, sk: str) -> DataFrame:
    """Surrogate keys for a dimension bounded by a fixed code list (one task is fine)."""
    return df.withColumn(sk, (F.row_number().over(Window.orderBy(order_col)) + 1).cast("long"))


# -- W11 -----------------------------------------------------------------
def returns_by_line(return_item: DataFrame) -> DataFrame:
    """Returned quantity per sale line (aggregated before the fact join).

    A line is known by (sale_id, sale_item_id). The lines are already partitioned by
    order, so the aggregate and the fact join reuse that partitioning instead of
    shuffling the lines by line id.
    """
    return return_item.groupBy(*LINE_KEY).agg(F.sum("quantity").cast("long").alias("returned_qty"))


# -- W02 -----------------------------------------------------------------
def dim_date(sale: DataFrame) -> DataFrame:
    """One row per calendar day between the first and last sale date."""
    bounds = sale.agg(F.min("sale_date").alias("lo"), F.max("sale_date").alias("hi"))
    days = bounds.select(F.explode(F.sequence("lo", "hi", F.expr("interval 1 day"))).alias("date"))
    d = F.col("date")
    return days.select(
        date_key(d).alias("date_sk"), d.alias("date"),
        F.year(d).alias("year"), F.quarter(d).alias("quarter"), F.month(d).alias("month"),
        month_name(F.month(d)).alias("month_name"), F.weekofyear(d).alias("week"),
        F.dayofmonth(d).alias("day"), iso_dow(d).alias("day_of_week"),
        day_name(d).alias("day_name"), (iso_dow(d) >= 6).alias("is_weekend"))


# -- W03 -----------------------------------------------------------------
def dim_customer(customer: DataFrame, rows_per_bucket: int | None = None) -> DataFrame:
    cols = ["customer_nk", "first_name", "last_name", "last_name2", "email", "phone",
            "created_at", "is_unknown"]
    rows = customer.select(
        F.col("customer_id").alias("customer_nk"), "first_name", "last_name", "last_name2",
        "email", "phone", "created_at", F.lit(False).alias("is_unknown"))
    keyed = dense_keys(rows, "customer_nk", "customer_sk", **_rpb(rows_per_bucket))
    unk = _unknown_row(customer.sparkSession,
                       "customer_sk long, customer_nk long, first_name string, last_name string, "
                       "last_name2 string, email string, phone string, created_at timestamp, "
                       "is_unknown boolean",
                       (UNKNOWN_SK, UNKNOWN_NK, "Unknown", "", None, None, None, None, True))
    return unk.unionByName(keyed.select("customer_sk", *cols))


def _rpb(rows_per_bucket):
    return {} if rows_per_bucket is None else {"rows_per_bucket": rows_per_bucket}


# -- W04 -----------------------------------------------------------------
def dim_product(product: DataFrame, central_product: DataFrame, category: DataFrame,
                brand: DataFrame, imputed_ids: tuple = (),
                rows_per_bucket: int | None = None) -> DataFrame:
    """product ⟕ central_product ⟕ category ⟕ brand; margin % on price."""
    cp = central_product.select("product_id", "category_id", "brand_id", "sku", "unit_cost")
    cat = category.select("category_id", F.col("name").alias("category"))
    br = brand.select("brand_id", F.col("name").alias("brand"))
    price = F.col("price")
    rows = (product.select("product_id", "name", "price")
            .join(cp, "product_id", "left")
            .join(cat, "category_id", "left")
            .join(br, "brand_id", "left")
            .select(F.col("product_id").alias("product_nk"), "name", "category", "brand",
                    price.alias("price"), F.col("unit_cost"),
                    round_div((price - F.col("unit_cost")) * 100, price, 2).alias("margin_pct"),
                    "sku",
                    F.col("product_id").isin(list(imputed_ids)).alias("cost_imputed")
                    if imputed_ids else F.lit(False).alias("cost_imputed"),
                    F.lit(False).alias("is_unknown")))
    # The keys take several passes over the rows: they are joined once and written.
    path = scratch_path(product.sparkSession, f"dim-product-{uuid.uuid4().hex}")
    rows.write.parquet(path)
    rows = product.sparkSession.read.schema(rows.schema).parquet(path)
    keyed = dense_keys(rows, "product_nk", "product_sk", **_rpb(rows_per_bucket))
    unk = _unknown_row(product.sparkSession,
                       f"product_sk long, product_nk long, name string, category string, brand string, "
                       f"price {MONEY}, unit_cost {MONEY}, margin_pct decimal(18,2), sku string, "
                       f"cost_imputed boolean, is_unknown boolean",
                       (UNKNOWN_SK, UNKNOWN_NK, "Unknown", None, None, None, None, None, None, False, True))
    return unk.unionByName(keyed.select(*unk.columns))


def product_groups(d_product: DataFrame) -> DataFrame:
    """Products that share name, category and brand, numbered by their smallest key; the unknown member's number is its key, 1."""
    return d_product.groupBy(F.col("name").alias("product"), "category", "brand").agg(F.min("product_sk").alias("product_group"))


# -- W05 -----------------------------------------------------------------
def dim_store(store: DataFrame, rows_per_bucket: int | None = None) -> DataFrame:
    rows = store.select(F.col("store_id").alias("store_nk"), "name", "address", "city",
                        "postal_code", "latitude", "longitude", F.lit(False).alias("is_unknown"))
    keyed = dense_keys(rows, "store_nk", "store_sk", **_rpb(rows_per_bucket))
    unk = _unknown_row(store.sparkSession,
                       "store_sk long, store_nk long, name string, address string, city string, "
                       "postal_code string, latitude double, longitude double, is_unknown boolean",
                       (UNKNOWN_SK, UNKNOWN_NK, "Unknown", None, None, None, None, None, True))
    return unk.unionByName(keyed.select(*unk.columns))


# -- W06 -----------------------------------------------------------------
def dim_zone(city_zone: DataFrame) -> DataFrame:
    rows = city_zone.select("postal_code", "district", "area_type",
                            F.col("zone_orientation").alias("orientation"), "city",
                            F.lit(False).alias("is_unknown"))
    keyed = _small_dim_keys(rows, "postal_code", "zone_sk")
    unk = _unknown_row(city_zone.sparkSession,
                       "zone_sk long, postal_code string, district string, area_type string, "
                       "orientation string, city string, is_unknown boolean",
                       (UNKNOWN_SK, UNKNOWN_POSTAL, "Unknown", None, None, None, True))
    return unk.unionByName(keyed.select(*unk.columns))


# -- W07 -----------------------------------------------------------------
def dim_offer(offer: DataFrame) -> DataFrame:
    rows = offer.select(F.col("offer_id").alias("offer_nk"), "name", "description",
                        F.col("discount_percent").cast("decimal(5,2)").alias("discount_pct"),
                        "start_date", "end_date", F.lit(False).alias("is_no_offer"))
    keyed = _small_dim_keys(rows, "offer_nk", "offer_sk")
    unk = _unknown_row(offer.sparkSession,
                       "offer_sk long, offer_nk long, name string, description string, "
                       "discount_pct decimal(5,2), start_date date, end_date date, is_no_offer boolean",
                       (UNKNOWN_SK, None, "No offer", "Sale without discount", Decimal(0), None, None, True))
    return unk.unionByName(keyed.select(*unk.columns))


# -- W08 -----------------------------------------------------------------
def dim_return_reason(return_reason: DataFrame) -> DataFrame:
    rows = return_reason.select(F.col("reason_id").alias("reason_nk"), "reason", "active",
                                F.lit(False).alias("is_unknown"))
    keyed = _small_dim_keys(rows, "reason_nk", "reason_sk")
    unk = _unknown_row(return_reason.sparkSession,
                       "reason_sk long, reason_nk long, reason string, active boolean, is_unknown boolean",
                       (UNKNOWN_SK, None, "Unknown", True, True))
    return unk.unionByName(keyed.select(*unk.columns))


# -- W10 -----------------------------------------------------------------
def fact_sales(sale_item: DataFrame, sale: DataFrame, d_date: DataFrame,
               d_customer: DataFrame, d_product: DataFrame, d_store: DataFrame,
               d_zone: DataFrame, d_offer: DataFrame, ret_by_line: DataFrame) -> DataFrame:
    """One row per sale line. Inner joins only on sale and date, so every line is kept;
    unmatched dimension keys fall back to the unknown member (sk 1).

    Customer, store and zone are attributes of the order header, so they are resolved
    on the headers (several times fewer rows than lines) before the header-line join;
    the lines meet the headers and their returns on the order key they are already
    partitioned by. Products too large for a broadcast are resolved for the distinct
    (order, product) pairs, which travel to the products and back: the lines themselves
    stay with their order, so the fact is partitioned by order whatever the join.
    """
    dd = d_date.select("date_sk")
    dc = d_customer.filter(~F.col("is_unknown")).select(F.col("customer_nk").alias("customer_id"), "customer_sk")
    dt = d_store.filter(~F.col("is_unknown")).select(F.col("store_nk").alias("store_id"), "store_sk", "postal_code")
    dz = d_zone.filter(~F.col("is_unknown")).select("postal_code", "zone_sk")
    heads = (sale.select("sale_id", "customer_id", "store_id", date_key(F.col("sale_date")).alias("date_sk"))
             .join(dd, "date_sk", "inner")
             .join(dc, "customer_id", "left")
             .join(dt, "store_id", "left")
             .join(dz, "postal_code", "left")
             .select("sale_id", "date_sk",
                     F.coalesce("customer_sk", F.lit(UNKNOWN_SK)).alias("customer_sk"),
                     F.coalesce("store_sk", F.lit(UNKNOWN_SK)).alias("store_sk"),
                     F.coalesce("zone_sk", F.lit(UNKNOWN_SK)).alias("zone_sk")))
    grouped = [c for c in ("product_group",) if c in d_product.columns]
    dp = d_product.filter(~F.col("is_unknown")).select(F.col("product_nk").alias("product_id"), "product_sk",
                                                       F.col("unit_cost").alias("_cost"), *grouped)
    do = d_offer.filter(~F.col("is_no_offer")).select(F.col("offer_nk").alias("offer_id"), "offer_sk")
    priced = sale_item.select("sale_id", "product_id").distinct().join(dp, "product_id", "inner")
    j = (sale_item.join(heads, "sale_id", "inner")
         .join(ret_by_line, list(LINE_KEY), "left")
         .join(priced, ["sale_id", "product_id"], "left")
         .join(do, "offer_id", "left"))
    q, sub, cost, up = F.col("quantity"), F.col("subtotal"), F.col("_cost"), F.col("unit_price")
    ret = F.coalesce(F.col("returned_qty"), F.lit(0)).cast("long")
    raw_margin = sub - q * cost
    return j.select(
        "date_sk", "customer_sk",
        F.coalesce("product_sk", F.lit(UNKNOWN_SK)).alias("product_sk"),
        "store_sk", "zone_sk",
        F.coalesce("offer_sk", F.lit(UNKNOWN_SK)).alias("offer_sk"),
        "sale_id", "sale_item_id",
        q.alias("quantity"), up.alias("unit_price"),
        sub.cast(MONEY).alias("gross_amount"),
        F.round(q * cost, 2).cast(MONEY).alias("cost_amount"),
        F.round(raw_margin, 2).cast(MONEY).alias("gross_margin"),
        F.when((sub > 0) & cost.isNotNull(), round_div(raw_margin * 100, sub, 2)).alias("margin_pct"),
        F.col("returned_qty").isNotNull().alias("is_returned"),
        ret.alias("returned_qty"),
        F.round(sub - ret * up, 2).cast(MONEY).alias("net_amount"),
        *[F.coalesce(c, F.lit(UNKNOWN_SK)).alias(c) for c in grouped])


# -- W12 -----------------------------------------------------------------
def fact_returns(return_item: DataFrame, f_sales: DataFrame, d_product: DataFrame,
                 d_reason: DataFrame, d_date: DataFrame) -> DataFrame:
    """One row per return; returns dated outside the date dimension are dropped.

    A line is known by (sale_id, sale_item_id): line ids of neighbouring orders can meet.
    """
    fv = f_sales.select(*LINE_KEY, "customer_sk", "product_sk", "store_sk", "unit_price")
    dp = d_product.select("product_sk", F.col("unit_cost").alias("_cost"))
    dm = d_reason.filter(~F.col("is_unknown")).select(F.col("reason_nk").alias("reason_id"), "reason_sk")
    dd = d_date.select("date_sk")
    r = return_item.withColumn("date_sk", date_key(F.col("return_date")))
    j = (r.join(fv, list(LINE_KEY), "left")
         .join(dp, "product_sk", "left")
         .join(dm, "reason_id", "left")
         .join(dd, "date_sk", "inner"))
    q = F.col("quantity")
    return j.select(
        "date_sk",
        F.coalesce("customer_sk", F.lit(UNKNOWN_SK)).alias("customer_sk"),
        F.coalesce("product_sk", F.lit(UNKNOWN_SK)).alias("product_sk"),
        F.coalesce("store_sk", F.lit(UNKNOWN_SK)).alias("store_sk"),
        F.coalesce("reason_sk", F.lit(UNKNOWN_SK)).alias("reason_sk"),
        "return_id", "sale_item_id",
        q.cast("long").alias("returned_qty"),
        F.round(q * F.col("unit_price"), 2).cast(MONEY).alias("returned_amount"),
        F.round(q * F.col("_cost"), 2).cast(MONEY).alias("returned_cost"))


@dataclass
class Warehouse:
    """The star schema built lazily from bound sources (W13 materialises it).

    With ``persist`` set, every table is kept (memory, then local disk) after its
    first use, so several reports in one session share one build; lost blocks are
    recomputed from lineage.
    """

    src: Sources
    rows_per_bucket: int | None = None
    persist: bool = False

    def _keep(self, df: DataFrame) -> DataFrame:
        return df.persist(StorageLevel.MEMORY_AND_DISK) if self.persist else df

    def _keep_filled(self, df: DataFrame) -> DataFrame:
        """A dimension, filled at once where it is kept: its size is known when a fact joins it."""
        df = self._keep(df)
        if self.persist:
            df.count()
        return df

    @cached_property
    def dim_date(self): return self._keep_filled(dim_date(self.src.sale))
    @cached_property
    def dim_customer(self): return self._keep_filled(dim_customer(self.src.customer, self.rows_per_bucket))
    @cached_property
    def dim_product(self):
        s = self.src
        return self._keep_filled(dim_product(s.product, s.central_product, s.category, s.brand,
                                      rows_per_bucket=self.rows_per_bucket))
    @cached_property
    def dim_store(self): return self._keep_filled(dim_store(self.src.store, self.rows_per_bucket))
    @cached_property
    def dim_zone(self): return self._keep_filled(dim_zone(self.src.city_zone))
    @cached_property
    def dim_offer(self): return self._keep_filled(dim_offer(self.src.offer))
    @cached_property
    def dim_return_reason(self): return self._keep_filled(dim_return_reason(self.src.return_reason))
    @cached_property
    def returns_by_line(self): return returns_by_line(self.src.return_item)
    def fact_sales_read_once(self) -> DataFrame:
        """The fact for a single reader, not kept: only the columns it takes are computed. Once ``fact_sales`` is kept, that one."""
        if "fact_sales" in self.__dict__:
            return self.fact_sales
        return self._fact_sales(self.dim_product)

    def _fact_sales(self, d_product: DataFrame) -> DataFrame:
        s = self.src
        return fact_sales(s.sale_item, s.sale, self.dim_date, self.dim_customer,
                          d_product, self.dim_store, self.dim_zone, self.dim_offer,
                          self.returns_by_line)

    @cached_property
    def product_groups(self): return self._keep_filled(product_groups(self.dim_product))

    @cached_property
    def fact_sales(self) -> DataFrame:
        """The fact. Where it is kept each line has the group of its product besides: reports by name, category or brand join the
        groups and send no line to its product."""
        if not self.persist:
            return self.fact_sales_read_once()
        p, g = self.dim_product.alias("p"), self.product_groups.alias("g")
        same = reduce(and_, [F.col(f"p.{a}").eqNullSafe(F.col(f"g.{b}")) for a, b in (("name", "product"), ("category", "category"), ("brand", "brand"))])
        products = p.join(g, same).select("p.product_sk", "p.product_nk", "p.unit_cost", "p.is_unknown", "g.product_group")
        return self._keep(self._fact_sales(self._keep_filled(products)))

    @cached_property
    def fact_returns(self):
        return self._keep(fact_returns(self.src.return_item, self.fact_sales, self.dim_product,
                                       self.dim_return_reason, self.dim_date))

    @property
    def spark(self):
        return self.src.spark


def stage_snapshot(profile: DataFrame) -> DataFrame:
    """Rows of every staged role, as observed when it was written (``sources.staging``)."""
    return profile.groupBy("table_name").agg(F.max("rows").alias("rows"))
