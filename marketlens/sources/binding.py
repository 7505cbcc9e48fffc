"""Binding of the driver tables to the seventeen source roles of the retail model.

role            from                 rule
sale            orders (+ lineitem)  store_id = smallest supplier of the order's lines
sale_item       lineitem             sale_item_id = orderkey * 1000 + line position
product         part
central_product part                 cost = 60 % of price; none for size 50; 150 % for size 1
brand/category  part                 distinct p_brand / p_type (the name is the id)
offer           lineitem             one offer per non-zero discount step
customer        customer
store           supplier + nation    postal code = zero-padded nation key
city_zone       nation + region      nation 24 is left out (stores in an unknown zone)
return_item     lineitem + orders    lines flagged 'R'; half the quantity, rounded up
return_reason   orders + fixed names codes in use with a name, 1..4 (5 left out: unknown reason)

Lineitem is hash-partitioned once by order key; sale, sale_item and
return_item all derive from that one exchange.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exact import MONEY, round_div
from .bucketed import buckets
from .tables import Tables

# Fixed values of the binding.
LINES_PER_ORDER = 1000          # sale_item_id = order key * 1000 + position
COST_SHARE = "0.60"             # unit cost = 60 % of price
COST_SHARE_SIZE_1 = "1.50"      # size-1 parts cost 150 % of price
NO_COST_SIZE = 50               # size-50 parts have no cost
OFFER_START, OFFER_END = "1995-01-01", "1998-12-31"
MISSING_ZONE_NATION = 24
ORIENTATIONS = ("North", "South", "East", "West")   # by nation key mod 4
RETURN_REASONS = ((1, "Defective product"), (2, "Wrong size"),
                  (3, "Not as described"), (4, "Changed mind"))


def _postal(nationkey) -> F.Column:
    return F.lpad(F.col(nationkey).cast("string"), 5, "0")


@dataclass
class Sources:
    """The seventeen source roles as DataFrames (inventory/warehouse roles have
    no counterpart in the driver tables and are only built in unit tests)."""

    raw: Tables

    @property
    def spark(self):
        return self.raw.spark

    # -- line level -------------------------------------------------------
    @cached_property
    def _lines(self) -> DataFrame:
        li = self.raw.lineitem.select(
            F.col("l_orderkey").alias("sale_id"), "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate",
            "l_quantity", "l_extendedprice", "l_discount", "l_returnflag")
        # One hash exchange by order key, as the staged tables are bucketed; every derived role keeps that partitioning.
        li = li.repartition(buckets(self.spark), "sale_id")
        by_order = Window.partitionBy("sale_id")
        pos = F.row_number().over(by_order.orderBy(
            "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"))
        return li.select(
            "sale_id",
            (F.col("sale_id") * LINES_PER_ORDER + pos).alias("sale_item_id"),
            F.col("l_partkey").alias("product_id"),
            F.col("l_quantity").cast("long").alias("quantity"),
            F.col("l_extendedprice").cast(MONEY).alias("subtotal"),
            F.round(F.col("l_discount") * 100).cast("long").alias("discount_pct"),
            F.col("l_suppkey").alias("line_store_id"),
            F.col("l_returnflag").alias("return_flag"),
            F.to_date("l_shipdate").alias("ship_date"))

    @cached_property
    def sale_item(self) -> DataFrame:
        l = self._lines
        return l.select(
            "sale_item_id", "sale_id", "product_id", "quantity",
            round_div(F.col("subtotal"), F.col("quantity"), 2).alias("unit_price"),
            F.when(F.col("discount_pct") != 0, F.col("discount_pct")).alias("offer_id"),
            "subtotal")

    @cached_property
    def sale(self) -> DataFrame:
        return self.sale_with_lines_total.drop("lines_total")

    @cached_property
    def sale_with_lines_total(self) -> DataFrame:
        """Orders with the sum of their lines (null without lines)."""
        return self._orders_with(self._lines.groupBy("sale_id").agg(
            F.min("line_store_id").alias("store_id"), F.sum("subtotal").alias("lines_total")))

    @cached_property
    def sale_with_raw_lines_total(self) -> DataFrame:
        """The same from the raw lines, where nothing else needs them dealt by order: one row an order and task travels."""
        return self._orders_with(self.raw.lineitem.groupBy(F.col("l_orderkey").alias("sale_id")).agg(
            F.min("l_suppkey").alias("store_id"), F.sum(F.col("l_extendedprice").cast(MONEY)).alias("lines_total")))

    def _orders_with(self, store: DataFrame) -> DataFrame:
        o = self.raw.orders.select(
            F.col("o_orderkey").alias("sale_id"),
            F.col("o_custkey").alias("customer_id"),
            F.to_date("o_orderdate").alias("sale_date"),
            F.col("o_totalprice").cast(MONEY).alias("total"))
        return o.join(store, "sale_id", "left").select(
            "sale_id", "customer_id", "store_id", "sale_date", "total", "lines_total")

    @cached_property
    def return_item(self) -> DataFrame:
        r = self._lines.filter(F.col("return_flag") == "R")
        prio = self.raw.orders.select(
            F.col("o_orderkey").alias("sale_id"),
            F.substring("o_orderpriority", 1, 1).cast("long").alias("reason_id"))
        # sale_id rides along so returns stay co-partitioned with their lines.
        return r.join(prio, "sale_id", "left").select(
            F.col("sale_item_id").alias("return_id"), "sale_item_id", "sale_id",
            F.col("ship_date").alias("return_date"),
            F.ceil(F.col("quantity") / 2).cast("long").alias("quantity"),
            "reason_id")

    @cached_property
    def product_offer(self) -> DataFrame:
        """Product-offer pairs seen on the lines."""
        return (self.sale_item.filter(F.col("offer_id").isNotNull())
                .select("product_id", "offer_id").distinct())

    @cached_property
    def return_reason(self) -> DataFrame:
        """Reason codes in use (leading digit of the order priority) that have a name."""
        names = F.create_map(*[x for i, r in RETURN_REASONS for x in (F.lit(i).cast("long"), F.lit(r))])
        used = (self.raw.orders
                .select(F.substring("o_orderpriority", 1, 1).cast("long").alias("reason_id"))
                .distinct())
        return (used.select("reason_id", F.element_at(names, F.col("reason_id")).alias("reason"),
                            F.lit(True).alias("active"))
                .filter(F.col("reason").isNotNull()))

    @cached_property
    def offer(self) -> DataFrame:
        steps = (self.raw.lineitem
                 .select(F.round(F.col("l_discount") * 100).cast("long").alias("offer_id"))
                 .filter(F.col("offer_id") != 0).distinct())
        return steps.select(
            "offer_id",
            F.concat(F.lit("Discount "), F.col("offer_id").cast("string"), F.lit("%")).alias("name"),
            F.concat(F.col("offer_id").cast("string"), F.lit("% off the line")).alias("description"),
            F.col("offer_id").cast("decimal(5,2)").alias("discount_percent"),
            F.lit(OFFER_START).cast("date").alias("start_date"),
            F.lit(OFFER_END).cast("date").alias("end_date"))

    # -- catalogue --------------------------------------------------------
    @cached_property
    def product(self) -> DataFrame:
        return self.raw.part.select(
            F.col("p_partkey").alias("product_id"), F.col("p_name").alias("name"),
            F.col("p_type").alias("category"),
            F.col("p_retailprice").cast(MONEY).alias("price"),
            F.lit(None).cast("timestamp").alias("created_at"))

    @cached_property
    def central_product(self) -> DataFrame:
        p = self.raw.part
        price = F.col("p_retailprice").cast(MONEY)
        cost = (F.when(F.col("p_size") == NO_COST_SIZE, F.lit(None).cast(MONEY))
                .when(F.col("p_size") == 1, F.round(price * F.lit(COST_SHARE_SIZE_1).cast("decimal(3,2)"), 2))
                .otherwise(F.round(price * F.lit(COST_SHARE).cast("decimal(3,2)"), 2)))
        return p.select(
            F.col("p_partkey").alias("product_id"), F.col("p_name").alias("name"),
            F.col("p_type").alias("category_id"), F.col("p_brand").alias("brand_id"),
            F.concat(F.lit("SKU-"), F.col("p_partkey").cast("string")).alias("sku"),
            F.lit(None).cast("string").alias("barcode"),
            cost.cast(MONEY).alias("unit_cost"), price.alias("unit_price"))

    @cached_property
    def category(self) -> DataFrame:
        return (self.raw.part.select(F.col("p_type").alias("category_id")).distinct()
                .select("category_id", F.col("category_id").alias("name"),
                        F.lit(None).cast("string").alias("description")))

    @cached_property
    def brand(self) -> DataFrame:
        return (self.raw.part.select(F.col("p_brand").alias("brand_id")).distinct()
                .select("brand_id", F.col("brand_id").alias("name"),
                        F.lit(None).cast("string").alias("country"),
                        F.lit(None).cast("string").alias("website")))

    # -- people and places ------------------------------------------------
    @cached_property
    def customer(self) -> DataFrame:
        return self.raw.customer.select(
            F.col("c_custkey").alias("customer_id"),
            F.lit("Customer").alias("first_name"),
            F.substring_index("c_name", "#", -1).alias("last_name"),
            F.lit(None).cast("string").alias("last_name2"),
            F.lit(None).cast("string").alias("email"),
            F.lit(None).cast("string").alias("phone"),
            F.lit(None).cast("timestamp").alias("created_at"))

    @cached_property
    def store(self) -> DataFrame:
        s = self.raw.supplier.select("s_suppkey", "s_name", "s_nationkey")
        n = self.raw.nation.select("n_nationkey", "n_name")
        return s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey, "left").select(
            F.col("s_suppkey").alias("store_id"), F.col("s_name").alias("name"),
            F.lit(None).cast("string").alias("address"), F.col("n_name").alias("city"),
            _postal("s_nationkey").alias("postal_code"),
            F.lit(None).cast("double").alias("latitude"),
            F.lit(None).cast("double").alias("longitude"),
            F.lit(None).cast("date").alias("opened_date"))

    @cached_property
    def city_zone(self) -> DataFrame:
        n = self.raw.nation.filter(F.col("n_nationkey") != MISSING_ZONE_NATION)
        r = self.raw.region
        orient = F.element_at(F.array(*[F.lit(o) for o in ORIENTATIONS]),
                              (F.col("n_nationkey") % 4 + 1).cast("int"))
        return n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey, "left").select(
            _postal("n_nationkey").alias("postal_code"), F.col("n_name").alias("district"),
            F.col("r_name").alias("area_type"), orient.alias("zone_orientation"),
            F.col("n_nationkey").cast("string").alias("city_code"),
            F.col("n_name").alias("city"))


ROLES = ("product", "central_product", "brand", "category", "sale", "sale_item", "offer",
         "product_offer", "store", "customer", "city_zone", "return_item", "return_reason")


def roles(src: Sources) -> dict[str, DataFrame]:
    """The bound source roles by name (inventory and warehouse roles have no binding)."""
    return {r: getattr(src, r) for r in ROLES}


def bind(spark, sf_dir: str) -> Sources:
    return Sources(Tables(spark, sf_dir))
