"""Data-quality audit (Q) over the bound source roles.

Each check is one aggregate pass per table (all column null counts in one
``agg``), unioned into a long result. Orphan checks pre-aggregate the child
key (count per value, map-side combined) before the anti join, so only
distinct key values cross the shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exact import MONEY, ratio, round_div
from ..functions.quantiles import constant, quantiles_of
from ..functions.output import attach
from ..sources.profile import subtotal_bad

# Source systems and the tables they own.
SYSTEMS = {
    "ERP": ("product", "central_product", "brand", "category", "sale", "sale_item", "offer",
            "product_offer", "store", "inventory"),
    "CRM": ("customer", "city_zone"),
    "Logistics": ("warehouse", "warehouse_location", "central_inventory"),
    "Post-sale": ("return_item", "return_reason"),
}

# Foreign keys (child, column, parent, column): the audited list plus
# the two relations the audit left out.
FOREIGN_KEYS = (
    ("sale", "customer_id", "customer", "customer_id"),
    ("sale", "store_id", "store", "store_id"),
    ("sale_item", "sale_id", "sale", "sale_id"),
    ("sale_item", "product_id", "product", "product_id"),
    ("sale_item", "offer_id", "offer", "offer_id"),
    ("return_item", "sale_item_id", "sale_item", "sale_item_id"),
    ("return_item", "reason_id", "return_reason", "reason_id"),
    ("inventory", "store_id", "store", "store_id"),
    ("inventory", "product_id", "product", "product_id"),
    ("central_product", "category_id", "category", "category_id"),
    ("central_product", "brand_id", "brand", "brand_id"),
    ("product_offer", "product_id", "product", "product_id"),
    ("product_offer", "offer_id", "offer", "offer_id"),
    ("central_inventory", "product_id", "product", "product_id"),
    ("warehouse_location", "warehouse_id", "warehouse", "warehouse_id"),
    ("central_inventory", "location_id", "warehouse_location", "location_id"),
    ("central_inventory", "warehouse_id", "warehouse", "warehouse_id"),
)

# The ten relations of the final certification.
CERTIFIED_KEYS = (
    ("sale", "customer_id", "customer", "customer_id"),
    ("sale", "store_id", "store", "store_id"),
    ("sale_item", "sale_id", "sale", "sale_id"),
    ("sale_item", "product_id", "product", "product_id"),
    ("return_item", "sale_item_id", "sale_item", "sale_item_id"),
    ("return_item", "reason_id", "return_reason", "reason_id"),
    ("inventory", "store_id", "store", "store_id"),
    ("inventory", "product_id", "product", "product_id"),
    ("central_product", "category_id", "category", "category_id"),
    ("central_product", "brand_id", "brand", "brand_id"),
)

# The formats audited.
EMAIL_PATTERN = r"^[^@\s]+@[^@\s]+\.[^@\s]{2,}$"
POSTAL_PATTERN = r"^\d{5}$"


def system_of(table: str) -> str:
    for s, ts in SYSTEMS.items():
        if table in ts:
            return s
    return "?"


def _union(dfs):
    return reduce(lambda a, b: a.unionByName(b), dfs)


def _system_col(table_col: str = "table_name"):
    expr = None
    for s, ts in SYSTEMS.items():
        cond = F.col(table_col).isin(list(ts))
        expr = F.when(cond, F.lit(s)) if expr is None else expr.when(cond, F.lit(s))
    return expr.otherwise(F.lit("?"))


# -- Q01 / Q02 -----------------------------------------------------------------
# Counts, nulls and ranges come from a profile (``sources.profile``): observed at staging, or one pass a table.
def _counts(profile: DataFrame) -> DataFrame:
    return profile.groupBy("table_name").agg(F.max("rows").alias("rows"))


def table_row_counts(profile: DataFrame) -> DataFrame:
    c = _counts(profile)
    tot = c.agg(F.sum("rows").alias("_all"))
    return c.transform(attach, tot).select(
        "table_name", "rows", (ratio(F.col("rows"), F.col("_all")) * 100).alias("pct_of_total"))


def rows_by_system(profile: DataFrame) -> DataFrame:
    c = _counts(profile).withColumn("system", _system_col())
    return c.groupBy("system").agg(F.count(F.lit(1)).alias("tables"), F.sum("rows").alias("rows"))


# -- Q05 / Q06 -------------------------------------------------------------------
def null_profile(profile: DataFrame) -> DataFrame:
    """Nulls, total and % per column."""
    return profile.select("table_name", "column_name", "nulls", F.col("rows").alias("total")) \
        .withColumn("pct_nulls", round_div(F.col("nulls") * 100, F.col("total"), 2))


def null_summary(profile: DataFrame) -> DataFrame:
    return profile.groupBy("table_name").agg(
        F.max("total").alias("rows"),
        F.count(F.when(F.col("nulls") > 0, 1)).alias("columns_with_nulls"),
        F.coalesce(F.max(F.when(F.col("nulls") > 0, F.col("pct_nulls"))),
                   F.lit(0).cast("decimal(18,2)")).alias("max_pct_nulls")
    ).withColumn("system", _system_col())


# -- Q07 / Q08 -------------------------------------------------------------------
def exact_duplicates(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows that equal another row of their table: hash, then verify.

    One scan of every table counts its rows per 128-bit hash. Only a table with repeated hashes is read again, for the rows
    behind them, which are compared whole.
    """
    def hashes(df: DataFrame):
        cols = [F.col(f"`{c}`") for c in df.columns]
        return [F.xxhash64(F.lit(k), *cols).alias(f"__h{k}") for k in (1, 2)]

    per_hash = {t: df.select(*hashes(df)).groupBy("__h1", "__h2").agg(F.count(F.lit(1)).alias("n")) for t, df in tables.items()}
    counted = _union([h.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count(F.when(F.col("n") == 1, 1)).alias("single"),
                            F.count(F.when(F.col("n") > 1, 1)).alias("repeated")).withColumn("table_name", F.lit(t))
                      for t, h in per_hash.items()]).collect()
    parts = []
    for r in counted:
        t = r["table_name"]
        df = tables[t]
        kinds = F.lit(0)
        one = df.sparkSession.range(1)
        if r["repeated"]:
            again = df.select("*", *hashes(df)).join(per_hash[t].where("n > 1"), ["__h1", "__h2"], "left_semi").select(*df.columns)
            one = again.distinct().agg(F.count(F.lit(1)).alias("_kinds"))
            kinds = F.col("_kinds")
        parts.append(one.select(F.lit(t).alias("table_name"), F.lit(r["total"]).cast("long").alias("total"),
                                (F.lit(r["single"]).cast("long") + kinds).alias("distinct_rows")))
    out = _union(parts).withColumn("duplicates", F.col("total") - F.col("distinct_rows"))
    return out.withColumn("pct_duplicates", F.coalesce(ratio(F.col("duplicates"), F.col("total")) * 100,
                                                       F.lit(0.0)))


def logical_duplicates(df: DataFrame, keys=("first_name", "last_name")) -> DataFrame:
    """Key groups that occur more than once, with the number of rows they cover."""
    groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("occurrences")).filter(F.col("occurrences") > 1)
    affected = df.join(groups.select(*keys), list(keys), "left_semi").agg(
        F.count(F.lit(1)).alias("affected_rows"))
    return groups.transform(attach, affected)


# -- Q09 / Q10 / Q11 ---------------------------------------------------------------
def length_distribution(df: DataFrame, column: str, expected: int) -> DataFrame:
    v = df.filter(F.col(column).isNotNull()).select(F.length(column).alias("length"))
    per = v.groupBy("length").agg(F.count(F.lit(1)).alias("rows"))
    tot = v.agg(F.count(F.lit(1)).alias("_all"))
    return per.transform(attach, tot).select(
        "length", "rows", (ratio(F.col("rows"), F.col("_all")) * 100).alias("pct"),
        (F.col("length") == expected).alias("ok"))


def pattern_check(df: DataFrame, column: str, pattern: str) -> DataFrame:
    v = df.filter(F.col(column).isNotNull()).select(F.col(column).rlike(pattern).alias("valid"))
    return v.agg(F.count(F.lit(1)).alias("total"),
                 F.count(F.when(F.col("valid"), 1)).alias("valid"),
                 F.count(F.when(~F.col("valid"), 1)).alias("invalid"))


def email_format(df: DataFrame, column: str = "email", pattern: str = EMAIL_PATTERN) -> DataFrame:
    return pattern_check(df, column, pattern)


def postal_format(df: DataFrame, column: str = "postal_code", pattern: str = POSTAL_PATTERN) -> DataFrame:
    return pattern_check(df, column, pattern)


# -- Q12 / Q13 / Q14 / Q15 -----------------------------------------------------------
def date_range(sale: DataFrame, as_of=None, floor_date: str = "2000-01-01") -> DataFrame:
    ref = F.current_date() if as_of is None else F.lit(as_of).cast("date")
    d = F.col("sale_date")
    return sale.agg(F.min(d).alias("first_date"), F.max(d).alias("last_date"),
                    F.count(F.when(d > ref, 1)).alias("future_rows"),
                    F.count(F.when(d < F.lit(floor_date).cast("date"), 1)).alias("rows_before_floor"))


def _product_costs(product: DataFrame, central_product: DataFrame) -> DataFrame:
    return product.select("product_id", "name", "price").join(
        central_product.select("product_id", "unit_cost"), "product_id", "inner")


def price_ranges(product: DataFrame, central_product: DataFrame) -> DataFrame:
    p = _product_costs(product, central_product)
    price, cost = F.col("price"), F.col("unit_cost")
    return p.agg(
        F.count(F.when(price <= 0, 1)).alias("price_nonpositive"),
        F.count(F.when(cost <= 0, 1)).alias("cost_nonpositive"),
        F.count(F.when(price < cost, 1)).alias("price_below_cost"),
        F.count(F.when(round_div((price - cost) * 100, price, 2) < 0, 1)).alias("negative_margins"),
        F.min(price).alias("price_min"), F.max(price).alias("price_max"),
        F.min(cost).alias("cost_min"), F.max(cost).alias("cost_max"))


def _one(profile: DataFrame, table: str, column: str, **wanted: str) -> list:
    """Aggregates that read measures (alias=measure) of one column off a profile."""
    mine = (F.col("table_name") == table) & (F.col("column_name") == column)
    return [F.max(F.when(mine, F.col(measure))).alias(alias) for alias, measure in wanted.items()]


def line_ranges(profile: DataFrame) -> DataFrame:
    """Ranges of the sale lines, from their profile."""
    money = profile.agg(
        *_one(profile, "sale_item", "quantity", quantity_nonpositive="nonpositive", quantity_min="lowest", quantity_max="highest"),
        *_one(profile, "sale_item", "unit_price", unit_price_nonpositive="nonpositive", unit_price_min="lowest", unit_price_max="highest"),
        *_one(profile, "sale_item", "subtotal", subtotal_nonpositive="nonpositive", subtotal_inconsistent="violations",
              subtotal_min="lowest", subtotal_max="highest"))
    return money.select(*[F.col(c).cast("long") if c in ("quantity_min", "quantity_max") else F.col(c) for c in money.columns])


def product_margins(product: DataFrame, central_product: DataFrame, lo: int = 20, hi: int = 60) -> DataFrame:
    p = _product_costs(product, central_product)
    m = round_div((F.col("price") - F.col("unit_cost")) * 100, F.col("price"), 2)
    return p.select("product_id", "name", "price", "unit_cost", m.alias("margin_pct")).select(
        "*", (F.col("margin_pct") < 0).alias("is_negative"),
        ((F.col("margin_pct") < lo) | (F.col("margin_pct") > hi)).alias("is_outlier"))


# -- Q16 -----------------------------------------------------------------------------
def fk_orphans(tables: dict[str, DataFrame], relations=FOREIGN_KEYS) -> DataFrame:
    """Non-null child keys without a parent row, per relation present in ``tables``.

    One pass: every child table is read once and unpivoted to its distinct (relation, key) with counts; one anti join meets
    all of them with the parents' keys.
    """
    used = [(i, r) for i, r in enumerate(relations) if r[0] in tables and r[2] in tables]
    parents = sorted({(r[2], r[3]) for _, r in used})

    def key(column: str):
        # A sale line is known by its order and line id together.
        if column == "sale_item_id":
            return F.concat_ws(":", F.col("sale_id").cast("string"), F.col(column).cast("string"))
        return F.col(column).cast("string")

    children = []
    for child in dict.fromkeys(r[0] for _, r in used):
        own = [F.struct(F.lit(i).alias("relation"), F.lit(parents.index((r[2], r[3]))).alias("parent"),
                        F.when(F.col(r[1]).isNotNull(), key(r[1])).alias("key")) for i, r in used if r[0] == child]
        children.append(tables[child].select(F.inline(F.array(*own))).where("key is not null")
                        .groupBy("relation", "parent", "key").agg(F.count(F.lit(1)).alias("n")))
    known = []
    for table in dict.fromkeys(t for t, _ in parents):
        own = [F.struct(F.lit(i).alias("parent"), key(pk).alias("key")) for i, (t, pk) in enumerate(parents) if t == table]
        known.append(tables[table].select(F.inline(F.array(*own))))
    lost = _union(children).join(_union(known), ["parent", "key"], "left_anti") \
        .groupBy("relation").agg(F.sum("n").alias("orphans"))
    names = tables[used[0][1][0]].sparkSession.range(1).select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("relation"), F.lit(f"{r[0]}.{r[1]} -> {r[2]}.{r[3]}").alias("name"), F.lit(r[0]).alias("child_table"),
                 F.lit(r[1]).alias("fk_column"), F.lit(r[2]).alias("parent_table")) for i, r in used])))
    return names.join(lost, "relation", "left").select(
        F.col("name").alias("relation"), "child_table", "fk_column", "parent_table", F.coalesce("orphans", F.lit(0)).alias("orphans"))


# -- Q17 / Q18 / Q19 / Q20 / Q21 -------------------------------------------------------
def order_total_mismatch(sale: DataFrame, sale_item: DataFrame) -> DataFrame:
    sums = sale_item.groupBy("sale_id").agg(F.sum("subtotal").alias("computed_total"))
    j = sale.select("sale_id", "total").join(sums, "sale_id", "inner")
    d = F.col("total") - F.col("computed_total")
    return j.filter(F.abs(d) > F.lit("0.01").cast("decimal(3,2)")).select(
        "sale_id", "total", F.col("computed_total").cast(MONEY).alias("computed_total"),
        d.cast(MONEY).alias("difference"))


def line_subtotal_mismatch(sale_item: DataFrame) -> DataFrame:
    q, up, sub = F.col("quantity"), F.col("unit_price"), F.col("subtotal")
    return sale_item.filter(subtotal_bad()).select(
        "sale_id", "sale_item_id", "quantity", "unit_price", "subtotal",
        F.round(q * up, 2).cast(MONEY).alias("computed_subtotal"),
        F.round(sub - q * up, 2).cast(MONEY).alias("difference"))


def margin_by_category(product: DataFrame, central_product: DataFrame, category: DataFrame,
                       spread: int = 5) -> DataFrame:
    p = product.select("product_id", "price").join(
        central_product.select("product_id", "unit_cost", "category_id"), "product_id", "inner").join(
        category.select("category_id", F.col("name").alias("category")), "category_id", "inner")
    m = round_div((F.col("price") - F.col("unit_cost")) * 100, F.col("price"), 2)
    a = p.withColumn("m", m).groupBy("category").agg(
        F.count("product_id").alias("products"), F.min("m").alias("margin_min"),
        F.max("m").alias("margin_max"), round_div(F.sum("m"), F.count("m"), 2).alias("margin_avg"))
    return a.withColumn("inconsistent", (F.col("margin_max") - F.col("margin_min")) > spread)


def returns_before_sale(return_item: DataFrame, sale_item: DataFrame, sale: DataFrame) -> DataFrame:
    j = (return_item.select("sale_id", "sale_item_id", "return_date")
         .join(sale_item.select("sale_id", "sale_item_id"), ["sale_id", "sale_item_id"])
         .join(sale.select("sale_id", "sale_date"), "sale_id"))
    return j.agg(F.count(F.when(F.col("return_date") < F.col("sale_date"), 1)).alias("cases"))


def sales_outside_offer(sale_item: DataFrame, sale: DataFrame, offer: DataFrame) -> DataFrame:
    o = offer.select("offer_id", "start_date", "end_date")
    j = (sale_item.filter(F.col("offer_id").isNotNull()).select("sale_id", "offer_id")
         .join(sale.select("sale_id", "sale_date"), "sale_id").join(o, "offer_id"))
    d = F.col("sale_date")
    return j.agg(F.count(F.when((d < F.col("start_date")) | (d > F.col("end_date")), 1)).alias("cases"))


# -- Q22 / Q24 -----------------------------------------------------------------------------
def quality_score(tables: dict[str, DataFrame], profile: DataFrame, relations=FOREIGN_KEYS) -> DataFrame:
    """100 - 10/column >10 % nulls - 3/column with some nulls - 15 if exact duplicates
    - 20 per relation with orphans, floored at 0. Failures raise (F28)."""
    prof = null_profile(profile)
    nulls = prof.groupBy("table_name").agg(
        F.count(F.when(F.col("pct_nulls") > 10, 1)).alias("cols_over_10"),
        F.count(F.when((F.col("pct_nulls") > 0) & (F.col("pct_nulls") <= 10), 1)).alias("cols_some"))
    dups = exact_duplicates(tables).select("table_name", "duplicates")
    fk = fk_orphans(tables, relations).groupBy(F.col("child_table").alias("table_name")).agg(
        F.count(F.when(F.col("orphans") > 0, 1)).alias("fk_with_orphans"))
    j = nulls.join(dups, "table_name").join(fk, "table_name", "left").fillna(0, ["fk_with_orphans"])
    score = (F.lit(100) - F.col("cols_over_10") * 10 - F.col("cols_some") * 3
             - F.when(F.col("duplicates") > 0, 15).otherwise(0) - F.col("fk_with_orphans") * 20)
    score = F.greatest(score, F.lit(0)).cast("long")
    return j.select("table_name", _system_col().alias("system"), score.alias("score"),
                    "cols_over_10", "cols_some", "duplicates", "fk_with_orphans").withColumn(
        "color", F.when(F.col("score") >= 90, "green").when(F.col("score") >= 70, "yellow").otherwise("red"))


def quality_score_delta(before: dict[str, DataFrame], profile_before: DataFrame, after: dict[str, DataFrame],
                        profile_after: DataFrame) -> DataFrame:
    b = quality_score(before, profile_before).select("table_name", F.col("score").alias("score_before"))
    a = quality_score(after, profile_after).select("table_name", F.col("score").alias("score_after"))
    j = b.join(a, "table_name", "full")
    means = j.agg(F.avg("score_before").alias("mean_before"), F.avg("score_after").alias("mean_after"))
    return j.withColumn("delta", F.col("score_after") - F.col("score_before")).transform(attach, means)


# -- Q23 ------------------------------------------------------------------------------------
def store_opening_check(store: DataFrame, sale: DataFrame) -> DataFrame:
    first = sale.groupBy("store_id").agg(F.min("sale_date").alias("first_sale"))
    return store.select("store_id", "name", "opened_date").join(first, "store_id", "inner").withColumn(
        "sold_before_opening", F.col("first_sale") < F.col("opened_date"))


# -- Q25 / Q26 / Q27 / Q28 -------------------------------------------------------------------
def issue_list(src_tables: dict[str, DataFrame], profile: DataFrame) -> DataFrame:
    """Issues found by the other checks, each tagged with a type and a severity."""
    t = src_tables
    fk = fk_orphans(t).select(F.concat(F.lit("orphans "), F.col("relation")).alias("issue"),
                              F.lit("referential integrity").alias("issue_type"),
                              F.lit("high").alias("severity"), F.col("orphans").alias("affected_rows"))
    dup = exact_duplicates(t).select(F.concat(F.lit("duplicates "), F.col("table_name")).alias("issue"),
                                     F.lit("duplicates").alias("issue_type"), F.lit("medium").alias("severity"),
                                     F.col("duplicates").alias("affected_rows"))
    nul = null_profile(profile).select(
        F.concat(F.lit("nulls "), F.col("table_name"), F.lit("."), F.col("column_name")).alias("issue"),
        F.lit("completeness").alias("issue_type"),
        F.when(F.col("pct_nulls") > 10, "medium").otherwise("low").alias("severity"),
        F.col("nulls").alias("affected_rows"))
    pr = price_ranges(t["product"], t["central_product"]).select(
        F.lit("price below cost").alias("issue"), F.lit("numeric range").alias("issue_type"),
        F.lit("high").alias("severity"), F.col("price_below_cost").alias("affected_rows"))
    ls = profile.agg(*_one(profile, "sale_item", "subtotal", affected_rows="violations")).select(
        F.lit("line subtotal mismatch").alias("issue"), F.lit("consistency").alias("issue_type"),
        F.lit("high").alias("severity"), "affected_rows")
    ot = profile.agg(*_one(profile, "sale", "total", affected_rows="violations")).select(
        F.lit("order total mismatch").alias("issue"), F.lit("consistency").alias("issue_type"),
        F.lit("high").alias("severity"), "affected_rows")
    rb = returns_before_sale(t["return_item"], t["sale_item"], t["sale"]).select(
        F.lit("return before sale").alias("issue"), F.lit("temporal").alias("issue_type"),
        F.lit("medium").alias("severity"), F.col("cases").alias("affected_rows"))
    so = sales_outside_offer(t["sale_item"], t["sale"], t["offer"]).select(
        F.lit("sale outside offer validity").alias("issue"), F.lit("temporal").alias("issue_type"),
        F.lit("low").alias("severity"), F.col("cases").alias("affected_rows"))
    return _union([fk, dup, nul, pr, ls, ot, rb, so]).filter(F.col("affected_rows") > 0)


def issue_rollup(issues: DataFrame) -> DataFrame:
    by_type = issues.groupBy(F.lit("type").alias("grouping"), F.col("issue_type").alias("value")).agg(
        F.count(F.lit(1)).alias("issues"), F.sum("affected_rows").cast("long").alias("affected_rows"))
    by_sev = issues.groupBy(F.lit("severity").alias("grouping"), F.col("severity").alias("value")).agg(
        F.count(F.lit(1)).alias("issues"), F.sum("affected_rows").cast("long").alias("affected_rows"))
    return by_type.unionByName(by_sev)


def issue_impact(sale_item: DataFrame, sale: DataFrame, product: DataFrame,
                 central_product: DataFrame, target_margin: str = "0.40") -> DataFrame:
    """Money impact of wrong prices (lines of products priced below cost, revalued at the
    repaired price), wrong line subtotals and wrong order totals."""
    fixed = repaired_prices(product, central_product, target_margin)
    wrong = fixed.filter(F.col("price_changed")).select("product_id", F.col("new_price"))
    p = sale_item.join(wrong, "product_id", "inner").agg(
        F.count(F.lit(1)).alias("lines"),
        F.coalesce(F.sum(F.col("quantity") * F.col("new_price")) - F.sum(F.col("quantity") * F.col("unit_price")),
                   F.lit(0)).cast(MONEY).alias("impact"))
    s = sale_item.filter(subtotal_bad()).agg(
        F.count(F.lit(1)).alias("lines"),
        F.coalesce(F.sum("subtotal") - F.sum(F.round(F.col("quantity") * F.col("unit_price"), 2)),
                   F.lit(0)).cast(MONEY).alias("impact"))
    o = order_total_mismatch(sale, sale_item).agg(
        F.count(F.lit(1)).alias("lines"), F.coalesce(F.sum("difference"), F.lit(0)).cast(MONEY).alias("impact"))
    return _union([p.select(F.lit("wrong price").alias("problem"), "lines", "impact"),
                   s.select(F.lit("wrong line subtotals").alias("problem"), "lines", "impact"),
                   o.select(F.lit("wrong order totals").alias("problem"), "lines", "impact")])


def range_battery(product: DataFrame, central_product: DataFrame, profile: DataFrame) -> DataFrame:
    pr = price_ranges(product, central_product)
    lr = line_ranges(profile)
    ot = profile.agg(*_one(profile, "sale", "total", order_totals_inconsistent="violations"))
    j = pr.transform(attach, lr, ot)
    names = [("product price <= 0", "price_nonpositive"), ("product cost <= 0", "cost_nonpositive"),
             ("price < cost", "price_below_cost"), ("negative margins", "negative_margins"),
             ("line quantity <= 0", "quantity_nonpositive"), ("unit price <= 0", "unit_price_nonpositive"),
             ("subtotal <= 0", "subtotal_nonpositive"), ("inconsistent subtotals", "subtotal_inconsistent"),
             ("inconsistent order totals", "order_totals_inconsistent")]
    cells = F.array(*[F.struct(F.lit(n).alias("check_name"), F.col(c).cast("long").alias("cases"))
                      for n, c in names])
    return j.select(F.explode(cells).alias("c")).select("c.check_name", "c.cases").withColumn(
        "ok", F.col("cases") == 0)


def certification(tables: dict[str, DataFrame], profile: DataFrame) -> DataFrame:
    t = tables
    fk = fk_orphans(t, CERTIFIED_KEYS).agg(
        F.count(F.when(F.col("orphans") > 0, 1)).alias("cases"), F.count(F.lit(1)).alias("checked"))
    fk = fk.select(F.lit("referential integrity").alias("check_name"), "cases", "checked")
    pc = _product_costs(t["product"], t["central_product"]).agg(
        F.count(F.when(F.col("price") < F.col("unit_cost"), 1)).alias("cases"))
    sub = profile.agg(*_one(profile, "sale_item", "subtotal", cases="violations"))
    tot = profile.agg(*_one(profile, "sale", "total", cases="violations"))
    nos = t["customer"].join(t["sale"].select("customer_id").distinct(), "customer_id", "left_anti") \
        .agg(F.count(F.lit(1)).alias("cases"))
    noc = t["product"].join(t["central_product"].select("product_id", "unit_cost"), "product_id", "left") \
        .agg(F.count(F.when(F.col("unit_cost").isNull() | (F.col("unit_cost") == 0), 1)).alias("cases"))
    line = ["sale_id", "sale_item_id"]
    ors = t["return_item"].join(t["sale_item"].select(*line), line, "left_anti").agg(F.count(F.lit(1)).alias("cases"))
    rows = [fk] + [d.select(F.lit(n).alias("check_name"), "cases", F.lit(None).cast("long").alias("checked"))
                   for n, d in [("price below cost", pc), ("inconsistent subtotals", sub),
                                ("inconsistent order totals", tot), ("customers without sales", nos),
                                ("products without cost", noc), ("returns without sale", ors)]]
    out = _union(rows).withColumn("ok", F.col("cases") == 0)
    all_ok = out.agg(F.min(F.col("ok").cast("int")).cast("boolean").alias("all_ok"))
    return out.transform(attach, all_ok)


# -- Q29 .. Q36 ------------------------------------------------------------------------------
def catalog_overlap(a: DataFrame, b: DataFrame, key: str = "product_id") -> DataFrame:
    ka, kb = a.select(key).distinct(), b.select(key).distinct()
    only_a = ka.join(kb, key, "left_anti").agg(F.count(F.lit(1)).alias("only_a"))
    only_b = kb.join(ka, key, "left_anti").agg(F.count(F.lit(1)).alias("only_b"))
    both = ka.join(kb, key, "inner").agg(F.count(F.lit(1)).alias("in_both"))
    return only_a.transform(attach, only_b, both)


def describe(df: DataFrame, columns) -> DataFrame:
    """count, mean, sample std, min, exact quartiles (linear), max per numeric column."""
    quartiles = quantiles_of(df, {c: c for c in columns}, [0.25, 0.5, 0.75])
    parts = []
    for c in columns:
        x = F.col(c)
        xd = x.cast("double")
        n = F.count(x)
        s1, s2 = F.sum(x), F.sum(x * x)
        var_num = (n * s2 - s1 * s1)
        std = F.sqrt(var_num.cast("double") / (n * (n - 1)).cast("double"))
        parts.append(df.agg(
            n.alias("count"), ratio(s1, n).alias("mean"),
            F.when(n > 1, std).alias("std"), F.min(xd).alias("min"),
            *[constant(q).alias(name) for name, q in zip(("p25", "p50", "p75"), quartiles[c], strict=True)],
            F.max(xd).alias("max")).select(
            F.lit(c).alias("column_name"), "*"))
    return _union(parts)


def price_points(sale_item: DataFrame) -> DataFrame:
    per = sale_item.groupBy("product_id", "unit_price").agg(
        F.count(F.lit(1)).alias("lines"), F.sum("quantity").cast("long").alias("units"))
    tot = sale_item.groupBy("product_id").agg(F.count(F.lit(1)).alias("_all"))
    return per.join(tot, "product_id").select(
        "product_id", "unit_price", "lines", "units", (ratio(F.col("lines"), F.col("_all")) * 100).alias("pct"))


def category_share(product: DataFrame, column: str = "category") -> DataFrame:
    per = product.groupBy(column).agg(F.count(F.lit(1)).alias("rows"))
    tot = product.agg(F.count(F.lit(1)).alias("_all"))
    return per.transform(attach, tot).select(
        column, "rows", (ratio(F.col("rows"), F.col("_all")) * 100).alias("pct"))


def offer_usage(sale_item: DataFrame) -> DataFrame:
    return sale_item.agg(F.count(F.when(F.col("offer_id").isNotNull(), 1)).alias("with_offer"),
                         F.count(F.when(F.col("offer_id").isNull(), 1)).alias("without_offer"))


def stock_nonpositive(inventory: DataFrame) -> DataFrame:
    return inventory.filter(F.col("stock") <= 0)


def customer_coverage(customer: DataFrame, sale: DataFrame) -> DataFrame:
    buyers = sale.select("customer_id").filter(F.col("customer_id").isNotNull()).distinct()
    ids = customer.select("customer_id")
    with_sales = buyers.join(ids, "customer_id", "left_semi").agg(F.count(F.lit(1)).alias("customers_with_sales"))
    total = ids.agg(F.count(F.lit(1)).alias("total_customers"))
    orphans = buyers.join(ids, "customer_id", "left_anti").agg(F.count(F.lit(1)).alias("orphan_customer_ids"))
    without = ids.join(buyers, "customer_id", "left_anti").agg(F.count(F.lit(1)).alias("customers_without_sales"))
    return with_sales.transform(attach, total, orphans, without)


def return_share_of_lines(return_item: DataFrame, sale_item: DataFrame) -> DataFrame:
    r = return_item.agg(F.count(F.lit(1)).alias("returns"))
    li = sale_item.agg(F.count(F.lit(1)).alias("lines"))
    return r.transform(attach, li).withColumn("pct", ratio(F.col("returns"), F.col("lines")) * 100)


# -- repairs helper shared with R01 --------------------------------------------------------------
def repaired_prices(product: DataFrame, central_product: DataFrame, target_margin: str = "0.40",
                    product_ids=None) -> DataFrame:
    """New price = round(cost / (1 - margin), 2) for the listed products (default: every
    product priced below its cost)."""
    p = product.join(central_product.select("product_id", "unit_cost"), "product_id", "left")
    if product_ids is None:
        sel = F.col("unit_cost").isNotNull() & (F.col("price") < F.col("unit_cost"))
    else:
        sel = F.col("product_id").isin(list(product_ids)) & F.col("unit_cost").isNotNull()
    keep = F.lit(1) - F.lit(target_margin).cast("decimal(5,4)")
    new = round_div(F.col("unit_cost"), keep, 2)
    return p.select("product_id", F.col("price").alias("old_price"),
                    F.when(sel, new).otherwise(F.col("price")).cast(MONEY).alias("new_price"),
                    sel.alias("price_changed"))
