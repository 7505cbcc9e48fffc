"""Customer analytics (C) over the per-customer mart.

Rank-based metrics (top shares, Pareto and Lorenz curves, Gini, terciles,
percentiles) use ``functions.ordering.global_order``: positions and running
sums come from range buckets, never from a single-partition window. Money
stays exact (DECIMAL); ratios are one IEEE division of exact sums; rounded
ratios use integer rounding (``round_div``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exact import MONEY, ratio, round_div
from ..functions.moments import correlations, moments
from ..functions.quantiles import constant, quantiles, quantiles_by, quantiles_of
from ..functions.output import attach
from ..functions.ordering import global_order

LABELS = ("Champions", "Base", "Churned")


def valid(mart: DataFrame) -> DataFrame:
    return mart.filter(F.col("cltv").isNotNull())


def _n(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("_n"), F.sum("cltv").alias("_total"))


def _union(dfs):
    return reduce(lambda a, b: a.unionByName(b), dfs)


def tercile_of(rank, n):
    """F14 tercile (1..3) of a 1-based rank among n."""
    return (F.when(F.lit(3) * (rank - 1) <= n - 1, 1)
            .when(F.lit(3) * (rank - 1) <= F.lit(2) * (n - 1), 2).otherwise(3))


def tercile_labels(mart: DataFrame) -> DataFrame:
    """Deterministic segment labels: CLTV terciles by rank (desc, ties by key)."""
    m = valid(mart).select("customer_sk", "cltv")
    o = global_order(m, "cltv", "customer_sk", descending=True, pos_col="_r")
    n = m.agg(F.count(F.lit(1)).alias("_n"))
    t = o.transform(attach, n).withColumn("cluster_id", (tercile_of(F.col("_r"), F.col("_n")) - 1).cast("long"))
    return t.select("customer_sk", "cluster_id",
                    F.element_at(F.array(*[F.lit(x) for x in LABELS]), (F.col("cluster_id") + 1).cast("int"))
                    .alias("cluster_label"))


def labelled(mart: DataFrame, labels: DataFrame) -> DataFrame:
    return valid(mart).join(labels.select("customer_sk", "cluster_id", "cluster_label"), "customer_sk", "left")


# -- C01 / C02 / C03 / C04 -------------------------------------------------------
def cltv_kpis(mart: DataFrame) -> DataFrame:
    c = F.col("cltv")
    return valid(mart).agg(
        F.sum(c).cast(MONEY).alias("total_cltv"), ratio(F.sum(c), F.count(c)).alias("mean_cltv"),
        constant(quantiles(valid(mart), c, [0.5])[0]).alias("median_cltv"), F.max(c).alias("max_cltv"),
        F.min(F.when(c > 0, c)).alias("min_positive_cltv"))


def cltv_top_share(mart: DataFrame, shares=(10, 20)) -> DataFrame:
    """% of total CLTV held by the top p % of customers (k = max(1, floor(n p / 100)))."""
    m = valid(mart).select("customer_sk", "cltv")
    o = global_order(m, "cltv", "customer_sk", descending=True, pos_col="pos")
    n = _n(m)
    j = o.transform(attach, n)
    aggs = []
    for p in shares:
        k = F.greatest(F.lit(1), F.call_function("div", F.col("_n") * p, F.lit(100)))
        aggs.append(F.sum(F.when(F.col("pos") <= k, F.col("cltv")).otherwise(F.lit(0))).alias(f"_top{p}"))
    a = j.groupBy("_total").agg(*aggs)
    return a.select(*[round_div(F.col(f"_top{p}") * 100, F.col("_total"), 1).alias(f"top{p}_share_pct")
                      for p in shares])


def cltv_log_histogram(mart: DataFrame, bins: int = 19) -> DataFrame:
    pos = valid(mart).filter(F.col("cltv") > 0).select(F.col("cltv").cast("double").alias("x"))
    rng = pos.agg(F.log10(F.min("x")).alias("lo"), F.log10(F.max("x")).alias("hi"))
    width = (F.col("hi") - F.col("lo"))
    idx = F.when(width > 0, F.floor((F.log10("x") - F.col("lo")) / width * bins)).otherwise(F.lit(0))
    idx = F.least(F.greatest(idx, F.lit(0)), F.lit(bins - 1)).cast("long")     # F16: clamp the extremes
    counts = pos.transform(attach, rng).groupBy(idx.alias("bin")).agg(F.count(F.lit(1)).alias("customers"))
    grid = rng.select("lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    edge = lambda i: F.round(F.pow(F.lit(10.0), F.col("lo") + (F.col("hi") - F.col("lo")) * i / bins), 2)
    return grid.join(counts, "bin", "left").select(
        F.col("bin").cast("long").alias("bin"), edge(F.col("bin")).alias("lower_edge"),
        edge(F.col("bin") + 1).alias("upper_edge"), F.coalesce("customers", F.lit(0)).alias("customers"))


HISTOGRAMS = (("cltv", "full", 60), ("cltv", "below_p95", 50), ("aov", "full", 50),
              ("aov", "below_p95", 50), ("return_rate", "full", 40))


def metric_histogram(mart: DataFrame, specs=HISTOGRAMS) -> DataFrame:
    """Equal-width histograms (full range or values <= p95) with mean and median."""
    m = valid(mart)
    metrics = {metric: metric for metric, _, _ in specs}
    p95 = quantiles_of(m, metrics, [0.95])
    upper = {metric: F.when(F.col(metric).cast("double") <= constant(p95[metric][0]), F.col(metric)) for metric in metrics}
    medians = {"full": quantiles_of(m, metrics, [0.5]), "below_p95": quantiles_of(m, upper, [0.5])}
    parts = []
    for metric, scope, bins in specs:
        x = m.select((upper[metric] if scope == "below_p95" else F.col(metric)).alias("x")).filter("x is not null")
        st = x.agg(F.min("x").alias("lo"), F.max("x").alias("hi"), ratio(F.sum("x"), F.count("x")).alias("mean")) \
            .withColumn("median", constant(medians[scope][metric][0]))
        w = (F.col("hi") - F.col("lo")).cast("double")
        idx = F.when(w > 0, F.floor((F.col("x") - F.col("lo")).cast("double") / w * bins)).otherwise(F.lit(0))
        idx = F.least(idx, F.lit(bins - 1)).cast("long")
        cnt = x.transform(attach, st.select("lo", "hi")).groupBy(idx.alias("bin")).agg(
            F.count(F.lit(1)).alias("customers"))
        grid = st.select("*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
        edge = lambda i: F.round(F.col("lo").cast("double") + w * i / bins, 2)
        parts.append(grid.join(cnt, "bin", "left").select(
            F.lit(metric).alias("metric"), F.lit(scope).alias("scope"), F.col("bin").cast("long").alias("bin"),
            edge(F.col("bin")).alias("lower_edge"), edge(F.col("bin") + 1).alias("upper_edge"),
            F.coalesce("customers", F.lit(0)).alias("customers"), "mean", "median"))
    return _union(parts)


# -- C05 / C06 --------------------------------------------------------------------
def cltv_by_tenure(mart: DataFrame) -> DataFrame:
    t = F.col("tenure_days")
    band = (F.when((t > 0) & (t <= 365), "0-1 years").when((t > 365) & (t <= 730), "1-2 years")
            .when((t > 730) & (t <= 1095), "2-3 years").when(t > 1095, "3+ years"))
    m = valid(mart).withColumn("band", band).filter(F.col("band").isNotNull())
    median = F.lit(None).cast("double")
    for (name,), (value,) in quantiles_by(m, "cltv", [0.5], ["band"]).items():
        median = F.when(F.col("band") == name, constant(value)).otherwise(median)
    return m.groupBy("band").agg(ratio(F.sum("cltv"), F.count("cltv")).alias("mean_cltv"), F.count(F.lit(1)).alias("customers")) \
        .withColumn("median_cltv", median)


ORDER_BANDS = (("1 order", 0, 1), ("2 orders", 1, 2), ("3-5 orders", 2, 5), ("6-10 orders", 5, 10),
               ("more than 10", 10, None))


def orders_band(mart: DataFrame) -> DataFrame:
    o = F.col("num_orders")
    band = None
    for label, lo, hi in ORDER_BANDS:
        cond = (o > lo) if hi is None else (o > lo) & (o <= hi)  # the last band is open
        band = F.when(cond, label) if band is None else band.when(cond, label)
    per = valid(mart).groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("customers"))
    labels = mart.sparkSession.range(1).select(F.inline(F.array(*[
        F.struct(F.lit(b[0]).alias("band"), F.lit(i + 1).cast("long").alias("band_order"))
        for i, b in enumerate(ORDER_BANDS)])))
    return F.broadcast(labels).join(per, "band", "left").select(
        "band", "band_order", F.coalesce("customers", F.lit(0)).alias("customers"))


# -- C07 .. C11: curves and concentration -------------------------------------------
def _ordered(mart: DataFrame, descending: bool) -> DataFrame:
    m = valid(mart).select("customer_sk", "cltv")
    o = global_order(m, "cltv", "customer_sk", descending=descending, pos_col="pos",
                     running_col="cum_cltv", running_of="cltv")
    return o.transform(attach, _n(m))


def pareto_curve(mart: DataFrame, points: int = 100) -> DataFrame:
    o = _ordered(mart, descending=True)
    step = F.greatest(F.lit(1), F.call_function("div", F.col("_n"), F.lit(points)))
    return o.filter((F.col("pos") - 1) % step == 0).select(
        "pos", (ratio(F.col("pos"), F.col("_n")) * 100).alias("customers_pct"),
        (ratio(F.col("cum_cltv"), F.col("_total")) * 100).alias("cltv_cum_pct"))


def pareto_80(mart: DataFrame, share: int = 80) -> DataFrame:
    """% of customers (by descending CLTV) needed to reach ``share`` % of total CLTV."""
    o = _ordered(mart, descending=True)
    hit = o.filter(F.col("cum_cltv") * 100 >= F.col("_total") * share)
    first = hit.groupBy("_n").agg(F.min("pos").alias("pos"))
    return first.select(F.col("pos").alias("customers_needed"),
                        round_div(F.col("pos") * 100, F.col("_n"), 1).alias("customers_pct"))


def lorenz_curve(mart: DataFrame) -> DataFrame:
    o = _ordered(mart, descending=False)
    return o.select("pos", (ratio(F.col("pos"), F.col("_n")) * 100).alias("population_pct"),
                    (ratio(F.col("cum_cltv"), F.col("_total")) * 100).alias("cltv_pct"))


def lorenz_top_80(mart: DataFrame, bottom_share: int = 20) -> DataFrame:
    """Top % of customers producing (100 - bottom_share) % of CLTV: first ascending crossing."""
    o = _ordered(mart, descending=False)
    hit = o.filter(F.col("cum_cltv") * 100 >= F.col("_total") * bottom_share)
    first = hit.groupBy("_n").agg(F.min("pos").alias("pos"))
    return first.select(F.col("pos").alias("crossing_pos"),
                        round_div((F.col("_n") - F.col("pos")) * 100, F.col("_n"), 1).alias("top_pct_for_80"))


def gini(mart: DataFrame) -> DataFrame:
    """2 sum(i x) / (n sum x) - (n + 1) / n over ascending CLTV, to 3 decimals."""
    o = _ordered(mart, descending=False)
    a = o.groupBy("_n", "_total").agg(F.sum(F.col("pos") * F.col("cltv")).alias("_six"))
    num = F.col("_six") * 2 - (F.col("_n") + 1) * F.col("_total")
    return a.select(round_div(num, F.col("_n") * F.col("_total"), 3).alias("gini"), F.col("_n").alias("customers"))


# -- C12 / C13 / C14 / C15 -------------------------------------------------------------
R_LABELS = ("Recent", "Medium", "Inactive")
F_LABELS = ("Low", "Medium", "High")


def _pick(labels, i):
    return F.element_at(F.array(*[F.lit(x) for x in labels]), i.cast("int"))


def rfm_matrix(mart: DataFrame) -> DataFrame:
    m = valid(mart).select("customer_sk", "cltv", "recency_days", "monthly_frequency")
    q1, q2 = map(constant, quantiles(m, "recency_days", [1.0 / 3, 2.0 / 3]))
    edges = m.agg(F.count(F.lit(1)).alias("_n"))
    o = global_order(m, "monthly_frequency", "customer_sk", pos_col="_fr")
    j = o.transform(attach, edges)
    r = F.col("recency_days")
    rt = F.when(r <= q1, 1).when(r <= q2, 2).otherwise(3)
    ft = tercile_of(F.col("_fr"), F.col("_n"))
    return j.groupBy(_pick(R_LABELS, rt).alias("recency"), _pick(F_LABELS, ft).alias("frequency")).agg(
        round_div(F.sum("cltv"), F.count("cltv"), 2).alias("mean_cltv"), F.count(F.lit(1)).alias("customers"))


def cohorts(mart: DataFrame) -> DataFrame:
    m = valid(mart).filter(F.col("first_purchase").isNotNull())
    return m.groupBy(F.year("first_purchase").alias("cohort_year")).agg(
        F.count(F.lit(1)).alias("customers"),
        round_div(F.sum("cltv"), F.count("cltv"), 2).alias("mean_cltv"),
        F.sum("cltv").cast(MONEY).alias("total_cltv"),
        ratio(F.sum("aov"), F.count("aov")).alias("mean_aov"),
        ratio(F.sum("num_orders"), F.count("num_orders")).alias("mean_orders"),
        ratio(F.sum("tenure_days"), F.count("tenure_days")).alias("mean_tenure_days"),
        ratio(F.sum("return_rate"), F.count("return_rate")).alias("mean_return_rate"))


def top_customers(mart: DataFrame, labels: DataFrame, n: int = 20, segment: str | None = None) -> DataFrame:
    m = labelled(mart, labels)
    tot = m.agg(F.sum("cltv").alias("_total"))
    if segment is not None:
        m = m.filter(F.col("cluster_label") == segment)
    order = [F.col("cltv").desc(), F.col("customer_sk")]
    top = m.orderBy(*order).limit(n).transform(attach, tot)
    top = top.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))
    return top.select("rank", "customer_sk", "name", "cltv", "net_revenue", "aov", "monthly_frequency",
                      "recency_days", "num_orders", "cluster_label",
                      (ratio(F.col("cltv"), F.col("_total")) * 100).alias("share_of_total_pct"))


def cltv_by_zone(mart: DataFrame, zones: DataFrame) -> DataFrame:
    m = valid(mart).join(zones.select("customer_sk", "area_type", "orientation"), "customer_sk", "left")
    # One row per zone description, kept: the three groupings add up the same exact sums.
    m = m.groupBy("area_type", "orientation").agg(F.count(F.lit(1)).alias("n"), F.sum("cltv").alias("s")).persist()
    aggs = [F.sum("n").alias("customers"), ratio(F.sum("s"), F.sum("n")).alias("mean_cltv")]
    a = m.groupBy("area_type").agg(*aggs).select(F.lit("area").alias("grouping"), "area_type",
                                                 F.lit(None).cast("string").alias("orientation"), "customers", "mean_cltv")
    o = m.groupBy("orientation").agg(*aggs).select(F.lit("orientation").alias("grouping"),
                                                   F.lit(None).cast("string").alias("area_type"), "orientation",
                                                   "customers", "mean_cltv")
    ao = m.groupBy("area_type", "orientation").agg(*aggs).select(
        F.lit("area_x_orientation").alias("grouping"), "area_type", "orientation", "customers", "mean_cltv")
    return _union([a, o, ao])


# -- C16 / C17 / C18 / C19 / C20 -----------------------------------------------------------
CORR_METRICS = ("cltv", "net_revenue", "aov", "num_orders", "monthly_frequency", "tenure_days",
                "recency_days", "return_rate")


def metric_correlation(mart: DataFrame, metrics=CORR_METRICS) -> DataFrame:
    """Pearson matrix from exact sums in one pass; null where a metric is constant."""
    c = correlations(moments(valid(mart), metrics))
    cells = [(a, b, c[i][j]) for i, a in enumerate(metrics) for j, b in enumerate(metrics)]
    return mart.sparkSession.createDataFrame(cells, "metric_a string, metric_b string, pearson double")


def high_return_profile(mart: DataFrame, threshold: int = 50) -> DataFrame:
    m = valid(mart)
    hi = F.col("return_rate") > threshold
    return m.agg(
        F.count(F.when(hi, 1)).alias("customers"),
        (ratio(F.count(F.when(hi, 1)), F.count(F.lit(1))) * 100).alias("pct_customers"),
        ratio(F.sum(F.when(hi, F.col("cltv"))), F.count(F.when(hi, 1))).alias("mean_cltv"),
        ratio(F.sum(F.when(~hi, F.col("cltv"))), F.count(F.when(~hi, 1))).alias("mean_cltv_rest"),
        ratio(F.sum(F.when(hi, F.col("aov"))), F.count(F.when(hi, F.col("aov")))).alias("mean_aov"),
        ratio(F.sum(F.when(hi, F.col("return_rate"))), F.count(F.when(hi, 1))).alias("mean_return_rate"),
        F.coalesce(F.sum(F.when(hi, F.col("units_returned"))), F.lit(0)).cast("long").alias("units_returned"),
        F.coalesce(F.sum(F.when(hi, F.col("gross_revenue") - F.col("net_revenue"))),
                   F.lit(0)).cast(MONEY).alias("lost_revenue"))


def return_rate_anomalies(mart: DataFrame) -> DataFrame:
    """Customers returning more units than they bought (uncapped rate, F11)."""
    return mart.filter(F.col("return_rate_raw") > 100).select(
        "customer_sk", "units_bought", "units_returned", "return_rate_raw", "num_orders")


STAT_METRICS = ("cltv", "aov", "return_rate")


def metric_stats(mart: DataFrame, metrics=STAT_METRICS) -> DataFrame:
    m = valid(mart)
    medians = quantiles_of(m, {c: c for c in metrics}, [0.5])
    parts = []
    for c in metrics:
        x = F.col(c)
        n = F.count(x)
        std = F.sqrt((n * F.sum(x * x) - F.sum(x) * F.sum(x)).cast("double") / (n * (n - 1)).cast("double"))
        parts.append(m.agg(ratio(F.sum(x), n).alias("mean"), constant(medians[c][0]).alias("median"),
                           F.when(n > 1, std).alias("std"), F.min(x).cast("double").alias("min"),
                           F.max(x).cast("double").alias("max")).select(F.lit(c).alias("metric"), "*"))
    return _union(parts)


def customer_percentile(mart: DataFrame, metric: str = "cltv") -> DataFrame:
    """% of customers with a strictly smaller value. Values are counted first (map-side
    combined), positions are taken over distinct values, then joined back by value."""
    m = valid(mart).select("customer_sk", F.col(metric).alias("v"))
    per = m.groupBy("v").agg(F.count(F.lit(1)).alias("_c"))
    o = global_order(per.withColumn("_k", F.lit(0)), "v", "_k", pos_col="_p", running_col="_cum", running_of="_c")
    below = o.select("v", (F.col("_cum") - F.col("_c")).alias("_below"))
    n = m.agg(F.count(F.lit(1)).alias("_n"))
    return m.join(below, "v").transform(attach, n).select(
        "customer_sk", F.col("v").alias(metric),
        round_div(F.col("_below") * 100, F.col("_n"), 1).alias("pct_below"))


# -- C21 / C22 / C23 / C24 ---------------------------------------------------------------------
def customer_lookup(mart: DataFrame, customer_sk: int | None = None, name_term: str | None = None) -> DataFrame:
    m = mart
    if customer_sk is not None:
        m = m.filter(F.col("customer_sk") == customer_sk)
    if name_term is not None:
        m = m.filter(F.lower(F.col("name")).contains(name_term.lower()))
    return m


SEGMENT_METRICS = ("cltv", "aov", "num_orders", "tenure_days", "monthly_frequency", "return_rate")


def customer_vs_segment(mart: DataFrame, labels: DataFrame, metrics=SEGMENT_METRICS) -> DataFrame:
    """Each customer's metrics beside the segment mean, both min-max normalised over all customers."""
    m = labelled(mart, labels)
    rng = m.agg(*[F.min(c).cast("double").alias(f"_lo_{c}") for c in metrics],
                *[F.max(c).cast("double").alias(f"_hi_{c}") for c in metrics])
    seg = m.groupBy("cluster_label").agg(*[ratio(F.sum(c), F.count(c)).alias(f"_mean_{c}") for c in metrics])
    j = m.join(F.broadcast(seg), "cluster_label", "left").transform(attach, rng)

    def norm(v, c):
        return (v - F.col(f"_lo_{c}")) / (F.col(f"_hi_{c}") - F.col(f"_lo_{c}") + F.lit(1e-9))
    cells = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value"),
                               F.col(f"_mean_{c}").alias("segment_mean"),
                               norm(F.col(c).cast("double"), c).alias("value_norm"),
                               norm(F.col(f"_mean_{c}"), c).alias("segment_norm")) for c in metrics])
    return j.select("customer_sk", "cluster_label", F.explode(cells).alias("x")).select(
        "customer_sk", "cluster_label", "x.*")


def health_score(mart: DataFrame, labels: DataFrame) -> DataFrame:
    m = labelled(mart, labels)
    a = m.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("cluster_label") == "Champions", 1)).alias("ch"),
              F.sum("units_returned").alias("ret"), F.sum("units_bought").alias("bought"),
              F.count(F.when(F.col("cltv") > 0, 1)).alias("pos"))
    champ = ratio(F.col("ch"), F.col("n")) * 100
    rr = ratio(F.col("ret"), F.col("bought")) * 100
    pos = ratio(F.col("pos"), F.col("n")) * 100
    s1 = F.least(champ / 15 * 33, F.lit(33.0))
    s2 = F.greatest(F.lit(0.0), (F.lit(5.0) - rr) / 5 * 33)
    s3 = F.least(pos / 95 * 34, F.lit(34.0))
    return a.select(F.bround(s1 + s2 + s3, 0).cast("long").alias("score"), champ.alias("champions_pct"),
                    rr.alias("return_rate"), pos.alias("positive_cltv_pct"))


def health_light(f_sales: DataFrame, mart: DataFrame) -> DataFrame:
    fs = f_sales.agg((ratio(F.sum("returned_qty"), F.sum("quantity")) * 100).alias("return_rate"),
                     ratio(F.sum("margin_pct"), F.count("margin_pct")).alias("avg_margin_pct"))
    rc = valid(mart).agg(ratio(F.sum("recency_days"), F.count("recency_days")).alias("avg_recency_days"))
    j = fs.transform(attach, rc)
    rr, mg, rec = F.col("return_rate"), F.col("avg_margin_pct"), F.col("avg_recency_days")
    pts = (F.when(rr < 5, 2).when(rr < 15, 1).otherwise(0) + F.when(mg > 40, 2).when(mg > 25, 1).otherwise(0)
           + F.when(rec < 90, 2).when(rec < 180, 1).otherwise(0))
    return j.select("*", pts.alias("points")).withColumn(
        "light", F.when(F.col("points") >= 5, "green").when(F.col("points") >= 3, "yellow").otherwise("red"))


# -- C25 / C26 / C27 -------------------------------------------------------------------------
def cltv_scatter(mart: DataFrame, labels: DataFrame, n: int = 600, seed: int = 42) -> DataFrame:
    """Deterministic sample: the n customers with the smallest key hash."""
    m = labelled(mart, labels).withColumn("_h", F.xxhash64(F.col("customer_sk"), F.lit(seed)))
    return m.orderBy("_h", "customer_sk").limit(n).select(
        "customer_sk", "cltv", "tenure_days", "recency_days", "cluster_label")


EXPORT_COLUMNS = ("cltv", "net_revenue", "aov", "monthly_frequency", "recency_days", "tenure_days",
                  "return_rate", "margin_pct")


def customer_export(mart: DataFrame, labels: DataFrame) -> DataFrame:
    m = labelled(mart, labels)
    return m.select("customer_sk", "name", "num_orders", "cluster_label", *[
        F.round(F.coalesce(F.col(c).cast("decimal(18,4)"), F.lit(0).cast("decimal(18,4)")), 2).alias(c)
        for c in EXPORT_COLUMNS])


def executive_summary(mart: DataFrame, labels: DataFrame) -> DataFrame:
    m = labelled(mart, labels)
    lab = F.col("cluster_label")
    a = m.agg(
        F.count(F.lit(1)).alias("customers"),
        F.count(F.when(lab == "Champions", 1)).alias("champions"),
        F.count(F.when(lab == "Base", 1)).alias("base"),
        F.count(F.when(lab == "Churned", 1)).alias("churned"),
        F.sum("cltv").cast(MONEY).alias("total_cltv"),
        F.sum(F.when(lab == "Champions", F.col("cltv"))).alias("_champ_cltv"),
        ratio(F.sum("cltv"), F.count("cltv")).alias("mean_cltv"),
        constant(quantiles(m, "cltv", [0.5])[0]).alias("median_cltv"),
        ratio(F.sum("aov"), F.count("aov")).alias("mean_aov"),
        (ratio(F.sum("units_returned"), F.sum("units_bought")) * 100).alias("return_rate"),
        F.count(F.when(F.col("return_rate") > 50, 1)).alias("high_return_customers"),
        F.sum(F.col("gross_revenue") - F.col("net_revenue")).cast(MONEY).alias("lost_revenue"))
    out = a.select("*", round_div(F.coalesce(F.col("_champ_cltv"), F.lit(0)) * 100, F.col("total_cltv"), 1)
                   .alias("champions_cltv_share_pct")).drop("_champ_cltv")
    return out.transform(attach, gini(mart).select("gini"),
                         lorenz_top_80(mart).select("top_pct_for_80"))
