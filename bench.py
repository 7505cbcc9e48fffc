"""Benchmark: full warehouse build (W13) plus headline reports read from it.

Runs on local[$BENCH_CPUS] over $BENCH_SF_DIR (default /root/testdata/sf0.1) and
prints one JSON line. The warehouse is written under a fresh scratch folder.
"""

from __future__ import annotations

import json
import os
import re
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from marketlens.operators import customers as C  # noqa: E402
from marketlens.operators import quality as Q  # noqa: E402
from marketlens.operators import reports as B  # noqa: E402
from marketlens.plans.pipeline import BuiltContext, build_warehouse  # noqa: E402
from marketlens.session import get_session  # noqa: E402
from marketlens.sources.binding import roles  # noqa: E402

REPORTS = {
    "global_kpis": lambda c: B.global_kpis(c.wh, c.mart),
    "month_comparison": lambda c: B.month_comparison(c.wh),
    "top_products": lambda c: B.top_products(c.wh),
    "store_kpis": lambda c: B.store_kpis(c.wh),
    "brands": lambda c: B.brands(c.wh),
    "profit_yearly": lambda c: B.profit_yearly(c.wh),
    "annual_growth": lambda c: B.annual_growth(c.wh),
    "product_growth": lambda c: B.product_growth(c.wh),
    "store_top_products": lambda c: B.store_top_products(c.wh),
    "cltv_kpis": lambda c: C.cltv_kpis(c.mart),
    "pareto_80": lambda c: C.pareto_80(c.mart),
    "gini": lambda c: C.gini(c.mart),
    "rfm_matrix": lambda c: C.rfm_matrix(c.mart),
    "cltv_by_zone": lambda c: C.cltv_by_zone(c.mart, c.customer_zone),
    "fk_orphans": lambda c: Q.fk_orphans(roles(c.src)),
    "order_total_mismatch": lambda c: Q.order_total_mismatch(c.src.sale, c.src.sale_item),
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    m = re.search(r"sf([0-9.]+)", sf_dir)
    sf = float(m.group(1)) if m else None
    scratch = tempfile.mkdtemp(prefix="marketlens-bench-")
    spark = get_session(f"local[{cpus}]", shuffle_partitions=max(8, 2 * cpus),
                        extra={"spark.driver.memory": "16g"})
    # A checkpoint folder configured for the session wins; the scratch one is the fallback.
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", os.path.join(scratch, "ckpt"))
    queries = {}
    t = time.time()
    res = build_warehouse(spark, sf_dir, os.path.join(scratch, "wh"))
    queries["etl_full"] = round(time.time() - t, 3)
    for k, v in res["timings"].items():
        if k != "total":
            queries[f"etl_{k}"] = round(v, 3)
    ctx = BuiltContext(spark, res["out_dir"])
    report_total = 0.0
    for name, fn in REPORTS.items():
        t = time.time()
        fn(ctx).collect()
        dt = time.time() - t
        report_total += dt
        queries[name] = round(dt, 3)
    total = queries["etl_full"] + report_total
    print(json.dumps({"metric": "etl_full_plus_reports", "value": round(total, 3), "unit": "sec",
                      "queries": queries, "sf": sf, "checks": res["checks"]}))
    spark.stop()


if __name__ == "__main__":
    main()
