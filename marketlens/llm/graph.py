"""Connected components of an edge table, as alternating star contractions in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def connected_components(edges: DataFrame, name: str) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b: comparable, non-null); component = least node.

    Each round lets every node point its larger neighbours at the least node around it
    (large star), then re-points its smaller neighbours (small star), until the edge
    set stands still: every node then hangs on its component's least node. A round is
    two aggregations with map-side minima and two joins that AQE may split, so a hub
    costs no more than its edges; rounds are written to the shared folder. Edges are
    never gathered on the driver.
    """
    def distinct_edges(df: DataFrame) -> DataFrame:
        return df.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    cur = materialize(distinct_edges(edges), f"{name}-edges")
    seen = None
    while True:
        both = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = distinct_edges(large)
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        nxt = distinct_edges(small.select(F.col("b").alias("a"), F.col("m").alias("b"))
                             .unionByName(low.select("a", F.col("m").alias("b"))))
        nxt = materialize(nxt, f"{name}-edges")
        mark = nxt.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        discard(cur)
        if mark == seen:
            break
        seen, cur = mark, nxt
    star = nxt.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
    roots = nxt.select(F.col("b").alias("node")).distinct()
    return star.unionByName(roots.select("node", F.col("node").alias("component")))
