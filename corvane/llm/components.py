"""Connected components over DataFrames of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import Scratch


def connected_components(links: DataFrame, scratch: Scratch, label: str) -> DataFrame:
    """Return ``(node, comp)`` for each node of ``links(u, v)``; ``comp`` is the smallest node reachable.

    Large-star and small-star steps (Kiveris et al., 2014) alternate until the
    links are stars.  A step is two aggregations with map-side combine and
    two equi-joins, which skew handling can split; no group is gathered in a task and
    only a flag reaches the driver.  Each step is written to the
    shared folder, so the plan doesn't grow.  Self-links only name their node; without links there is no row.
    """
    links = links.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"))
    e = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = scratch.table(e, f"{label}-0")
    step = 0
    while True:
        both = e.where("u <> v").select("u", "v").union(e.where("u <> v").select(F.col("v"), F.col("u")))
        # stars: each node is less than its neighbours, or has one neighbour, which is less
        low = both.groupBy("u").agg(F.min("v").alias("low"), F.max("v").alias("high"))
        low = low.select("u", F.least("u", "low").alias("low"), F.expr("low < u AND low < high").alias("open"))
        low = scratch.table(low, f"{label}-low-{step}")  # as a table: a join of two plain exchanges can be split where it is hot
        if low.where("open").isEmpty():
            ends = F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), "v"))
            return e.select(F.explode(ends).alias("x")).groupBy(F.col("x.u").alias("node")).agg(F.min("x.v").alias("comp"))
        large = both.join(low.drop("open"), "u").where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))
        large = scratch.table(large.union(e.where("u = v")).distinct(), f"{label}-large-{step}")
        low = scratch.table(large.groupBy("u").agg(F.min("v").alias("low")), f"{label}-small-{step}")
        small = large.join(low, "u").select(
            F.explode(F.array(F.struct("u", F.col("low").alias("v")), F.struct(F.col("v").alias("u"), F.col("low").alias("v")))).alias("x")
        )
        step += 1
        e = scratch.table(small.select("x.u", "x.v").distinct(), f"{label}-{step}")
        for name in ("", "low-", "large-", "small-"):
            scratch.drop(f"{label}-{name}{step - 1}")
