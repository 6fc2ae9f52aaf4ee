"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinwork.llm import common


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of ``edges``: root is the smallest node that can be reached.

    Alternates two steps until nothing changes: every node tells its larger neighbours the smallest one around
    (large star), then tells its smaller neighbours (small star). A hub's neighbours are never collected: the minimum is a
    partial aggregate and goes back by a join, which splits a hot hub. Nulls, loops and repeated edges are dropped; no
    edges give no rows.
    """
    spark = edges.sparkSession
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), F.col(a).isNotNull() & F.col(b).isNotNull())
    now = common.stored(now.filter("u > v").select("u", "v").distinct(), "edges")
    before = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = common.stored(large.filter("u > v").distinct(), "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array("v", "u")).alias("u"), F.col("m").alias("v"))
        small = small.filter("u > v").distinct()
        after = common.stored(small, "edges")
        common.removed(spark, now)
        common.removed(spark, large)
        sums = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if before == sums:
            break
        before, now = sums, after
    roots = after.select(F.col("v").alias("node")).distinct()
    return after.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        roots.select("node", F.col("node").alias("root"))
    )
