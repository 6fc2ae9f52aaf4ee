"""Line dedup by site spread: lines that stand on many sites are boilerplate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinwork.llm import common
from skeinwork.session import broadcast_checked

#: A line on so many sites or more goes.
MIN_SITES = 10
#: Sketches of 2^12 registers are off by 1.6 % as a rule; estimates within this share of the threshold (and at least one
#: site) are counted exactly. The band is over six times that error.
SKETCH_BITS, BAND = 12, 0.1
#: Rows of a lookup that may be broadcast (a line key is 32 bytes).
BROADCAST_ROWS = 200_000


def lines(docs: DataFrame, site: str) -> DataFrame:
    """(doc_id, row, site, place, key) of every line that isn't blank; key digests the line without outer spaces."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("row"), F.col(site).alias("site"), F.posexplode(F.split("text", "\n", -1)))
    line = F.trim("col")
    return rows.filter(line != "").select("doc_id", "row", "site", F.col("pos").alias("place"), F.md5(line.cast("binary")).alias("key"))


def widespread(found: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """(key) of lines on at least ``min_sites`` sites.

    Sites are counted by one HyperLogLog sketch per line, merged before and after the shuffle, so a line that is everywhere is
    one small row a task. Lines with an estimate near the threshold are counted exactly.
    """
    sketch = F.hll_sketch_estimate(F.hll_sketch_agg("site", SKETCH_BITS)).alias("sites")
    spread = common.stored(found.filter("site is not null").groupBy("key").agg(sketch).filter(F.col("sites") >= 2), "spread")
    margin = max(1.0, BAND * min_sites)
    near = spread.filter(F.abs(F.col("sites") - min_sites) <= margin).select("key")
    sure = spread.filter(F.col("sites") > min_sites + margin).select("key")
    pairs = found.join(broadcast_checked(near, BROADCAST_ROWS), "key", "left_semi").select("key", "site").distinct()
    exact = pairs.groupBy("key").agg(F.count("site").alias("sites")).filter(F.col("sites") >= min_sites).select("key")
    return common.stored(sure.unionByName(exact), "widespread")


def without_boilerplate(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """(doc_id, n_lines, n_removed, kept) of every row of ``docs`` (doc_id, text, ``site``).

    Lines end at a newline; a line's outer spaces don't count when lines are compared; blank lines stay. A null text has no
    lines and keeps the empty text, an empty one has one blank line; rows without a site are cleaned but don't spread a line;
    repeated rows each get a row.
    """
    found = lines(docs, site)
    gone = found.join(broadcast_checked(widespread(found, min_sites), BROADCAST_ROWS), "key", "left_semi")
    gone = gone.groupBy("doc_id", "row").agg(F.collect_set("place").alias("places"))
    gone = gone.select(F.col("doc_id").alias("gone_id"), F.col("row").alias("gone_row"), "places")
    gone = broadcast_checked(common.stored(gone, "places"), BROADCAST_ROWS)
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("row"))
    same = F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col("row") == F.col("gone_row"))
    parts = texts.join(gone, same, "left").withColumn("parts", F.split("text", "\n", -1))
    kept = F.filter("parts", lambda _, k: ~F.array_contains("places", k))
    kept = F.when(F.col("places").isNull(), F.col("text")).otherwise(F.concat_ws("\n", kept))
    return parts.select(
        "doc_id",
        F.when(F.col("text").isNull(), 0).otherwise(F.size("parts")).cast("long").alias("n_lines"),
        F.when(F.col("places").isNull(), 0).otherwise(F.size("places")).cast("long").alias("n_removed"),
        F.coalesce(kept, F.lit("")).alias("kept"),
    )
