"""Mixing sources to target weights by hash thresholds found from histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skeinwork.llm import common

WEIGHTS = (5, 2, 1)
#: All targets together, as a share of all sizes.
TOTAL = 1.5
#: No source's target exceeds so many times its size.
MOST = 2
#: Hash digits (of four bits) and digits per level of the histograms: 16^3 buckets a source and level.
DIGITS, LEVEL = 15, 3

SIZE = "cast(coalesce(regexp_count(text, '[^\\\\x20\\\\x09-\\\\x0D]+'), 0) as long)"


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, h): h orders the documents of a source by the digits of their id's digest.

    Equal ids fall together; a missing id counts as the empty string.
    """
    return docs.select("doc_id", "source", F.expr(SIZE).alias("size"), id_digest().alias("h"))


def id_digest():
    return F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, DIGITS)


def targets(sized: DataFrame, weights: Sequence[int] = WEIGHTS, total: float = TOTAL, most: int = MOST) -> DataFrame:
    """(source, source_size, target): weights repeat over the sources by code point, null last.

    A target stops at ``most`` times its source's size and what is left over goes to the others by weight. Sources reach
    that stop in the order of (stop / weight), so one running sum over the table of sources finds all of them.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((place - 1) % len(weights) + 1).cast("int"))
    known = sums.withColumn("place", place).withColumn("weight", weight).withColumn("cap", most * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    every = Window.orderBy("source_size").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = total * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    known = known.withColumn("rank", F.row_number().over(order)).withColumn("share", left / F.sum("weight").over(rest))
    open_ = F.when(F.col("share") * F.col("weight") < F.col("cap"), F.struct("rank", "share"))
    known = known.withColumn("level", F.min(open_).over(every))
    stops = F.col("level").isNull() | (F.col("rank") < F.col("level.rank"))
    target = F.when(stops, F.col("cap").cast("double")).otherwise(F.col("level.share") * F.col("weight"))
    return known.select("source", "source_size", target.alias("target"))


def thresholds(sized: DataFrame, wanted: DataFrame, most: int = MOST) -> DataFrame:
    """(source, source_size, target, times, h, edge): a document is taken ``times`` over, once more if its hash is below
    ``h``, and at ``h`` itself if ``edge`` is true.

    ``times`` whole rounds fit the target; of the next round, the documents of smallest hash are taken that fit, and the one
    after them if that ends nearer. First the sizes are summed by source and the first digits of the hash, which finds the
    bucket where the budget ends; then only that bucket's documents are summed by their next digits, and so on. Thresholds
    are nested: a larger budget keeps all that a smaller one took. No document is sorted, and a hot source is as many
    buckets as any other.
    """
    times = F.least(F.floor(F.coalesce(F.try_divide("target", "source_size"), F.lit(0))), F.lit(most)).cast("int")
    goal = wanted.withColumn("times", times)
    goal = goal.withColumn("budget", F.col("target") - F.col("times") * F.col("source_size")).withColumn("h", F.lit(""))
    for level in range(LEVEL, DIGITS + 1, LEVEL):
        goal = common.stored(goal, "budgets")
        small = _few(goal.select(F.col("source").alias("s"), F.col("h").alias("prefix"), "budget"))
        inside = F.col("source").eqNullSafe(F.col("s")) & (F.substring("h", 1, level - LEVEL) == F.col("prefix"))
        near = sized.join(small, inside).groupBy("s", "budget", F.substring("h", 1, level).alias("bin"))
        bins = near.agg(F.sum("size").alias("size"))
        upto = F.sum("size").over(Window.partitionBy("s").orderBy("bin"))
        bins = bins.withColumn("after", upto).withColumn("before", F.col("after") - F.col("size"))
        ends = bins.filter((F.col("before") <= F.col("budget")) & (F.col("after") > F.col("budget")))
        ends = ends.select("s", "bin", "before", "after")
        goal = goal.join(ends, F.col("source").eqNullSafe(F.col("s")), "left")
        over, under = F.col("after") - F.col("budget"), F.col("budget") - F.col("before")
        goal = goal.select(
            "source", "source_size", "target", "times", F.coalesce(under, "budget").alias("budget"),
            F.coalesce("bin", F.lit("")).alias("h"), F.coalesce(over < under, F.lit(False)).alias("edge"),
        )
    return goal


def _few(table: DataFrame, limit: int = 100_000) -> DataFrame:
    """Sources are few as a rule; then their table is broadcast, after counting."""
    return F.broadcast(table) if table.limit(limit + 1).count() <= limit else table


def rounds(sized: DataFrame, weights: Sequence[int] = WEIGHTS, total: float = TOTAL, most: int = MOST) -> DataFrame:
    """``sized`` with the source's size and target and in how many rounds each document is taken."""
    limits = common.stored(thresholds(sized, targets(sized, weights, total, most), most), "thresholds")
    limits = _few(limits.select(F.col("source").alias("s"), F.col("h").alias("top"), "edge", "times", "source_size", "target"))
    again = (F.col("h") < F.col("top")) | ((F.col("h") == F.col("top")) & F.col("edge"))
    joined = sized.join(limits, F.col("source").eqNullSafe(F.col("s")))
    return joined.withColumn("rounds", F.col("times") + again.cast("int")).drop("s", "top", "edge", "times")


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, total: float = TOTAL) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row of ``docs`` (doc_id, text, source).

    taken is the words that the mix takes of the document, repeats counted. Null and empty texts have size 0; a source
    without words has target 0; rows that repeat an id in a source share their fate; an empty table gives no rows.
    """
    found = rounds(common.stored(sizes(docs), "sizes"), weights, total)
    return found.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("rounds")).alias("taken"))


def mixed(docs: DataFrame, weights: Sequence[int] = WEIGHTS, total: float = TOTAL) -> DataFrame:
    """The rows that the mix takes, all columns kept, each as often as it is taken.

    A document's part depends on its source and the hash of its id alone, so texts meet the thresholds without a shuffle.
    """
    sized = common.stored(sizes(docs), "sizes")
    limits = common.stored(thresholds(sized, targets(sized, weights, total)), "thresholds")
    source, top, edge, times, turn = common.fresh(docs, "source", "top", "edge", "times", "turn")
    limits = _few(limits.select("source", "h", "edge", "times").toDF(source, top, edge, times))
    digest = id_digest()
    again = (digest < F.col(top)) | ((digest == F.col(top)) & F.col(edge))
    joined = docs.join(limits, F.col("source").eqNullSafe(F.col(source)))
    taken = F.least(F.col(times) + again.cast("int"), F.lit(MOST))
    return joined.withColumn(turn, F.explode(F.array_repeat(F.lit(1), taken))).select(*docs.columns)
