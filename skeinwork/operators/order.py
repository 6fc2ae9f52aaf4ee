"""Exact ranks, prefix sums, shuffles, batches and splits without a single-partition sort."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinwork.functions.draws import order_digest
from skeinwork.session import broadcast_checked, frozen

# Rows of an offset table that may be broadcast.
OFFSET_LIMIT = 500_000


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join where a NULL key meets a NULL key; the keys stand once in the result."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys])
    return left.join(renamed, same).drop(*[f"_right_{k}" for k in keys])


def exact_rank(df: DataFrame, key: str, seed, rank: str = "rank", rows: str | None = None, digits: int = 4):
    """Zero-based position of every row in the order of ``md5(seed:key)``, then ``key``.

    Rows fall into ``16**digits`` even buckets by the head of the digest; bucket counts give
    each bucket its offset, and only buckets are sorted. ``key`` must be unique. ``rows`` names a
    column for the total. The offset table has at most ``16**digits`` rows, so it is broadcast.
    """
    head = F.substr(order_digest(seed, F.col(key)), F.lit(1), F.lit(digits))
    counts = df.select(head.alias("_bucket")).groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    ordered = Window.orderBy("_bucket")
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "_bucket",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
        F.sum("_n").over(ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_rows"),
    )
    inside = Window.partitionBy("_bucket").orderBy("_digest", key)
    ranked = (
        df.withColumn("_digest", order_digest(seed, F.col(key)))
        .withColumn("_bucket", F.substr("_digest", F.lit(1), F.lit(digits)))
        .withColumn("_place", F.row_number().over(inside))
        .join(F.broadcast(offsets), "_bucket")
        .withColumn(rank, F.col("_offset") + F.col("_place") - 1)
    )
    if rows:
        ranked = ranked.withColumn(rows, F.col("_rows"))
    return ranked.drop("_digest", "_bucket", "_place", "_offset", "_rows")


def ordinal_within(df: DataFrame, groups: list[str], order: list[str], name: str = "seq") -> DataFrame:
    """Zero-based ordinal of each row in its group, for any order and any group size.

    One range shuffle on (group, order) spreads a hot group over many partitions; the sorted
    layout is frozen, and counts per (group, partition) give the offsets. ``order`` must be
    unique within a group. Rows without a group are a group of their own.
    """
    spread = (
        df.repartitionByRange(*groups, *order)
        .sortWithinPartitions(*groups, *order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_row", F.monotonically_increasing_id())
    )
    spread = frozen(spread)
    keys = [*groups, "_part"]
    parts = spread.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"))
    before = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return (
        null_safe_join(spread, broadcast_checked(parts, OFFSET_LIMIT), keys)
        .withColumn(name, F.col("_offset") + F.col("_row") - F.col("_first"))
        .drop("_part", "_row", "_first", "_offset")
    )


def running_before(
    df: DataFrame, groups: list[str], ordinal: str, sums: dict[str, Column], block: int = 4096
) -> DataFrame:
    """Sum over all earlier rows of the group, one output column per entry of ``sums``.

    ``ordinal`` is a unique integer per group. Blocks of ordinals are summed first (with partial
    aggregation), so a window never holds more than one block or one group's block totals.
    """
    cut = df.withColumn("_block", F.floor(F.col(ordinal) / block).cast("bigint"))
    keys = [*groups, "_block"]
    totals = cut.groupBy(*keys).agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    earlier = Window.partitionBy(*groups).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(
        *keys, *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_b_{n}") for n in sums]
    )
    inside = Window.partitionBy(*keys).orderBy(ordinal).rowsBetween(Window.unboundedPreceding, -1)
    local = cut.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"_l_{n}") for n, c in sums.items()])
    out = null_safe_join(local, bases, keys)
    for n in sums:
        out = out.withColumn(n, F.col(f"_b_{n}") + F.col(f"_l_{n}")).drop(f"_b_{n}", f"_l_{n}")
    return out.drop("_block")


def shuffled(df: DataFrame, key: str, seed: int, epoch: int = 0) -> DataFrame:
    """Global shuffle of one epoch: adds ``epoch`` and ``position``."""
    ranked = exact_rank(df, key, f"{seed}:{epoch}", rank="position")
    return ranked.withColumn("epoch", F.lit(epoch))


def batches(df: DataFrame, key: str, size: int, seed: int, epoch: int = 0, drop_last: bool = False) -> DataFrame:
    """Shuffle, then cut into batches: adds ``epoch``, ``batch_id`` and ``pos_in_batch``."""
    ranked = exact_rank(df, key, f"{seed}:{epoch}", rank="_rank", rows="_total")
    if drop_last:
        ranked = ranked.filter(F.col("_rank") < F.col("_total") - F.col("_total") % size)
    return (
        ranked.withColumn("epoch", F.lit(epoch))
        .withColumn("batch_id", F.floor(F.col("_rank") / size).cast("bigint"))
        .withColumn("pos_in_batch", (F.col("_rank") % size).cast("int"))
        .drop("_rank", "_total")
    )


def batches_by_shard(
    df: DataFrame, key: str, shard: str, size: int, seed: int, epochs: int = 1, drop_last: bool = False, digits: int = 3
) -> DataFrame:
    """Batches as a loader makes them that opens one shard after the other, by name, in every epoch.

    Rows are shuffled within their shard, anew in each epoch, and each shard ends with a short batch (none with ``drop_last``).
    Adds ``epoch``, ``step`` (from 0 through the epoch), ``batch_id`` (in the shard) and ``pos_in_batch``. Ranks come from counts
    of even digest buckets, so a shard that holds most rows is spread like any other. ``key`` is unique in its shard.
    """
    rows = df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    rows = rows.withColumn("_digest", order_digest(seed, F.concat_ws(":", "epoch", F.col(key))))
    rows = rows.withColumn("_bucket", F.substr("_digest", F.lit(1), F.lit(digits)))
    groups = ["epoch", shard]
    counts = rows.groupBy(*groups, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    ordered = Window.partitionBy(*groups).orderBy("_bucket")
    offsets = counts.select(
        *groups, "_bucket",
        F.coalesce(F.sum("_n").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_offset"),
    )
    whole = counts.groupBy(*groups).agg(F.sum("_n").alias("_total"))
    kept = F.col("_total") - F.col("_total") % size if drop_last else F.col("_total")
    earlier = Window.partitionBy("epoch").orderBy(F.asc_nulls_first(shard)).rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.withColumn("_kept", kept)
    whole = whole.withColumn("_before", F.coalesce(F.sum(F.ceil(F.col("_kept") / size)).over(earlier), F.lit(0))).drop("_total")
    inside = Window.partitionBy(*groups, "_bucket").orderBy("_digest", key)
    placed = rows.withColumn("_place", F.row_number().over(inside))
    placed = null_safe_join(placed, broadcast_checked(offsets, OFFSET_LIMIT), [*groups, "_bucket"])
    placed = null_safe_join(placed, broadcast_checked(whole, OFFSET_LIMIT), groups)
    placed = placed.withColumn("_rank", F.col("_offset") + F.col("_place") - 1).filter(F.col("_rank") < F.col("_kept"))
    batch = F.floor(F.col("_rank") / size).cast("bigint")
    placed = placed.withColumns({"step": F.col("_before") + batch, "batch_id": batch, "pos_in_batch": (F.col("_rank") % size).cast("int")})
    return placed.drop("_digest", "_bucket", "_place", "_offset", "_kept", "_before", "_rank")


def train_test(df: DataFrame, key: str, seed: int, test_size: float = 0.2) -> DataFrame:
    """Adds ``split``: exactly ``ceil(test_size * rows)`` rows are ``test``."""
    ranked = exact_rank(df, key, seed, rank="_rank", rows="_total")
    held_out = F.ceil(F.lit(float(test_size)) * F.col("_total"))
    return ranked.withColumn("split", F.when(F.col("_rank") < held_out, "test").otherwise("train")).drop(
        "_rank", "_total"
    )


def first_rows(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows in an explicit order."""
    return df.orderBy(*order).limit(n)


def row_slice(df: DataFrame, row: str, first: int, last: int) -> DataFrame:
    """Rows whose index is in ``[first, last]``, both ends included."""
    return df.filter(F.col(row).between(first, last))


def folds(**frames: DataFrame) -> DataFrame:
    """Ready-made folds as one table with a ``split`` column."""
    tagged = [frame.withColumn("split", F.lit(name)) for name, frame in frames.items()]
    return reduce(DataFrame.unionByName, tagged)


def step_counts(df: DataFrame, groups: list[str], size: int, epochs: int) -> DataFrame:
    """Rows, batches per epoch ``ceil(n/size)`` and scheduled steps ``int(n/size*epochs)``."""
    counted = df.groupBy(*groups).agg(F.count(F.lit(1)).alias("n_rows"))
    return counted.select(
        *groups,
        "n_rows",
        F.ceil(F.col("n_rows") / size).cast("bigint").alias("n_batches"),
        F.floor(F.col("n_rows") / size * epochs).cast("bigint").alias("n_steps"),
    )
