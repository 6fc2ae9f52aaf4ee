"""Loss logs, experiment grids, run records and result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skeinwork.functions.text import model_name
from skeinwork.operators.order import OFFSET_LIMIT, null_safe_join
from skeinwork.session import broadcast_checked

# Tokenizer choice of a run, and the step distance of logged losses.
BASE_MODEL = "bert-base-uncased"
STEP_STRIDE = 350


def loss_blocks(losses: DataFrame, size: int = 10, digits: int = 3) -> DataFrame:
    """Mean of each full block of ``size`` consecutive losses per run; a partial block is left out.

    Input ``(run, seq, loss)``. Grouped by block, so a long run spreads over many tasks.
    """
    block = F.floor(F.col("seq") / size).cast("bigint")
    means = losses.groupBy("run", block.alias("block")).agg(
        F.avg("loss").alias("_mean"), F.count("loss").alias("_n")
    )
    return means.filter(F.col("_n") == size).select("run", "block", F.bround("_mean", digits).alias("mean_loss"))


def step_axis(losses: DataFrame, stride: int = STEP_STRIDE) -> DataFrame:
    """Adds ``step``: gradient step of each logged loss."""
    return losses.withColumn("step", F.col("seq") * stride)


def sampled_steps(losses: DataFrame, step: str = "step", per_epoch: int = 10) -> DataFrame:
    """Losses at every k-th step, ``k = floor(steps/per_epoch)`` per ``(run, epoch)``, at least 1.

    ``step`` counts from 1 in its epoch.
    """
    sizes = losses.groupBy("run", "epoch").agg(F.max(step).alias("_steps"))
    every = F.greatest(F.floor(F.col("_steps") / per_epoch), F.lit(1))
    joined = null_safe_join(losses, broadcast_checked(sizes, OFFSET_LIMIT), ["run", "epoch"])
    return joined.filter(F.col(step) % every == 0).drop("_steps")


def epoch_means(losses: DataFrame, digits: int = 3) -> DataFrame:
    """Mean loss of each ``(run, epoch)``, rounded half-even."""
    return losses.groupBy("run", "epoch").agg(
        F.bround(F.avg("loss"), digits).alias("mean_loss"), F.count("loss").alias("n_losses")
    )


def cumulative_steps(losses: DataFrame) -> DataFrame:
    """``(run, epoch, steps, overall_steps)``: the running total is over per-epoch counts."""
    per_epoch = losses.groupBy("run", "epoch").agg(F.count(F.lit(1)).alias("steps"))
    so_far = Window.partitionBy("run").orderBy("epoch")
    return per_epoch.withColumn("overall_steps", F.sum("steps").over(so_far))


def run_grid(models: DataFrame, seeds: list[int]) -> DataFrame:
    """Every model path with every seed: ``model_path, model_name, tokenizer, seed, run_no``.

    Seeds are a short fixed list, so they are exploded rather than joined.
    """
    is_base = F.col("model_path") == BASE_MODEL
    return models.select(
        "model_path",
        F.when(is_base, F.lit(BASE_MODEL)).otherwise(model_name(F.col("model_path"))).alias("model_name"),
        F.when(is_base, F.lit(BASE_MODEL)).otherwise(F.lit("corpus")).alias("tokenizer"),
        F.posexplode(F.array(*[F.lit(s) for s in seeds])).alias("_no", "seed"),
    ).select("model_path", "model_name", "tokenizer", "seed", (F.col("_no") + 1).alias("run_no"))


def run_records(scores: DataFrame, batch_size: int, epochs: int, metric: str, by: list[str] = ()) -> DataFrame:
    """One record per model (and value of the columns ``by``) from ``(model_name, run_no, seed, score)``: seeds and scores in run
    order, scores rounded to 6 digits and their mean to 4, both half-even."""
    rounded = scores.withColumn("score", F.bround("score", 6))
    grouped = rounded.groupBy(*by, "model_name").agg(
        F.sort_array(F.collect_list(F.struct("run_no", "seed", "score"))).alias("_runs"),
        F.bround(F.avg("score"), 4).alias("mean_score"),
    )
    return grouped.select(
        *by,
        "model_name",
        F.col("_runs.seed").alias("seeds"),
        F.lit(batch_size).alias("batch_size"),
        F.lit(epochs).alias("epochs"),
        F.lit(metric).alias("metric"),
        F.col("_runs.score").alias("scores"),
        "mean_score",
    )


def stacked_results(records: DataFrame) -> DataFrame:
    """Model, metric and mean score of the run records of all tasks, one table with ``task``."""
    return records.select("task", "model_name", "metric", F.col("mean_score").alias("score"))


def with_columns_by_row(df: DataFrame, extra: DataFrame, row: str = "row_idx", limit: int = 1_000_000) -> DataFrame:
    """Attach columns by an explicit row index."""
    return df.join(broadcast_checked(extra, limit), row, "left")


def with_overrides(df: DataFrame, overrides: DataFrame, row: str, column: str, limit: int = 1_000_000) -> DataFrame:
    """Replace ``column`` in the rows the override table names."""
    new = overrides.select(row, F.col(column).alias("_new"))
    joined = df.join(broadcast_checked(new, limit), row, "left")
    return joined.withColumn(column, F.coalesce("_new", column)).drop("_new")


def best_first(df: DataFrame) -> DataFrame:
    return df.orderBy(F.desc("score"), "model_name")
