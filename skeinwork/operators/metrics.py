"""Evaluation: F1, accuracy, class reports, log loss, batch losses, ranked candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinwork.functions.arrays import let


def _ratio(top: Column, bottom: Column) -> Column:
    """Quotient with 0 for a zero denominator."""
    return F.when(bottom == 0, F.lit(0.0)).otherwise(top / bottom)


def accuracy(df: DataFrame, pred: str = "pred", truth: str = "truth", by: list[str] = ()) -> DataFrame:
    """Share of rows with ``pred`` equal to ``truth``."""
    hits = F.sum((F.col(pred) == F.col(truth)).cast("bigint"))
    return df.groupBy(*by).agg(_ratio(hits, F.count(F.lit(1))).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def token_micro_f1(df: DataFrame, pred: str, truth: str, by: list[str] = ()) -> DataFrame:
    """Micro-F1 of single labels, counted over all positions of two equally long arrays."""
    hit = F.size(F.filter(F.zip_with(pred, truth, lambda a, b: a == b), lambda same: same))
    return df.groupBy(*by).agg(
        _ratio(F.sum(hit.cast("bigint")), F.sum(F.size(truth).cast("bigint"))).alias("micro_f1"),
        F.sum(F.size(truth).cast("bigint")).alias("n"),
    )


def multilabel_micro_f1(df: DataFrame, pred: str, truth: str, by: list[str] = ()) -> DataFrame:
    """Micro-F1 over the cells of 0/1 arrays: ``2TP / (2TP + FP + FN)``."""
    both = F.aggregate(F.zip_with(pred, truth, lambda a, b: a * b), F.lit(0), lambda s, x: s + x)
    ones = F.aggregate(pred, F.lit(0), lambda s, x: s + x)
    real = F.aggregate(truth, F.lit(0), lambda s, x: s + x)
    counted = df.groupBy(*by).agg(
        F.sum(both).alias("tp"), F.sum(ones - both).alias("fp"), F.sum(real - both).alias("fn")
    )
    tp, wrong = F.col("tp"), F.col("fp") + F.col("fn")
    return counted.withColumn("micro_f1", _ratio(2.0 * tp, 2 * tp + wrong))


def class_report(df: DataFrame, pred: str = "pred", truth: str = "truth") -> DataFrame:
    """Per class ``precision, recall, f1, support``, then accuracy, macro and weighted averages.

    Classes are all values seen on either side; a missing value is no class, but a row whose prediction
    is missing counts in its truth's support. The confusion counts are reduced before anything
    else, so every later step works on at most classes squared rows.
    """
    cells = df.groupBy(F.col(truth).cast("string").alias("t"), F.col(pred).cast("string").alias("p")).agg(
        F.count(F.lit(1)).alias("n")
    )
    sides = cells.select(
        F.explode(
            F.array(
                F.struct(F.col("t").alias("label"), F.lit(0).alias("as_pred"), F.lit(1).alias("as_truth")),
                F.struct(F.col("p").alias("label"), F.lit(1).alias("as_pred"), F.lit(0).alias("as_truth")),
            )
        ).alias("s"),
        "n",
        (F.col("t") == F.col("p")).cast("int").alias("same"),
    ).select("s.*", "n", "same").filter(F.col("label").isNotNull())
    per_class = (
        sides.groupBy("label")
        .agg(
            F.sum(F.col("n") * F.col("as_pred")).alias("predicted"),
            F.sum(F.col("n") * F.col("as_truth")).alias("support"),
            F.sum(F.col("n") * F.col("as_truth") * F.col("same")).alias("hits"),
        )
        .withColumn("precision", _ratio(F.col("hits"), F.col("predicted")))
        .withColumn("recall", _ratio(F.col("hits"), F.col("support")))
        .withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    )
    scores = ["precision", "recall", "f1"]
    total = F.sum("support")
    averages = per_class.agg(
        F.array(
            F.struct(
                F.lit("accuracy").alias("label"),
                *[_ratio(F.sum("hits"), total).alias(s) for s in scores],
                total.alias("support"),
            ),
            F.struct(F.lit("macro avg").alias("label"), *[F.avg(s).alias(s) for s in scores], total.alias("support")),
            F.struct(
                F.lit("weighted avg").alias("label"),
                *[_ratio(F.sum(F.col(s) * F.col("support")), total).alias(s) for s in scores],
                total.alias("support"),
            ),
        ).alias("rows")
    )
    columns = ["label", *scores, "support"]
    return per_class.select(*columns).unionByName(averages.select(F.inline("rows")).select(*columns))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def cross_entropy(scores: Column, truth: Column, already_softmax: bool = False) -> Column:
    """Loss of one row of class scores; with ``already_softmax`` the scores are probabilities
    and a plain log is taken instead of a second softmax."""
    if already_softmax:
        return -F.log(F.get(scores, truth))
    total = let(F.array_max(scores), lambda top: F.log(_sum(F.transform(scores, lambda x: F.exp(x - top)))) + top)
    return total - F.get(scores, truth)


def softmax(scores: Column) -> Column:
    powers = let(F.array_max(scores), lambda top: F.transform(scores, lambda x: F.exp(x - top)))
    return let(powers, lambda p: let(_sum(p), lambda total: F.transform(p, lambda x: x / total)))


def sigmoid(scores: Column) -> Column:
    return F.transform(scores, lambda x: 1 / (1 + F.exp(-x)))


def binary_cross_entropy(logits: Column, truth: Column) -> Column:
    """Mean over cells of the loss of 0/1 targets against raw logits."""
    cells = F.zip_with(
        logits, truth, lambda z, y: F.greatest(z, F.lit(0.0)) - z * y + F.log1p(F.exp(-F.abs(z)))
    )
    return _sum(cells) / F.size(logits)


def mean_loss(df: DataFrame, loss: Column, by: list[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(loss).alias("loss"))


def batch_mean_loss(df: DataFrame, batch: str, loss: str, by: list[str] = ()) -> DataFrame:
    """Unweighted mean of batch means; a short last batch counts as much as a full one."""
    means = df.groupBy(*by, batch).agg(F.avg(loss).alias("_mean"))
    return means.groupBy(*by).agg(F.avg("_mean").alias("loss"), F.count(F.lit(1)).alias("n_batches"))


def top_candidates(df: DataFrame, item: str, candidate: str, score: str, k: int = 5) -> DataFrame:
    """The ``k`` best candidates of each item. The rank limit is applied before the shuffle too,
    so an item with very many candidates sends ``k`` rows per task."""
    order = Window.partitionBy(item).orderBy(F.desc(score), F.asc(candidate))
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def joined_predictions(predictions: DataFrame, truth: DataFrame, key: str) -> DataFrame:
    """Predictions and truth joined on their key instead of by position."""
    return predictions.join(truth, key)
