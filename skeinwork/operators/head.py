"""Linear heads on embedding columns: scoring with given weights, and fitting."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinwork.functions.arrays import literal_array
from skeinwork.operators.metrics import sigmoid, softmax


def centroids(df: DataFrame, vector: str, label: str, dims: int) -> DataFrame:
    """``(label, weights)``: mean vector per label, one averaged column per dimension."""
    means = [F.avg(F.get(F.col(vector), F.lit(i)).cast("double")) for i in range(dims)]
    return df.groupBy(label).agg(F.array(*means).alias("weights"))


def weight_rows(weights: DataFrame, label: str, limit: int = 10_000) -> list[list[float]]:
    """Weights in label order on the driver; a head has one row per class."""
    rows = weights.orderBy(label).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} classes")
    return [list(row["weights"]) for row in rows]


def dot(vector: Column, weights: list[float]) -> Column:
    products = F.zip_with(vector, literal_array([float(w) for w in weights], "double"), lambda x, w: x * w)
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def score_head(
    df: DataFrame, vector: str, weights: list[list[float]], bias: list[float] | None = None, activation: str = "softmax"
) -> DataFrame:
    """Adds ``scores``: the linear head per class, then ``softmax``, ``sigmoid`` or ``none``."""
    bias = bias or [0.0] * len(weights)
    wide = df.withColumn("_v", F.col(vector).cast("array<double>"))
    raw = F.array(*[dot(F.col("_v"), row) + F.lit(float(b)) for row, b in zip(weights, bias)])
    scored = wide.withColumn("_raw", raw)
    shaped = {"softmax": softmax, "sigmoid": sigmoid, "none": lambda c: c}[activation](F.col("_raw"))
    return scored.withColumn("scores", shaped).drop("_v", "_raw")


def fit_head(train: DataFrame, test: DataFrame, vector: str, label: str, epochs: int = 20, reg: float = 1e-3) -> DataFrame:
    """Fit a multinomial head on ``train`` and score ``test``: adds ``scores`` and ``pred``."""

    def vectors(df: DataFrame) -> DataFrame:
        return df.withColumn("_features", array_to_vector(F.col(vector).cast("array<double>")))

    model = LogisticRegression(
        featuresCol="_features", labelCol=label, family="multinomial", maxIter=epochs, regParam=reg,
        probabilityCol="_scores", predictionCol="_pred", rawPredictionCol="_raw",
    ).fit(vectors(train).select("_features", F.col(label).cast("double").alias(label)))
    return (
        model.transform(vectors(test))
        .withColumn("scores", vector_to_array("_scores"))
        .withColumn("pred", F.col("_pred").cast("int"))
        .drop("_features", "_scores", "_pred", "_raw")
    )


#: Numbers of all heads together, which the driver and every task hold.
HEAD_LIMIT = 5_000_000


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def usable(df: DataFrame, vector: str, dims: int) -> DataFrame:
    """Rows whose vector has ``dims`` components, none of them null, NaN or infinite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    return df.filter((F.size(vector) == dims) & finite)


def fit_heads(
    df: DataFrame, vector: str, label: str, splits: list[str], dims: int, steps: int = 5, rate: float = 1.0, limit: int = 10_000
) -> tuple[list, np.ndarray]:
    """The classes and, per column of ``splits``, the weights (class, component) of a softmax head fitted on its rows with
    ``train`` there.

    All heads take each step in the same pass: full-batch gradients of the mean log loss from zero weights, summed per task
    before they are summed over tasks. Rows without a label or a usable vector take no part; a split without rows stays at zero.
    """
    rows = usable(df, vector, dims).filter(F.col(label).isNotNull())
    classes = [r[0] for r in rows.select(label).distinct().orderBy(label).limit(limit + 1).collect()]
    shape = (len(splits), len(classes), dims)
    if len(classes) > limit or np.prod(shape) > HEAD_LIMIT:
        raise ValueError(f"more than {limit} classes or {HEAD_LIMIT} weights")
    weights = np.zeros(shape)
    if not classes:
        return classes, weights
    train = [(F.col(s) == "train").cast("int").alias(f"s{k}") for k, s in enumerate(splits)]
    rows = rows.select(F.col(vector).cast("array<double>").alias("v"), (F.array_position(F.lit(classes), F.col(label)) - 1).cast("int").alias("y"), *train)
    counts = rows.agg(*[F.coalesce(F.sum(f"s{k}"), F.lit(0)) for k in range(len(splits))]).first()
    sizes = np.maximum(np.array(counts, float), 1)[:, None, None]
    for _ in range(steps):
        held = weights

        def slopes(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            total = np.zeros(shape)
            for batch in batches:
                if not batch.num_rows:
                    continue
                x, y = _matrix(batch.column("v"), dims), batch.column("y").to_numpy()
                for k in range(len(splits)):
                    mine = batch.column(f"s{k}").to_numpy(zero_copy_only=False) == 1
                    z = x[mine] @ held[k].T
                    chance = np.exp(z - z.max(1, keepdims=True))
                    chance /= chance.sum(1, keepdims=True)
                    chance[np.arange(chance.shape[0]), y[mine]] -= 1
                    total[k] += chance.T @ x[mine]
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total.ravel()[some])], ["at", "slope"])

        found = rows.mapInArrow(slopes, "at int, slope double").groupBy("at").agg(F.sum("slope").alias("slope")).collect()
        slope = np.zeros(weights.size)
        slope[[r["at"] for r in found]] = [r["slope"] for r in found]
        weights = weights - rate * slope.reshape(shape) / sizes
    return classes, weights


def heads_predicted(df: DataFrame, vector: str, keep: list[str], classes: list, weights: np.ndarray) -> DataFrame:
    """Columns ``keep`` of the rows with a usable vector, and ``preds``: the place in ``classes`` that each head scores best."""
    dims = weights.shape[2]
    rows = usable(df, vector, dims).select(*keep, F.col(vector).cast("array<double>").alias("preds"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1]) + ", preds array<int>"

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("preds"), dims)
            chosen = np.stack([(x @ w.T).argmax(1) for w in weights], 1).astype(np.int32)
            yield batch.set_column(len(keep), "preds", pa.array(chosen.tolist(), pa.list_(pa.int32())))

    return rows.mapInArrow(best, schema)
