"""Quality classifier: a factorisation machine over hashed words, structure statistics and the length."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwork.llm import common

#: Labelled rows that training takes at most, those of smallest id digest. Scoring takes every row.
TRAIN_ROWS = 6_000
#: Buckets of hashed words, and statistics after them.
WORD_BITS = 16
THRESHOLD = 0.3
FACTORS, EPOCHS, BATCH, RATE, DECAY = 8, 6, 64, 0.05, 1e-5

_GROUPS = {
    "upper": range(0x41, 0x5B), "lower": range(0x61, 0x7B), "digit": range(0x30, 0x3A), "blank": [0x20, 0x09, 0x0B, 0x0C, 0x0D],
    "line": [0x0A], "stop": b".,;:", "loud": b"!?", "bars": b"|<>[]{}\\\\/_=", "signs": b"#$%&*@~^+", "wide": range(0x80, 0x100),
}
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
#: The group of each byte; the last is for all others.
_GROUP_OF = np.full(256, len(_GROUPS), np.uint8)
for _k, _group in enumerate(_GROUPS.values()):
    _GROUP_OF[list(_group)] = _k
#: Shares of byte groups, mean and spread of word and line lengths, distinct share, log sizes, each in eight steps.
STATISTICS = len(_GROUPS) + 6
STEPS = 8
FEATURES = (1 << WORD_BITS) + STATISTICS * STEPS + STATISTICS


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows' features as (row, feature, value), sorted by row.

    A word hash weighs 1/sqrt(distinct hashes of the row) however often the word comes; each statistic is given as it is and
    as the one of eight steps it falls in. A row without words has its statistics, all zero.
    """
    n = offsets.size - 1
    starts, ends = common.word_bounds(data, offsets)
    owner = np.searchsorted(offsets, starts, "right") - 1
    lower = _LOWER[data]
    bucket = (common.word_hashes(lower, starts, ends, 1)[0] >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    pairs = np.sort((owner << WORD_BITS) | bucket)
    pairs = pairs[np.append(True, pairs[1:] != pairs[:-1])] if pairs.size else pairs
    rows, words = pairs >> WORD_BITS, pairs & ((1 << WORD_BITS) - 1)
    distinct = np.bincount(rows, minlength=n)
    size = np.maximum(offsets[1:] - offsets[:-1], 1)
    stats = np.zeros((n, STATISTICS))
    row_of = np.repeat(np.arange(n, dtype=np.int32) * 16, np.diff(offsets)) + _GROUP_OF[data]
    stats[:, : len(_GROUPS)] = np.bincount(row_of, minlength=n * 16).reshape(n, 16)[:, : len(_GROUPS)] / size[:, None]
    lengths = (ends - starts).astype(float)
    words_n = np.bincount(owner, minlength=n)
    mean = np.bincount(owner, lengths, n) / np.maximum(words_n, 1)
    spread = np.sqrt(np.maximum(np.bincount(owner, lengths**2, n) / np.maximum(words_n, 1) - mean**2, 0))
    k = len(_GROUPS)
    line_n = stats[:, list(_GROUPS).index("line")] * size + 1
    stats[:, k] = mean / 10
    stats[:, k + 1] = spread / 10
    stats[:, k + 2] = distinct / np.maximum(words_n, 1)
    stats[:, k + 3] = np.log1p(words_n) / 10
    stats[:, k + 4] = np.log1p(size / line_n) / 10
    stats[:, k + 5] = np.log1p(line_n) / 10
    base = 1 << WORD_BITS
    step = np.clip(np.floor(np.sqrt(np.clip(stats, 0, 1)) * STEPS), 0, STEPS - 1).astype(np.int64)
    column = np.arange(STATISTICS)
    all_rows = np.concatenate([rows, np.repeat(np.arange(n), 2 * STATISTICS)])
    own = np.concatenate([base + column * STEPS + step, np.broadcast_to(base + STATISTICS * STEPS + column, (n, STATISTICS))], 1)
    value = np.concatenate([np.full((n, STATISTICS), 0.5), stats], 1)
    columns = np.concatenate([words, own.ravel()])
    values = np.concatenate([1 / np.sqrt(np.maximum(distinct[rows], 1)), value.ravel()])
    order = np.argsort(all_rows, kind="stable")
    return all_rows[order], columns[order], values[order].astype(np.float32)


@dataclass
class Machine:
    """A factorisation machine: bias, a weight per feature, and a factor vector per feature for the pairs."""

    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def margins(self, rows: np.ndarray, columns: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
        """bias + sum w x + half of (sum v x)^2 - sum (v x)^2 per factor: all pairs in time linear in the features."""
        if not rows.size:
            return np.full(n, self.bias)
        starts = np.searchsorted(rows, np.arange(n))
        vx = self.factors[columns] * values[:, None]
        linear = np.add.reduceat(self.weights[columns] * values, starts)
        total, squares = np.add.reduceat(vx, starts), np.add.reduceat(vx * vx, starts)
        return self.bias + linear + 0.5 * (total**2 - squares).sum(1)

    def scores(self, rows, columns, values, n) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(rows, columns, values, n), -30, 30)))


def fit(examples: list[tuple[np.ndarray, np.ndarray, int]], seed: int = 7) -> Machine:
    """Fit by AdaGrad on (columns, values, label) rows in a fixed shuffled order; both labels weigh the same in sum."""
    rng = np.random.default_rng(seed)
    model = Machine(0.0, np.zeros(FEATURES, np.float32), rng.normal(0, 0.01, (FEATURES, FACTORS)).astype(np.float32))
    labels = np.array([y for *_, y in examples], float)
    if not labels.size:
        return Machine(0.0, model.weights, np.zeros_like(model.factors))
    share = labels.mean()
    if share in (0.0, 1.0):
        model.bias = 30.0 if share else -30.0
        return model
    model.bias = float(np.log(share / (1 - share)))
    seen_w, seen_v = np.full(FEATURES, 1e-6, np.float32), np.full((FEATURES, FACTORS), 1e-6, np.float32)
    for _ in range(EPOCHS):
        order = rng.permutation(labels.size)
        for begin in range(0, order.size, BATCH):
            some = order[begin : begin + BATCH]
            sizes = np.array([examples[i][0].size for i in some])
            rows = np.repeat(np.arange(some.size), sizes)
            columns = np.concatenate([examples[i][0] for i in some])
            values = np.concatenate([examples[i][1] for i in some])
            wrong = ((model.scores(rows, columns, values, some.size) - labels[some]) / some.size)[rows].astype(np.float32)
            vx = model.factors[columns] * values[:, None]
            total = np.add.reduceat(vx, np.cumsum(sizes) - sizes)[rows]
            touched, at = np.unique(columns, return_inverse=True)
            grad_w = np.bincount(at, wrong * values, touched.size) + DECAY * model.weights[touched]
            slope = (wrong * values)[:, None] * (total - vx)
            grad_v = np.stack([np.bincount(at, slope[:, f], touched.size) for f in range(FACTORS)], 1) + DECAY * model.factors[touched]
            seen_w[touched] += grad_w**2
            seen_v[touched] += grad_v**2
            model.weights[touched] -= RATE * grad_w / np.sqrt(seen_w[touched])
            model.factors[touched] -= RATE * grad_v / np.sqrt(seen_v[touched])
    return model


def held_out():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Machine:
    """Fit on at most ``rows`` labelled documents whose id isn't held out.

    Features are taken on the executors; the driver gets only the sparse features of those rows. Rows with a null id, label or
    text are left out; an id with several labels or rows gives as many examples, but all are ``rows`` at most.
    """
    chosen = labels.filter("doc_id is not null and quality is not null").filter(~held_out()).select("doc_id", "quality")
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(rows)
    found = docs.select("doc_id", "text").filter("text is not null").join(F.broadcast(chosen), "doc_id")

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text", common.ROW_BYTES):
            row, column, value = features(*common.flat(batch.column("text")))
            cuts = np.searchsorted(row, np.arange(batch.num_rows + 1))
            spans = list(zip(cuts[:-1], cuts[1:], strict=True))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()),
                    batch.column("quality").cast(pa.int32()),
                    pa.array([column[a:b].astype(np.int32).tobytes() for a, b in spans], pa.binary()),
                    pa.array([value[a:b].tobytes() for a, b in spans], pa.binary()),
                ],
                ["doc_id", "quality", "columns", "values"],
            )

    sample = found.mapInArrow(take, "doc_id long, quality int, columns binary, values binary")
    sample = sample.orderBy("doc_id", "quality", "columns").limit(rows).collect()
    sample.sort(key=lambda r: (r["doc_id"], r["quality"], bytes(r["columns"])))
    return fit([(np.frombuffer(r["columns"], np.int32), np.frombuffer(r["values"], np.float32), r["quality"]) for r in sample])


def score(spark: SparkSession, docs: DataFrame, model: Machine) -> DataFrame:
    """(doc_id, score) of every row, score in 0 to 1; null and empty texts are scored by their (zero) statistics."""
    held = spark.sparkContext.broadcast((model.bias, model.weights, model.factors))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Machine(*held.value)
        for batch in common.slices(batches, "text", common.ROW_BYTES):
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(_scores(machine, batch))], ["doc_id", "score"]
            )

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, score double")


def _scores(machine: Machine, batch: pa.RecordBatch) -> np.ndarray:
    row, column, value = features(*common.flat(batch.column("text")))
    return machine.scores(row, column, value, batch.num_rows).astype(np.float64)


def judged(spark: SparkSession, docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; predicted is 1 from ``threshold`` on.

    A null id is not held out. Without labelled rows every score is one half; repeated rows each get a row.
    """
    found = score(spark, docs, train(docs, labels, rows))
    out = F.coalesce(held_out(), F.lit(False)).alias("held_out")
    return found.select("doc_id", out, "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(spark: SparkSession, docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, all columns kept."""
    model = train(docs, labels, rows)
    held = spark.sparkContext.broadcast((model.bias, model.weights, model.factors))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Machine(*held.value)
        for batch in common.slices(batches, "text", common.ROW_BYTES):
            yield batch.filter(pa.array(_scores(machine, batch) >= threshold))

    return docs.mapInArrow(keep, docs.schema)
