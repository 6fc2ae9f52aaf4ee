"""Shared helpers of the training-data operators: byte-level numpy work on Arrow batches, and stored stages."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwork.session import stored  # noqa: F401

#: Bytes of text that one numpy pass takes at once; bounds a worker's memory, not what is read.
PASS_BYTES = 4 << 20
#: The same where rows are worked on one by one and nothing is settled between them.
ROW_BYTES = 2 << 20
#: A missing document id sorts after every other.
NO_ID = np.iinfo(np.int64).max

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True

U = np.uint64
_MIX = U(0x9E3779B97F4A7C15)
BASES = (U(0xD6E8FEB86659FD93), U(0xA0761D6478BD642F))
STEPS = (U(0xE7037ED1A0B428DB), U(0x8EBC6AF09C88C6E3))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def removed(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files of a stored stage that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for parent in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(parent)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


class Held:
    """Stored stages of one operator, deleted together when its result is stored."""

    def __init__(self) -> None:
        self.stages: list[DataFrame] = []

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        self.stages.append(stored(df, name))
        return self.stages[-1]

    def clear(self) -> None:
        for stage in self.stages:
            removed(stage.sparkSession, stage)
        self.stages = []


def parts(spark: SparkSession) -> int:
    """Into how many parts keyed stages are dealt: as many as the session's shuffles."""
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names that no column of ``df`` has in any case, one for each given."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def slices(batches: Iterator[pa.RecordBatch], column: str, budget: int = PASS_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that ``column`` holds about ``budget`` bytes in each; a longer row stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes.astype(np.int64))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + budget, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and where each row begins (one offset more than rows); null is empty."""
    rows = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(rows.buffers()[1], np.int64)[rows.offset : rows.offset + len(rows) + 1]
    data = np.frombuffer(rows.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def ids(column: pa.Array) -> np.ndarray:
    return pc.fill_null(column.cast(pa.int64()), int(NO_ID)).to_numpy(zero_copy_only=False)


def word_bounds(data: np.ndarray, offsets: np.ndarray, blank: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of bytes outside ``blank``; no run crosses a row."""
    if not data.size:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    inside = ~blank[data]
    edge = np.zeros(data.size + 1, bool)
    edge[offsets] = True
    begins, closes = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    closes[:-1] &= ~inside[1:] | edge[1:-1]
    return np.flatnonzero(begins), np.flatnonzero(closes) + 1


def mixed(x: np.ndarray) -> np.ndarray:
    """A reversible scramble of 64-bit values."""
    x = (x ^ (x >> U(32))) * _MIX
    x = (x ^ (x >> U(29))) * BASES[1]
    return x ^ (x >> U(32))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, U)
    out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, count: int = 2) -> list[np.ndarray]:
    """``count`` independent 64-bit hashes of each word, by polynomials over its bytes."""
    if not starts.size:
        return [np.empty(0, U)] * count
    sizes = ends - starts
    first = np.cumsum(sizes) - sizes
    at = np.arange(int(sizes.sum()))
    place = at - np.repeat(first, sizes)
    values = data[at + np.repeat(starts - first, sizes)].astype(U) + U(1)
    most = int(sizes.max())
    return [mixed(np.add.reduceat(values * powers(base, most)[place], first)) for base in BASES[:count]]


def run_hash(words: np.ndarray, n: int, step: np.uint64) -> np.ndarray:
    """A hash of each run of ``n`` consecutive values; the last ``n - 1`` have none."""
    size = max(0, words.size - n + 1)
    out = words[n - 1 : n - 1 + size].copy()
    for k in range(n - 2, -1, -1):
        out *= step
        out += words[k : k + size]
    return mixed(out)


def covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of ``n`` places lie in one of the half-open ranges."""
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, starts, 1)
    np.add.at(depth, ends, -1)
    return np.cumsum(depth[:n]) > 0


def dealt(df: DataFrame, n: int, key: str = "dest") -> DataFrame:
    """Rows to the part that ``key`` names."""
    return df.repartitionById(n, F.col(key))


def rows_batch(schema: str | pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(columns, schema=schema)
