"""Streams: the loss monitor over an append-only loss log, and corpus preparation row by row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from skeinwork.functions.text import normalise, sentences
from skeinwork.operators.language import accepted

# Blocks of a run that share a state.
PART = 1024
LOSS_SCHEMA = "run STRING, epoch INT, seq BIGINT, loss DOUBLE"


def loss_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Losses as they are appended to a folder."""
    return (
        spark.readStream.schema(LOSS_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    )


def _settled(size: int):
    """The stateful step of one part of a run: emits each block that has become whole, and forgets its losses."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done, seqs, values = state.get if state.exists else (bytes(PART // 8), [], [])
        whole = np.unpackbits(np.frombuffer(done, np.uint8)).astype(bool)
        open_blocks: dict[int, dict[int, float | None]] = {}
        for seq, value in zip(seqs, values, strict=True):
            open_blocks.setdefault(seq // size, {})[seq] = value
        first = int(key[1]) * PART
        for frame in frames:
            lines = frame[["seq", "loss"]].sort_values(["seq", "loss"]).drop_duplicates("seq")
            for seq, value in zip(lines["seq"].tolist(), lines["loss"].tolist(), strict=True):
                if not whole[seq // size - first]:
                    open_blocks.setdefault(seq // size, {}).setdefault(seq, value)
        rows = []
        for block in sorted(b for b, held in open_blocks.items() if len(held) == size):
            held = open_blocks.pop(block)
            rows.append((key[0], block, sum(held[seq] for seq in sorted(held))))
            whole[block - first] = True
        left = [item for held in open_blocks.values() for item in held.items()]
        state.update((np.packbits(whole).tobytes(), [seq for seq, _ in left], [value for _, value in left]))
        if rows:
            yield pd.DataFrame(rows, columns=["run", "block", "total"]).astype({"run": object, "block": "int64", "total": "float64"})

    return step


def block_totals(losses: DataFrame, size: int = 10) -> DataFrame:
    """``(run, block, total)`` of each block of ``size`` losses, once, when its last line has come.

    A line that comes again counts once, also after its block was emitted; of lines of one number in a micro-batch the smallest
    counts. A part of a run, ``PART`` blocks, holds a bit for each emitted block and the losses of the blocks that are not whole
    yet, and a long run is many keys. Blocks that never fill stay open; what has passed leaves a bit a block. (A timer on processing
    time would make Spark run empty micro-batches without end where a query is to end with its input.)
    """
    part = F.floor(F.col("seq") / (size * PART)).cast("bigint").alias("part")
    return losses.filter(F.col("seq") >= 0).select("run", "seq", "loss", part).groupBy("run", "part").applyInPandasWithState(
        _settled(size), "run STRING, block BIGINT, total DOUBLE", "done BINARY, seqs ARRAY<BIGINT>, held ARRAY<DOUBLE>",
        "append", GroupStateTimeout.NoTimeout,
    )


def watch_blocks(losses: DataFrame, out: str, checkpoint: str, size: int = 10, digits: int = 3) -> list[int]:
    """Write the mean of each block once it is complete, for all input there is now, exactly once, also over restarts.

    Returns the number of keys in the state after each micro-batch.
    """
    means = block_totals(losses, size).select("run", "block", F.bround(F.col("total") / size, digits).alias("mean_loss"))
    query = (
        means.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]


def prepared(documents: DataFrame) -> DataFrame:
    """Kept documents as sentences and normalised text: no state and no shuffle, batch or stream."""
    return accepted(documents).select(
        "doc_id", sentences(F.col("text")).alias("sentences"), normalise(F.col("text")).alias("normal")
    )


def run_to_files(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Write a stateless stream to Parquet exactly once, for all input there is now."""
    query = (
        stream.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def run_batches(stream: DataFrame, work, out: str, checkpoint: str) -> None:
    """Apply a batch operator that needs joins or counts (such as encoding) to each micro-batch."""

    def each(batch: DataFrame, batch_id: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    query = (
        stream.writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(each)
        .start()
    )
    query.awaitTermination()
