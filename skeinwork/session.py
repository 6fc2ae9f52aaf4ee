"""Session helpers: a local session for tests, the shared scratch folder, size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(cpus: int | str = 8, **conf: str) -> SparkSession:
    """A session for tests and the bench; on a cluster the caller brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("skeinwork")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.skeinwork.spread", str(cpus) if str(cpus).isdigit() else "8")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see, as the session names it.

    Only a local session may fall back to a folder of its own.
    """
    folder = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if folder:
        return folder.rstrip("/")
    known = spark.sparkContext.getCheckpointDir()
    if known:
        return known.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_KEY} to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; every call gives another one."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def frozen(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there.

    What was drawn from physical placement (partition ids, row positions) becomes data, so a
    lost executor cannot change it.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, in compressed columns: later steps don't repeat the work, read only
    the columns they use, and no lost executor takes it along."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def at_most(df: DataFrame, limit: int) -> bool:
    """Whether ``df`` has no more than ``limit`` rows; reads ``limit + 1`` at most."""
    return df.limit(limit + 1).count() <= limit


def broadcast_checked(df: DataFrame, limit: int) -> DataFrame:
    """Hint a broadcast only after counting; beyond ``limit`` rows the join shuffles."""
    return F.broadcast(df) if at_most(df, limit) else df


def hot_and_cold(df: DataFrame, limit: int, n: str = "n") -> tuple[DataFrame, DataFrame | None]:
    """Part a lookup table with counts so that its hot keys can be broadcast.

    With at most ``limit`` rows all of it is hot. Otherwise hot are the keys counted at least
    ``total/limit`` times, which cannot be more than ``limit``; no cold key is frequent enough to
    skew a shuffle.
    """
    if at_most(df, limit):
        return F.broadcast(df), None
    total = df.agg(F.sum(n)).first()[0]
    return F.broadcast(df.filter(F.col(n) * limit >= total)), df.filter(F.col(n) * limit < total)
