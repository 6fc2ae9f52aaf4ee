"""Input tables of the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# Set by tests and the bench: their tables are one small file, which is one task if it isn't dealt out.
SPREAD_KEY = "spark.skeinwork.spread"


def spread(df: DataFrame) -> DataFrame:
    """``df`` as it is read; dealt to as many tasks as the session names under ``SPREAD_KEY``, if it does."""
    tasks = df.sparkSession.conf.get(SPREAD_KEY, None)
    return df.repartition(int(tasks)) if tasks else df


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "documents"))
