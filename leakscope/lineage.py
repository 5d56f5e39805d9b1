"""Tables written to the folder that all executors share.

A written table cuts the lineage of what is built on it: later plans scan a file instead of
repeating the work behind it, and a lost executor costs a re-read.
"""

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from leakscope.session import shared_dir


# Spark removes the shuffle files of an execution when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one, for output that belongs to one run."""
    return f"{shared_dir(spark)}/leakscope/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Tables written inside leave no shuffle files behind.

    Nothing reads the shuffles of a finished write again, but without this they stay on the
    executors' disks until the driver collects its garbage, next to those of every later write.
    """
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def store(df: DataFrame, path: str) -> None:
    """Write an intermediate table; only this application reads it."""
    with shuffles_dropped(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """The table written once to a new folder, and read from there."""
    path = fresh_path(df.sparkSession, name)
    store(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
