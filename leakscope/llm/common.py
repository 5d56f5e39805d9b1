"""Helpers shared by the corpus operators."""

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leakscope.llm import memory
from leakscope.session import shared_dir

# Up to so many rows of ids or hashes (16 bytes each) a join side may be broadcast.
BROADCAST_ROWS = 1_000_000


def written(df: DataFrame, name: str) -> DataFrame:
    """The table written once to the folder that all executors share, and read from there.

    This cuts the lineage: a lost executor costs a re-read, never a re-run of the steps before.
    """
    spark: SparkSession = df.sparkSession
    path = f"{shared_dir(spark)}/leakscope-llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A narrow table with a broadcast hint if counting shows at most `rows` rows, else as it is.

    Without the hint the planner shuffles both sides, so the result is the same at any size.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


_shipped: set[str] = set()


def _bounded(run):
    """`run` over slices of the batches, with the worker's memory looked after."""
    name = f"{run.__module__}.{run.__qualname__}"

    def bounded(batches):
        memory.enter(name)
        try:
            yield from run(memory.sliced(batches))
        finally:
            memory.release()

    return bounded


def mapped(df: DataFrame, run, schema) -> DataFrame:
    """`df.mapInArrow(run, schema)`, with this package's code sent to the executors once.

    `run` gets batches of a bounded number of bytes, unless a single row is longer.
    """
    context = df.sparkSession.sparkContext
    if context.applicationId not in _shipped:
        package = Path(__file__).resolve().parents[1]
        archive = shutil.make_archive(
            f"{tempfile.mkdtemp()}/{package.name}", "zip", package.parent, package.name)
        context.addPyFile(archive)
        _shipped.add(context.applicationId)
    return df.mapInArrow(_bounded(run), schema)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")
