"""Tables that several queries of a session share, written once to the shared folder.

Candidates and recommendations feed many tables. Writing them cuts their lineage: later plans
scan a small file instead of repeating every scan behind it, and a lost executor costs a re-read.
"""

from pyspark.sql import DataFrame, SparkSession

from leakscope.lineage import fresh_path, store

_written: dict[tuple, str] = {}


def staged(spark: SparkSession, sf: str, name: str, build) -> DataFrame:
    """The named table over the given input, built at its first use in this application.

    It is written as it is partitioned. What comes straight from a scan should be rebalanced where
    its rows are narrow, so that part files follow its size and not the row groups of the source.
    """
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _written:
        path = fresh_path(spark, name)
        store(build(), path)
        _written[key] = path
    return spark.read.parquet(_written[key])


def is_staged(spark: SparkSession, sf: str, name: str) -> bool:
    """The named table has been written in this application."""
    return (spark.sparkContext.applicationId, sf, name) in _written
