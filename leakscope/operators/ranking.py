"""Exact places of rows in a total order, without one task that sees a whole group."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leakscope.lineage import written


def placed(df: DataFrame, groups: list[str], order: list[Column]) -> DataFrame:
    """Rows sorted by group and order over all tasks, with `_part` and their place `_at` in it.

    Ranges are cut by sampling the whole order, so rows that agree in its first columns still
    spread over tasks. The table is written, because the next run of the plan could cut the
    ranges elsewhere.
    """
    by = [*[F.col(g) for g in groups], *order]
    return written(
        df.repartitionByRange(*by).sortWithinPartitions(*by).select(
            "*", F.spark_partition_id().alias("_part"),
            F.monotonically_increasing_id().alias("_at")), "placed")


def numbered(df: DataFrame, groups: list[str], order: list[Column], name: str) -> DataFrame:
    """Add each row's place (from 0) in the order of its group as the column `name`.

    Only the counts of the ranges, one row for each range and group, are summed up in order.
    Null groups count as one group.
    """
    rows = placed(df, groups, order)
    ranges = rows.groupBy(*groups, "_part").agg(
        F.min("_at").alias("_first"), F.count("*").alias("_n"))
    above = Window.partitionBy(*groups).orderBy("_part").rowsBetween(
        Window.unboundedPreceding, -1)
    shifts = ranges.select(
        *[F.col(g).alias(f"_g_{g}") for g in groups], F.col("_part").alias("_of"),
        (F.coalesce(F.sum("_n").over(above), F.lit(0)) - F.col("_first")).alias("_shift"))
    same = [F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in groups]
    joined = rows.join(shifts, reduce(lambda a, b: a & b, [*same, F.col("_part") == F.col("_of")]))
    return joined.select(*df.columns, (F.col("_at") + F.col("_shift")).alias(name))
