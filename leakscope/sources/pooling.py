"""Pooling of rolling exports: of every restated row the newest version counts."""

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MEASURES = {
    "Impressions", "Clicks", "Post Click Conversions", "Post View Conversions",
    "Billable Spend", "CTR", "CPM", "Total Spend",
    "25% Completed", "50% Completed", "75% Completed", "100% Completed",
}
# Verbatim texts that may be restated with a row, so they do not identify it.
RESTATED_TEXT = {"Clickthrough URL", "Preview Image URL"}


def newest_rows(df: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    """Newest row per key, by the version columns and then by the row's own values.

    The first row of a window per key: Spark keeps one candidate per key in every map task before
    the shuffle, so a key with a huge number of restatements never reaches one task as a whole, and
    a row's columns are carried once. Null keys form their own groups and survive.
    """
    ties = [c for c in df.columns if c not in keys and c not in version]
    newest = Window.partitionBy(*[F.col(f"`{k}`") for k in keys]).orderBy(
        *[F.col(f"`{c}`").desc() for c in [*version, *ties]])
    ranked = df.withColumn("_place", F.row_number().over(newest))
    return ranked.filter("_place = 1").drop("_place")


def pool_exports(
    frames: list[DataFrame], version: list[str], keys: list[str] | None = None
) -> DataFrame:
    """Union exports and keep the newest version of each dimension combination.

    Each frame carries the version columns (file date, then modification time). Keys default to
    every column that is neither a measure, a restated text nor part of the version.
    """
    df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    if keys is None:
        out = MEASURES | RESTATED_TEXT | set(version)
        keys = [c for c in df.columns if c not in out]
    return newest_rows(df, keys, version)
