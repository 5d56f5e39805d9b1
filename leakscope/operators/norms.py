"""Group click rates against the pooled rate of a wider group."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakscope.functions.ratios import ctr, ratio, total


def sums(*names: str) -> list[Column]:
    return [total(n) for n in names]


def pooled_ctr(fact: DataFrame, key: str, name: str) -> DataFrame:
    """Pooled click rate per key, straight from the fact: two measures and one key are read."""
    pooled = fact.filter(F.col(key).isNotNull()).groupBy(key)
    return pooled.agg(ctr(F.sum("clicks"), F.sum("impressions")).alias(name))


def with_norm(groups: DataFrame, fact: DataFrame, key: str, name: str) -> DataFrame:
    """Add the pooled rate of the group's key and how many times above it the group is.

    No broadcast is forced: the norms are a few rows in practice, which adaptive execution
    measures and then broadcasts; a key column polluted with many values still joins by shuffle,
    with skewed partitions split.
    """
    joined = groups.join(pooled_ctr(fact, key, name), key, "left")
    return joined.withColumn("x_over_norm", ratio("ctr", name))


def one_row_total(df: DataFrame, **aggregates: Column) -> Column:
    """Totals of a frame as one struct-valued scalar subquery: no cross join, no driver loop."""
    return df.agg(F.struct(*[c.alias(n) for n, c in aggregates.items()])).scalar()
