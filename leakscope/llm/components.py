"""Connected components of a link table, without collecting links or components anywhere."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakscope.llm.common import written


def _state(edges: DataFrame) -> tuple:
    """Count and order-free fingerprint of a link table."""
    row = edges.agg(
        F.count("*").alias("n"),
        F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"),
    ).first()
    return row["n"], row["h"]


def _large_star(edges: DataFrame) -> DataFrame:
    """Links each larger neighbour of a node to the smallest node around it."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (
        both.join(least, "u").where("v > u and v != m").select(F.col("v").alias("u"),
                                                               F.col("m").alias("v")).distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a node's smaller neighbours and itself to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v != m").select(F.col("v").alias("u"),
                                                         F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component): the smallest node reachable, for each node that has a link.

    `edges` holds two long columns u and v; loops, repeated links and null ends are ignored.
    Alternates large-star and small-star steps until the links no longer change, at which point
    each node is linked to its component's smallest node. Each step is one aggregate and one join
    over a table that never holds more than one row for each link; a node with very many links is
    one key of a partial `min` and of a join whose skewed partitions Spark splits.
    """
    links = written(
        edges.where("u is not null and v is not null and u != v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    before = _state(links)
    while before[0]:
        links = written(_small_star(_large_star(links)), name)
        after = _state(links)
        if after == before:
            break
        before = after
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
