"""Uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

How many rows go from each input partition to each shard in a uniformly random permutation is a
matrix of hypergeometric counts. It is drawn first, from the partitions' row counts alone. Each
partition is then permuted and dealt out by its row of the matrix, and each shard is permuted
again: every order of all rows is equally likely, and shard sizes are exact.

The permutations are ranks by random keys. A rank is counted within ranges of the key and the
ranges' counts are summed up before it, so no task ever holds a whole partition or shard.
"""

import json
import math
import random
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leakscope.llm.common import written

# Rows that one range of random keys holds on average.
RANGE_ROWS = 100_000
# Input partitions are joined to so many blocks at most; the matrix has blocks x shards cells.
BLOCKS = 512


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """How many good ones are among `draws` drawn without replacement.

    Inversion from the mode outwards, so a draw takes about as many steps as the standard
    deviation, at any size.
    """
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    total = good + bad
    mode = min(high, max(low, (draws + 1) * (good + 1) // (total + 2)))

    def log_choose(n, k):
        return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)

    p = math.exp(log_choose(good, mode) + log_choose(bad, draws - mode) - log_choose(total, draws))
    u = rng.random() - p
    down, up, p_down, p_up = mode, mode, p, p
    while u > 0 and (down > low or up < high):
        if up < high:
            p_up *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up += 1
            u -= p_up
            if u <= 0:
                return up
        if down > low:
            p_down *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
            down -= 1
            u -= p_down
            if u <= 0:
                return down
    return mode


def matrix(counts: list[int], sizes: list[int], seed: int) -> list[list[int]]:
    """Rows from each partition to each shard; row sums are `counts`, column sums `sizes`."""
    rng, open_, out = random.Random(seed), list(sizes), []
    for n in counts:
        row, left, rest = [], n, sum(open_)
        for room in open_:
            k = hypergeometric(rng, room, rest - room, left)
            row.append(k)
            left, rest = left - k, rest - room
        open_ = [room - k for room, k in zip(open_, row)]
        out.append(row)
    return out


def even_sizes(rows: int, shards: int) -> list[int]:
    return [rows // shards + (i < rows % shards) for i in range(shards)]


def _ranked(df: DataFrame, group: str, key: str, ranges: int) -> DataFrame:
    """`df` with `rank`: the row's place in its group by the random key, from 0.

    The key is uniform over 64 bits, so its ranges hold nearly equal numbers of rows.
    """
    part = F.shiftrightunsigned(F.col(key), 33) * F.lit(ranges)  # of the upper 31 bits
    df = df.withColumn("range", F.shiftright(part, 31).cast("int"))
    before = Window.partitionBy(group).orderBy("range").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = df.groupBy(group, "range").count().select(
        F.col(group).alias("g"), F.col("range").alias("r"),
        F.coalesce(F.sum("count").over(before), F.lit(0)).alias("below"))
    within = Window.partitionBy(group, "range").orderBy(key, "row")
    return df.withColumn("place", F.row_number().over(within) - 1).join(
        offsets, (F.col(group) == F.col("g")) & (F.col("range") == F.col("r"))
    ).withColumn("rank", F.col("below") + F.col("place")).drop("g", "r", "below", "place", "range")


def _random(salt: int, seed: int) -> Column:
    return F.xxhash64(F.col("row"), F.lit(salt), F.lit(seed))


def shuffle_into_shards(docs: DataFrame, shards: int, seed: int = 1) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for each row of `docs` (columns doc_id, text).

    size is the bytes of the text (null: none) plus 16, text_crc32 that of its bytes. Shards hold
    numbers of rows that differ by one at most; slots of a shard run from 0 without gaps. The order
    is a uniform draw, fixed by `seed` and the way the input lies in partitions. Equal texts are
    not kept together: a uniform order has no groups, and a group may be larger than a shard.

    Null ids and texts, repeated rows and very long texts are rows like others (only id, size and
    checksum take part). An empty table gives no rows; other columns are ignored.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = written(
        docs.select(
            "doc_id", (F.octet_length(text) + 16).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row")),
        "rows")
    counts = rows.groupBy((F.col("part") % BLOCKS).alias("block")).count().orderBy("block").collect()
    total = sum(r["count"] for r in counts)
    drawn = matrix([r["count"] for r in counts], even_sizes(total, shards), seed)
    # Where each shard's rows end among a block's permuted rows.
    ends = [[] for _ in range(BLOCKS)]
    for r, cells in zip(counts, drawn):
        ends[r["block"]] = list(accumulate(cells))
    cut = F.from_json(F.lit(json.dumps(ends)), "array<array<long>>")
    per_block = max([1, *(r["count"] for r in counts)])
    in_blocks = _ranked(
        rows.withColumns({"block": F.col("part") % BLOCKS, "key": _random(1, seed)}),
        "block", "key", -(-per_block // RANGE_ROWS))
    dealt = in_blocks.withColumn("ends", F.get(cut, F.col("block"))).withColumn(
        "shard", F.size(F.filter("ends", lambda e: e <= F.col("rank"))).cast("int"))
    exchanged = dealt.select("doc_id", "size", "text_crc32", "row", "shard",
                             _random(2, seed).alias("key"))
    ranges = -(-max(1, total // shards) // RANGE_ROWS)
    return _ranked(written(exchanged, "dealt"), "shard", "key", ranges).select(
        "doc_id", "size", "text_crc32", "shard", F.col("rank").cast("long").alias("slot"))
