"""Benchmark passages in training documents, found by spaced seeds.

A mask names positions of a word window that count; the others may differ. Windows of benchmark
items and of documents are hashed under each mask and joined. The hits of one alignment are
verified together on all words that document and item share in it: some stretch must hold enough
matches at a high enough rate, and the longest one is reported whole.

The masks fit every stretch of 10 or more equal words at a rate of 0.75 or more somewhere (a test
goes through all of them). Items of fewer words count when the whole item stands in a document;
their masks are as long as they are.

The seeds of the benchmark, whose size is checked, are broadcast, so windows of documents are
neither written nor shuffled. Only hits are; the documents that have some are read a second time to
cut out the words of the alignments. Items of equal words are searched once and stand for each other
(`item_classes`).
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakscope.llm.common import broadcast_if_small, written

# Positions that count, as 1. The longest mask spans SPAN words.
MASKS = ("1010000111", "1101101", "110010011", "11110001")
SPAN = 10
MATCHES = 10
RATE = 0.75

# Seeds (24 bytes each) up to which the benchmark side is broadcast.
BROADCAST_SEEDS = 2_000_000


def word_hashes(text: Column) -> Column:
    """Hashes of the lower-cased words of a text; white space is blank and the controls 9 to 13."""
    words = F.split(F.trim(F.translate(F.lower(text), "\t\n\x0b\x0c\r", "     ")), " +")
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def _seed(mask: str, at: Column) -> Column:
    """Hash under a mask of the window that begins at `at` in the array `h`; null beyond its end."""
    words = [F.get(F.col("h"), at + i) for i, c in enumerate(mask) if c == "1"]
    return F.when(at + len(mask) <= F.size("h"), F.xxhash64(F.lit(int(mask, 2)), *words))


def _windows(df: DataFrame, masks: list[str], *keep: str) -> DataFrame:
    """The seeds of each window; null where a mask does not fit."""
    least, at = min(map(len, masks)), F.col("at")
    return (
        df.where(F.size("h") >= least)
        .select(*keep, "h", F.explode(F.sequence(F.lit(0), F.size("h") - least)).alias("at"))
        .select(*keep, "h", "at", F.explode(F.array(*[_seed(m, at) for m in masks])).alias("seed"))
    )


def _hashed(texts: DataFrame) -> DataFrame:
    """doc_id, doc_key (of id and words) and word hashes `h`."""
    return texts.select("doc_id", word_hashes(F.col("text")).alias("h")).select(
        "doc_id", F.xxhash64("doc_id", "h").alias("doc_key"), "h")


def _best_stretch(at: Column, matches: Column, rate: float) -> Column:
    """n_matches, -n_words and -start of the stretch with most equal words that meets both bounds.

    `at` holds the places of equal words in order; null if no stretch does. Such a stretch can be
    taken from the start of a run of equal words to the end of one. A start counts only if it has
    spent less on the words before it than every earlier start, an end only if it has gained more
    than every later one: others lie within a stretch with as many equal words that is as good.
    """
    every = F.sequence(F.lit(0), F.size(at) - 1)
    starts = F.filter(every, lambda a: F.coalesce(F.get(at, a - 1), F.lit(-2)) < F.get(at, a) - 1)
    ends = F.filter(every, lambda b: F.coalesce(
        F.get(at, b + 1), F.get(at, b) + 2) > F.get(at, b) + 1)

    def records(runs, spent):
        """The runs whose value is below that of all runs before them."""
        none = F.struct(F.lit(float("inf")).alias("least"),
                        F.array().cast("array<int>").alias("kept"))
        return F.aggregate(runs, none, lambda held, run: F.when(
            spent(run) < held["least"],
            F.struct(spent(run).alias("least"), F.array_append(held["kept"], run).alias("kept")),
        ).otherwise(held))["kept"]

    first = records(starts, lambda a: a - F.lit(rate) * F.get(at, a))
    final = records(F.reverse(ends), lambda b: F.lit(rate) * F.get(at, b) - b)

    def stretches(a):
        held = F.filter(final, lambda b: (b - a + 1 >= matches) & (
            b - a + 1 >= rate * (F.get(at, b) - F.get(at, a) + 1)))
        return F.transform(held, lambda b: F.struct(
            (b - a + 1).alias("n_matches"), (F.get(at, a) - F.get(at, b) - 1).alias("short"),
            (-F.get(at, a)).alias("early")))

    return F.array_max(F.flatten(F.transform(first, stretches)))


def _item_hashes(items: DataFrame) -> DataFrame:
    """item_id and word hashes of the items that have a passage: those of two words or more."""
    return items.select(
        F.col("item_id"), word_hashes(F.col("text").cast("string")).alias("h")
    ).where(F.size("h") >= 2)


def item_classes(items: DataFrame) -> DataFrame:
    """(item_id, of_item): each item with the one of equal words under which `leaks` finds it.

    Joined to the rows of `leaks` it gives every link of documents and items. Items of fewer than
    two words are in no class.
    """
    held = _item_hashes(items)
    least = held.groupBy(F.col("h").alias("g")).agg(F.min("item_id").alias("of_item"))
    return held.join(least, F.col("h") == F.col("g")).select("item_id", "of_item").distinct()


def leaks(docs: DataFrame, items: DataFrame, matches: int = MATCHES,
          rate: float = RATE) -> DataFrame:
    """doc_id, item_id, n_matches, n_words, start_word, n_items: passages of items in documents.

    One row for each document and item with a stretch of at least `matches` equal words that make
    up at least `rate` of the stretch, on one alignment; the stretch with most equal words counts,
    however long it is. An item of fewer than `matches` words needs all of them. Lower bounds than
    the defaults find only passages that the masks fit. Items of equal words are one, under the
    smallest item_id; n_items says how many there are and `item_classes` which. Documents without
    a leak have no row.

    A single word is no passage: documents and items of one word, null or empty texts give no row. Null ids are kept and compared as equal; documents that share a doc_id share their rows.
    Repeated rows and other columns change nothing.
    """
    held = written(
        _item_hashes(items).groupBy("h").agg(
            F.min("item_id").alias("item_id"), F.count("*").alias("n_items"))
        .select("item_id", "n_items", "h", F.xxhash64("item_id", "h").alias("item_key")), "items")
    # Items too short for the masks, by length: the whole item is the seed.
    lengths = [r["n"] for r in held.where(F.size("h") < SPAN).select(
        F.size("h").alias("n")).distinct().collect()]
    whole = ["1" * n for n in sorted(lengths)]

    def item_seeds(of: DataFrame, masks: list[str]) -> DataFrame:
        return _windows(of, masks, "item_key").where("seed is not null").select(
            "seed", "item_key", "at")

    windows = item_seeds(held.where(F.size("h") >= SPAN), list(MASKS))
    for mask in whole:
        windows = windows.unionByName(item_seeds(held.where(F.size("h") == len(mask)), [mask]))
    seeds = written(windows.select("seed", "item_key", F.col("at").alias("item_at")), "seeds")
    texts = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))
    # All hits of one alignment are one.
    hits = written(
        _windows(_hashed(texts), [*MASKS, *whole], "doc_id", "doc_key")
        .join(broadcast_if_small(seeds, BROADCAST_SEEDS), "seed")
        .select("doc_id", "doc_key", "item_key", (F.col("at") - F.col("item_at")).alias("shift"))
        .distinct(), "hits")
    leaked = hits.select(F.col("doc_id").alias("hit_id")).distinct()
    read_again = _hashed(texts.join(
        broadcast_if_small(leaked), F.col("doc_id").eqNullSafe(F.col("hit_id")), "leftsemi"))
    low = F.greatest(F.lit(0), -F.col("shift"))
    words = F.least(F.size("h") - F.col("shift"), F.size("g")) - low
    # Written, so that only the words of alignments are carried on, not whole documents.
    aligned = written(
        read_again.drop("doc_id").join(hits, "doc_key")
        .join(held.select("item_id", "n_items", "item_key", F.col("h").alias("g")), "item_key")
        .select(
            "doc_id", "item_id", "n_items", (low + F.col("shift")).alias("from"),
            F.least(F.lit(matches), F.size("g")).alias("needed"),
            F.slice("h", low + F.col("shift") + 1, words).alias("x"),
            F.slice("g", low + 1, words).alias("y")),
        "aligned")
    equal = F.array_compact(F.transform(
        F.zip_with("x", "y", lambda a, b: a == b), lambda same, i: F.when(same, i)))
    best = aligned.withColumn("equal", equal).where(F.size("equal") >= F.col("needed")).select(
        "doc_id", "item_id", "n_items", "from",
        _best_stretch(F.col("equal"), F.col("needed"), rate).alias("s"))
    return best.groupBy("doc_id", "item_id").agg(
        F.max(F.when(F.col("s").isNotNull(), F.struct(
            F.col("s.n_matches").alias("n_matches"), F.col("s.short").alias("short"),
            (F.col("s.early") - F.col("from")).alias("early")))).alias("b"),
        F.max(F.when(F.col("s").isNotNull(), F.col("n_items"))).alias("n_items"),
    ).where("b is not null").select(
        "doc_id", "item_id", F.col("b.n_matches").alias("n_matches"),
        (-F.col("b.short")).alias("n_words"), (-F.col("b.early")).alias("start_word"), "n_items")
