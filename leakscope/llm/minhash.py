"""Near-duplicate documents: one-permutation hashing, banded buckets, star-shaped links.

Each document's set of distinct word shingles is hashed once; the hash range is cut into bins and
a bin keeps its smallest hash (one-permutation hashing). An empty bin takes the value of the first
non-empty bin in a fixed random order of its own (optimal densification), so that two documents
agree in a bin with the probability of their similarity, whatever their sizes. Bands of bins form
buckets. Within a bucket each document is paired with the bucket's centre only, never with all
others, and each pair is confirmed on the full sets.

Links between two documents of a bucket that are both unlike its centre are found afterwards, in
those buckets whose documents are not yet all in one component. They are cut into blocks of bounded
size that tasks compare two by two on the full sets; only links between components leave a
comparison, at most one for each component in it, never the pairs. So each pair that shares a
bucket is either in one component or has been compared.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakscope.llm.common import broadcast_if_small, mapped, written
from leakscope.llm.components import components
from leakscope.llm.words import mix, shingle_sets

SHINGLE = 5
PERCENT = 75
BANDS, ROWS = 48, 5

# Documents of a block; the documents of two blocks are compared in one task.
BLOCK = 128

# Bytes of text hashed at once in a task.
CHUNK = 2 << 20


def _probe_order(bins: int) -> np.ndarray:
    """rank[i, j]: when empty bin i would look into bin j."""
    grid = np.arange(bins * bins, dtype=np.uint64).reshape(bins, bins)
    return mix(grid + np.uint64(0x51ED270B)).argsort(axis=1).argsort(axis=1).astype(np.int32)


def band_hashes(shingles: np.ndarray, bands: int, rows: int, order: np.ndarray) -> np.ndarray:
    """One bucket key for each band of a sorted, non-empty shingle set."""
    bins = bands * rows
    where = ((shingles >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
    first = np.flatnonzero(np.diff(where.astype(np.int64), prepend=-1))
    filled = where[first].astype(np.int64)
    sketch = np.zeros(bins, np.uint64)
    sketch[filled] = shingles[first]
    if len(filled) < bins:
        empty = np.setdiff1d(np.arange(bins), filled, assume_unique=True)
        sketch[empty] = shingles[first][order[np.ix_(empty, filled)].argmin(axis=1)]
        # of which bin the value is must not matter, only the value
    sketch = sketch.reshape(bands, rows)
    key = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for i in range(rows):
        key = mix(key ^ sketch[:, i]) * np.uint64(0x2545F4914F6CDD1D)
    return mix(key)


def _chunks(ids: list, texts: list):
    """Parts of a batch with a bounded number of bytes each; a long text is a part of its own."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= CHUNK:
            yield ids[at : i + 1], texts[at : i + 1]
            at, size = i + 1, 0
    if at < len(texts):
        yield ids[at:], texts[at:]


def _parts(batches):
    """(ids, texts as UTF-8) of Arrow batches with columns doc_id and text."""
    for batch in batches:
        texts = batch.column(1).cast(pa.large_binary()).to_pylist()
        yield from _chunks(batch.column(0).to_pylist(), [t or b"" for t in texts])


def _ragged(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0] + [len(a) for a in arrays]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))


def _signer(words: int, bands: int, rows: int):
    def run(batches):
        order = _probe_order(bands * rows)
        none = np.zeros(0, np.uint64)
        for ids, texts in _parts(batches):
            sets = shingle_sets(texts, words)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets],
                             pa.binary()),
                    _ragged([band_hashes(s, bands, rows, order) if len(s) else none for s in sets]),
                ],
                names=["doc_id", "n_shingles", "set_key", "bands"],
            )

    return run


def _setter(words: int):
    def run(batches):
        for ids, texts in _parts(batches):
            sets = shingle_sets(texts, words)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), _ragged(sets)],
                                             names=["id", "shingles"])

    return run


def signatures(docs: DataFrame, words: int = SHINGLE, bands: int = BANDS,
               rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, set_key (equal for equal sets), bands (bucket keys; none if empty)."""
    return mapped(
        docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")),
        _signer(words, bands, rows),
        "doc_id long, n_shingles long, set_key binary, bands array<long>")


def _sized(n, m, percent):
    """Whether sets of these sizes can reach the similarity."""
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (lo, hi) whose full sets reach the similarity."""
    a = sets.select(F.col("id").alias("lo"), F.col("shingles").alias("x"))
    b = sets.select(F.col("id").alias("hi"), F.col("shingles").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return pairs.join(a, "lo").join(b, "hi").where(
        100 * both >= percent * (F.size("x") + F.size("y") - both)).select("lo", "hi")


def _to_centres(members: DataFrame, centres: tuple, percent: int):
    """Pairs (lo, hi) of each bucket's documents and its centres, where sizes fit."""
    pairs = []
    for c in centres:
        other = F.col(f"{c}.id")
        fits = (F.col("id") != other) & _sized(F.col("n"), F.col(f"{c}.n"), percent)
        pairs.append(members.where(fits).select(
            F.least("id", other).alias("lo"), F.greatest("id", other).alias("hi")))
    return pairs[0].union(pairs[1])


def _open(members: DataFrame, found: DataFrame) -> DataFrame:
    """The documents of buckets that hold more than one component, with their component `label`."""
    labelled = members.join(found, F.col("id") == F.col("node"), "left").select(
        "key", "id", F.coalesce("component", "id").alias("label"))
    keys = labelled.groupBy("key").agg(
        F.min("label").alias("least"), F.max("label").alias("most")
    ).where("least != most").select("key")
    return labelled.join(broadcast_if_small(keys), "key", "leftsemi")


def _dealt(opened: DataFrame, block: int) -> DataFrame:
    """Each open document in the pairs of blocks (bi, bj) in which it has to be compared.

    The documents of a bucket's largest component need no comparison with each other: they are in
    blocks of their own, behind those of the other documents, and meet only the latter.
    """
    labels = opened.groupBy("key", "label").agg(F.count("*").alias("c"))
    buckets = labels.groupBy("key").agg(
        F.max(F.struct("c", "label")).alias("top"), F.sum("c").alias("all")
    ).select(
        "key", F.col("top.label").alias("main"),
        F.ceil((F.col("all") - F.col("top.c")) / block).alias("others"),
        F.ceil(F.col("top.c") / block).alias("mains"))
    main = F.col("label") == F.col("main")
    place = F.xxhash64("id")
    return (
        opened.join(buckets, "key")
        .withColumn("block", F.when(main, F.col("others") + F.pmod(place, F.col("mains")))
                    .otherwise(F.pmod(place, F.col("others"))))
        .withColumn("other", F.explode(F.sequence(
            F.lit(0).cast("long"),
            F.when(main, F.col("others")).otherwise(F.col("others") + F.col("mains")) - 1)))
        .select("key", "id", "label", "block", F.least("block", "other").alias("bi"),
                F.greatest("block", "other").alias("bj"))
    )


def _joined_labels(rows: list[tuple], percent: int) -> list[tuple[int, int]]:
    """Components that links between two blocks join: rows are (block, label, shingles).

    The first block's documents are compared in turn with all of the second, or with those behind
    them in their own.
    """
    first = [r for r in rows if r[0] == rows[0][0]]
    second = rows[len(first) :] or first
    number = np.unique(np.concatenate([r[2] for r in second]), return_inverse=True)
    known, flat = number[0], number[1].reshape(-1)
    sizes = np.array([len(r[2]) for r in second])
    starts = np.cumsum(sizes) - sizes
    labels = np.array([r[1] for r in second])
    root: dict[int, int] = {}

    def find(x):
        while root.get(x, x) != x:
            x = root[x]
        return x

    out = []
    for i, (_, label, own) in enumerate(first):
        at = np.searchsorted(known, own)
        at[at == len(known)] = 0
        held = np.zeros(len(known), np.int64)
        held[at[known[at] == own]] = 1
        both = np.add.reduceat(held[flat], starts)
        linked = 100 * both >= percent * (len(own) + sizes - both)
        linked &= labels != label
        if second is first:
            linked[: i + 1] = False
        for other in np.unique(labels[linked]).tolist():
            a, b = find(label), find(other)
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append((label, other))
    return out


def _joiner(percent: int):
    def run(batches):
        key, rows = None, []

        def done():
            found = _joined_labels(rows, percent) if len(rows) > 1 else []
            if found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, pa.int64()) for x in zip(*found)], names=["u", "v"])

        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in range(3))))
            blocks, labels = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            for n, k in enumerate(keys):
                if k != key:
                    yield from done()
                    key, rows = k, []
                shingles = batch.column(5)[n].values.to_numpy(zero_copy_only=False)
                rows.append((blocks[n], labels[n], shingles))
        yield from done()

    return run


def near_duplicates(docs: DataFrame, words: int = SHINGLE, percent: int = PERCENT,
                    bands: int = BANDS, rows: int = ROWS, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, set_key, component_id: one row for each row of `docs`.

    component_id is the smallest doc_id reachable by links, the document itself included; two
    documents are linked if 100 * intersection >= percent * union of their shingle sets. Equal
    sets are linked at once and only one of them takes part in the search, so a group of exact
    copies of any size costs one aggregate. With 48 bands of 5 a pair at the threshold shares no
    bucket with a probability of 2e-6.

    Null and empty texts have an empty set and are linked with nothing. A null doc_id is linked
    with nothing and its component_id is null. Rows that share a doc_id are one node: they are
    linked with whatever one of them is linked with. Columns besides doc_id and text are ignored.
    """
    signed = written(signatures(docs, words, bands, rows), "signatures")
    full = signed.where("n_shingles > 0 and doc_id is not null")
    classes = full.groupBy("set_key").agg(F.min("doc_id").alias("rep"))
    singles = written(
        full.join(classes.withColumnRenamed("rep", "doc_id"), ["set_key", "doc_id"])
        .select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "bands"), "singles")
    buckets = singles.select(F.explode("bands").alias("key"), "id", "n")
    # Only buckets with two documents or more matter from here on.
    several = written(
        buckets.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key"), "keys")
    members = written(buckets.join(broadcast_if_small(several), "key"), "members")
    node = F.struct("id", "n")
    ends = members.groupBy("key").agg(F.min(node).alias("a"), F.max(node).alias("z"))
    tried = written(
        _to_centres(members.join(ends, "key"), ("a", "z"), percent).distinct(), "pairs")
    ids = written(members.select("id").distinct(), "ids")
    wanted = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(
        broadcast_if_small(ids.withColumnRenamed("id", "doc_id")), "doc_id", "leftsemi")
    sets = written(mapped(wanted, _setter(words), "id long, shingles array<long>"), "sets")
    edges = written(_confirmed(tried, sets, percent), "edges")
    found = written(components(edges.toDF("u", "v")), "found")
    opened = written(_open(members, found), "open")
    more = written(mapped(
        _dealt(opened, block).join(sets, "id")
        .select("key", "bi", "bj", "block", "label", "shingles")
        .repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj", "block"),
        _joiner(percent), "u long, v long"), "joined")
    found = components(edges.toDF("u", "v").union(more))
    grouped = classes.join(found, F.col("rep") == F.col("node"), "left").select(
        F.col("set_key").alias("k"), F.coalesce("component", "rep").alias("of_set"))
    per_row = signed.join(
        grouped, (F.col("set_key") == F.col("k")) & (F.col("n_shingles") > 0), "left")
    return per_row.select(
        "doc_id", "n_shingles", "set_key",
        F.when(F.col("doc_id").isNull(), F.lit(None))
        .otherwise(F.coalesce("of_set", "doc_id")).cast("long").alias("component_id"))
