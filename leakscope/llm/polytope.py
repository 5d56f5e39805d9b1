"""Near-duplicate embeddings: cross-polytope hashing after fast Hadamard rotations.

A vector's hash under a random rotation is the axis it lies nearest to, with its sign. The
rotation is three rounds of random signs and a fast Walsh-Hadamard transform. Several hashes make
a bucket code, several codes (tables) a vector's buckets; multiprobe also looks into the buckets
of the second-nearest axes. Candidates of a bucket are compared by cosine in double precision.

Equal vectors are one class and are searched once. A large bucket is cut into blocks of bounded
size that are compared two by two as matrix products, and only per-vector link counts and one
component link for each vector leave a comparison, never the pairs. A pair that meets in several
buckets counts in the first of them.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakscope.llm.common import mapped, written
from leakscope.llm.components import components

TABLES, HASHES = 20, 3
SEED = 20240101
BLOCK = 512
# Buckets of up to so many vectors are compared together, up to so many pairs at a time.
SMALL = 32
PAIRS = 1 << 15


def _hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row, scaled to keep lengths."""
    n, d = x.shape
    step = 1
    while step < d:
        x = x.reshape(n, d // (2 * step), 2, step)
        x = np.stack((x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]), axis=2)
        step *= 2
    return x.reshape(n, d) / np.sqrt(d)


def codes(vectors: np.ndarray, tables: int = TABLES, hashes: int = HASHES,
          seed: int = SEED) -> np.ndarray:
    """[vector, table, probe] bucket codes of unit vectors: probe 0 is the own bucket.

    Probe 1+i replaces the i-th hash by its second-nearest axis.
    """
    n, d = vectors.shape
    wide = 1 << max(1, (d - 1).bit_length())
    padded = np.zeros((n, wide))
    padded[:, :d] = vectors
    rng = np.random.default_rng(seed)
    out = np.zeros((n, tables, 1 + hashes), np.int64)
    at = np.arange(n)
    for t in range(tables):
        nearest = np.zeros((hashes, 2, n), np.int64)
        for h in range(hashes):
            x = padded
            for _ in range(3):
                x = _hadamard(x * rng.choice([-1.0, 1.0], wide))
            size = np.abs(x)
            for rank in range(2):
                axis = size.argmax(axis=1)
                nearest[h, rank] = 2 * axis + (x[at, axis] < 0)
                size[at, axis] = -1
        for probe in range(1 + hashes):
            code = np.zeros(n, np.int64)
            for h in range(hashes):
                code = code * (2 * wide) + nearest[h, int(probe == h + 1)]
            out[:, t, probe] = code
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    """Equally long lists of numbers as a matrix of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def units(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; by the largest component first, so that no square overflows."""
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _ragged(matrix: np.ndarray) -> pa.Array:
    n, width = matrix.shape
    return pa.ListArray.from_arrays(
        pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(matrix.reshape(-1)))


def _by_length(lists: pa.Array):
    lengths = np.asarray(pc.list_value_length(lists))
    for d in np.unique(lengths):
        yield np.flatnonzero(lengths == d)


def _hasher(tables: int, hashes: int):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            for rows in _by_length(batch.column(1)):
                part = batch.take(pa.array(rows))
                unit = units(_matrix(part.column(1)))
                code = codes(unit, tables, hashes)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), _ragged(code.reshape(len(rows), -1)), _ragged(unit)],
                    names=["id", "codes", "unit"])

    return run


def _first_meeting(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Table and code of the first bucket in which two vectors meet, by their codes.

    They meet where the own bucket of one is a bucket looked into for the other.
    """
    n, tables, probes = a.shape
    table = np.full(n, tables)
    code = np.zeros(n, np.int64)
    for t in reversed(range(tables)):
        for i, j in [(0, 0), *((0, p) for p in range(1, probes)), *((p, 0) for p in range(1, probes))]:
            same = a[:, t, i] == b[:, t, j]
            smaller = same & ((table != t) | (a[:, t, i] < code))
            table[smaller], code[smaller] = t, a[smaller, t, i]
    return table, code


def _linked(table, code, left, right, cosine):
    """Pairs (i, j) of a comparison that reach the cosine and have their first meeting here."""
    x, y = left["unit"], left["unit"] if right is None else right["unit"]
    other = left if right is None else right
    i, j = np.nonzero(x @ y.T >= cosine)
    if right is None:
        keep = i < j
        i, j = i[keep], j[keep]
    if len(i):
        t, c = _first_meeting(left["codes"][i], other["codes"][j])
        keep = (t == table) & (c == code)
        i, j = i[keep], j[keep]
    return i, j


def _small_pairs(starts: np.ndarray, sizes: np.ndarray):
    """All pairs (i, j), i < j, of rows of small groups, for many groups of one size at a time."""
    for size in np.unique(sizes):
        first = starts[sizes == size]
        i, j = np.triu_indices(size, 1)
        step = max(1, PAIRS // len(i))
        for a in range(0, len(first), step):
            part = first[a : a + step, None]
            yield (part + i).ravel(), (part + j).ravel()


def _compared_together(held: dict, starts: np.ndarray, sizes: np.ndarray, cosine: float):
    """(ids, links, root) of the links within many small groups: two rows for each link.

    A row gives a vector, the copies of the other one, and the smaller of both ids.
    """
    rows = np.concatenate([np.arange(a, a + n) for a, n in zip(starts, sizes)])
    dims = np.array([len(u) for u in held["unit"][rows]])
    for dim in np.unique(dims):
        of = rows[dims == dim]
        place = np.zeros(len(held["id"]), np.int64)
        place[of] = np.arange(len(of))
        unit = np.stack(held["unit"][of])
        mine = np.array([len(held["unit"][a]) == dim for a in starts])
        for i, j in _small_pairs(starts[mine], sizes[mine]):
            near = np.einsum("ij,ij->i", unit[place[i]], unit[place[j]]) >= cosine
            i, j = i[near], j[near]
            if not len(i):
                continue
            t, c = _first_meeting(held["codes"][i], held["codes"][j])
            keep = (t == held["table"][i]) & (c == held["code"][i])
            i, j = i[keep], j[keep]
            a, b, copies = held["id"][i], held["id"][j], held["copies"]
            least = np.minimum(a, b)
            yield (np.concatenate([a, b]), np.concatenate([copies[j], copies[i]]).astype(float),
                   np.concatenate([least, least]))


def _comparer(cosine: float, tables: int, hashes: int):
    def compare(rows):
        """(ids, links, root) of one comparison: rows of a bucket's block or pair of blocks."""
        table, code, bi, bj = (rows[c][0] for c in ("table", "code", "bi", "bj"))
        part = [{k: v[rows["block"] == b] for k, v in rows.items()} for b in {bi: 0, bj: 0}]
        left, right = part[0], part[1] if len(part) > 1 else None
        if not len(left["id"]) or right is not None and not len(right["id"]):
            return None
        i, j = _linked(table, code, left, right, cosine)
        if not len(i):
            return None
        ids = left["id"] if right is None else np.concatenate([left["id"], right["id"]])
        copies = left["copies"] if right is None else np.concatenate(
            [left["copies"], right["copies"]])
        if right is not None:
            j = j + len(left["id"])
        links = np.bincount(i, copies[j], len(ids)) + np.bincount(j, copies[i], len(ids))
        root = ids.copy()
        while True:  # the smallest id along the links within the comparison
            before = root.copy()
            np.minimum.at(root, i, root[j])
            np.minimum.at(root, j, root[i])
            if (before == root).all():
                break
        met = links > 0
        return ids[met], links[met], root[met]

    def run(batches):
        width = tables * (1 + hashes)
        held = None
        for batch in _with_end(batches):
            if batch is not None and batch.num_rows:
                own = {c: batch.column(n).to_numpy(zero_copy_only=False) for n, c in
                       enumerate(("bucket", "bi", "bj", "table", "code", "block", "id",
                                  "copies"))}
                flat = batch.column(8).flatten().to_numpy(zero_copy_only=False)
                ends = np.cumsum(np.asarray(pc.list_value_length(batch.column(8))))
                own["unit"] = np.empty(batch.num_rows, object)
                own["unit"][:] = [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]
                flat = batch.column(9).flatten().to_numpy(zero_copy_only=False)
                own["codes"] = flat.reshape(-1, tables, 1 + hashes)
                assert flat.size == batch.num_rows * width
                held = own if held is None else {
                    k: np.concatenate([held[k], own[k]]) for k in own}
            if held is None or not len(held["id"]):
                continue
            key = np.stack([held[c] for c in ("bucket", "bi", "bj")])
            cuts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
            ends = np.array([*cuts.tolist()] + ([len(held["id"])] if batch is None else []), int)
            if not len(ends):
                continue
            starts = np.concatenate([[0], ends[:-1]])
            sizes = ends - starts
            small = (sizes > 1) & (sizes <= SMALL) & (held["bi"][starts] == held["bj"][starts])
            found = list(_compared_together(
                held, starts[small], sizes[small], cosine)) if small.any() else []
            for a, b in zip(starts[(sizes > 1) & ~small], ends[(sizes > 1) & ~small]):
                rows = {k: v[a:b] for k, v in held.items()}
                rows["unit"] = np.stack(rows["unit"])
                if (got := compare(rows)) is not None:
                    found.append(got)
            held = {k: v[ends[-1] :] for k, v in held.items()}
            if found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(c)) for c in zip(*found)],
                    names=["id", "links", "root"])

    return run


def _with_end(batches):
    yield from batches
    yield None


def _usable() -> Column:
    v = F.col("embedding")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return (v.isNotNull() & F.coalesce(finite, F.lit(False))
            & F.exists(v, lambda x: x != 0.0) & F.col("label").isNotNull())


def near_vectors(vectors: DataFrame, cosine: float, tables: int = TABLES, hashes: int = HASHES,
                 block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id for each row of `vectors` (vec_id, embedding, label).

    Two vectors are linked if their labels, of any type, are equal and not null, their lengths are
    equal and their cosine is at least `cosine`, whatever their scales; n_links counts other vectors, component_id is the smallest
    vec_id reachable. A null, empty or zero vector, one with null or non-finite components, and
    one without label or vec_id has no links and is its own component. Rows that repeat a vec_id
    are vectors of their own. Other columns are ignored.
    """
    every = vectors.select(
        F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("embedding"),
        "label")
    usable = every.where(_usable() & F.col("vec_id").isNotNull()).select(
        "vec_id", "label", "embedding", F.size("embedding").alias("dim"))
    classes = written(
        usable.groupBy("label", "embedding").agg(
            F.min("vec_id").alias("rep"), F.count("*").alias("copies"),
            F.first("dim").alias("dim")).withColumn("id", F.monotonically_increasing_id()),
        "vector-classes")
    hashed = written(
        mapped(classes.select("id", "embedding"), _hasher(tables, hashes),
               "id long, codes array<long>, unit array<double>"), "codes")
    probes = 1 + hashes
    looked = (
        hashed.select("id", "codes").join(classes.select("id", "label", "dim"), "id")
        .select("id", "label", "dim", F.posexplode("codes").alias("p", "code"))
        .select("id", "label", "dim", F.expr(f"p div {probes}").alias("table"), "code",
                (F.col("p") % probes == 0).alias("own"))
    )
    key = ["table", "code", "dim", "label"]
    full = written(looked.groupBy(*key).agg(
        F.count("*").alias("n"), F.count_if("own").alias("owners")
    ).where("n > 1 and owners > 0").select(
        *key, "n", F.monotonically_increasing_id().alias("bucket")), "buckets")
    blocks = F.ceil(F.col("n") / block).cast("long")
    mine = F.pmod(F.xxhash64("id"), F.col("blocks"))
    placed = (
        looked.join(full, key).select("bucket", "table", "code", "id", blocks.alias("blocks"))
        .withColumn("block", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .select("bucket", "table", "code", F.least("block", "other").alias("bi"),
                F.greatest("block", "other").alias("bj"), "block", "id")
    )
    payload = classes.select("id", "copies").join(hashed, "id")
    order = ["bucket", "bi", "bj"]
    dealt = (
        placed.join(payload, "id")
        .select(*order, F.col("table").cast("long").alias("table"), "code", "block", "id",
                "copies", "unit", "codes")
        .repartition(*order).sortWithinPartitions(*order, "block", "id")
    )
    compared = written(
        mapped(dealt, _comparer(cosine, tables, hashes), "id long, links double, root long"),
        "compared")
    links = compared.groupBy("id").agg(F.sum("links").cast("long").alias("links"))
    grouped = components(compared.select(F.col("id").alias("u"), F.col("root").alias("v")),
                         "vector-links")
    together = classes.select("id", "rep", "label", "embedding", "copies").join(
        grouped.withColumnRenamed("node", "id"), "id", "left").withColumn(
        "component", F.coalesce("component", "id"))
    least = together.groupBy("component").agg(F.min("rep").alias("c"))
    known = together.join(least, "component").join(links, "id", "left").select(
        F.col("label").alias("class_label"), F.col("embedding").alias("class_vector"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n"), "c")
    tagged = every.withColumn("usable", _usable() & F.col("vec_id").isNotNull())
    return tagged.join(
        known, F.col("usable") & (F.col("label") == F.col("class_label"))
        & (F.col("embedding") == F.col("class_vector")), "left"
    ).select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
             F.coalesce("c", "vec_id").alias("component_id"))
