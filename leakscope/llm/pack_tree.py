"""Best-fit packing as a tree: partitions pack on their own, underfull bins go on as items.

Each task tokenizes its documents, cuts longer ones into full pieces and packs the pieces of its
partition by best fit, longest first. Bins with little room left are final. The others are dealt
out anew as items of their filled length, to fewer and fewer tasks of a bounded number of items,
and packed again by the same rule, until one task holds all of them or nothing is gained.
"""

import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakscope.llm import tokens
from leakscope.llm.common import mapped, written

CAPACITY = 2048
# A bin with no more room than this is final.
SLACK = 8
# Pieces that a task packs together, and items of a later round.
BLOCK = 500_000
ITEMS = 200_000


def best_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each item, and how full each bin is; longest items first.

    An item goes where the least room is left that still suffices, else into a new bin. Rooms in
    use are the bits of an integer, bins of equal room a stack.
    """
    bins, offsets, used = [0] * len(lengths), [0] * len(lengths), []
    rooms: dict[int, list[int]] = {}
    open_rooms = 0
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[i]
        fits = open_rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                open_rooms ^= 1 << room
        else:
            room, b = capacity, len(used)
            used.append(0)
        bins[i], offsets[i] = b, used[b]
        used[b] += n
        left = room - n
        if left:
            rooms.setdefault(left, []).append(b)
            open_rooms |= 1 << left
    return bins, offsets, used


_PIECES = ("doc_id long, piece int, start long, length long, ids_crc32 long, "
           "bin long, at long, used long")


def _numbers(task: int):
    """Bin numbers that no other task of the round gives out."""
    n = task << 40
    while True:
        yield n
        n += 1


def _local(path: str, end_id: int, capacity: int, keep_ids: bool):
    def packed(rows, numbers):
        lengths = [r[3] for r in rows]
        bins, at, used = best_fit(lengths, capacity)
        names = [next(numbers) for _ in used]
        columns = list(zip(*rows))
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
        arrays += [pa.array([names[b] for b in bins], pa.int64()), pa.array(at, pa.int64()),
                   pa.array([used[b] for b in bins], pa.int64())]
        fields = ["doc_id", "piece", "start", "length", "ids_crc32", "bin", "at", "used"]
        if keep_ids:
            arrays.append(pa.array(columns[5], pa.binary()))
            fields.append("ids")
        return pa.RecordBatch.from_arrays(arrays, names=fields)

    def run(batches):
        units = tokens.units(path, False, "I")
        numbers = _numbers(TaskContext.get().partitionId())
        end = end_id.to_bytes(4, "little")
        rows = []
        for (ids,), texts in tokens.parts(batches):
            for doc, data in zip(ids, units.of(texts)):
                data += end
                for piece, a in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[a : a + 4 * capacity]
                    row = (doc, piece, a // 4, len(part) // 4, zlib.crc32(part))
                    rows.append(row + (part,) if keep_ids else row)
            if len(rows) >= BLOCK:
                yield packed(rows, numbers)
                rows = []
        if rows:
            yield packed(rows, numbers)

    return run


def _again(capacity: int, turn: int):
    def run(batches):
        numbers = _numbers((turn << 20) + TaskContext.get().partitionId())
        items, filled = [], []
        for b in batches:
            items += b.column(0).to_pylist()
            filled += b.column(1).to_pylist()
        if items:
            bins, at, used = best_fit(filled, capacity)
            names = [next(numbers) for _ in used]
            yield pa.RecordBatch.from_arrays(
                [pa.array(items, pa.int64()), pa.array([names[b] for b in bins], pa.int64()),
                 pa.array(at, pa.int64()), pa.array([used[b] for b in bins], pa.int64())],
                names=["bin", "into", "shift", "filled"])

    return run


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0,
         slack: int = SLACK, items: int = ITEMS, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece of a document.

    A document is its token ids followed by `end_id`. One that is longer than `capacity` is cut
    into pieces of that length, the last of which may be shorter; nothing else is cut or dropped.
    With `keep_ids` the pieces carry their ids (little-endian unsigned 32-bit).

    A null or empty text is a document of `end_id` alone. A null doc_id is kept. Repeated rows are
    packed each; other columns are ignored; an empty table gives no rows.
    """
    schema = _PIECES + (", ids binary" if keep_ids else "")
    pieces = written(
        mapped(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")),
               _local(path, end_id, capacity, keep_ids), schema), "pieces")
    # Each bin has one piece at place 0, which stands for the bin.
    level = pieces.where(F.col("at") == 0).select("bin", F.col("used").alias("filled"))
    placed = pieces.select("*", F.col("bin").alias("sequence_id"), F.col("at").alias("offset"))
    groups = None
    for turn in range(1, 1000):
        underfull = level.where(F.col("filled") < capacity - slack)
        count = underfull.count()
        wanted = -(-count // items)
        if count < 2 or groups is not None and wanted >= groups:
            break
        groups = wanted
        dealt = underfull.coalesce(1) if groups == 1 else underfull.repartition(groups)
        moved = written(
            mapped(dealt, _again(capacity, turn),
                   "bin long, into long, shift long, filled long"), "merged")
        placed = placed.join(
            moved.select(F.col("bin").alias("sequence_id"), "into", "shift"), "sequence_id", "left"
        ).withColumns({
            "sequence_id": F.coalesce("into", "sequence_id"),
            "offset": F.col("offset") + F.coalesce("shift", F.lit(0)),
        }).drop("into", "shift")
        if groups == 1:
            break
        level = moved.where(F.col("shift") == 0).select(F.col("into").alias("bin"), "filled")
    out = ["doc_id", "piece", "start", "length", "ids_crc32",
           "sequence_id", F.col("offset").cast("long").alias("offset")]
    return placed.select(*out, *(["ids"] if keep_ids else []))
