"""Packed token-id matrices for training: best-fit decreasing with a segment tree.

A task tokenizes its documents and packs them block by block (a bounded number of tokens), so its
memory does not grow with the partition. Within a block pieces are placed longest first into the
open row with the least sufficient room, found in a segment tree over room sizes.
"""

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakscope.llm import tokens
from leakscope.llm.common import mapped

CAPACITY = 2048
BLOCK_TOKENS = 8_000_000

SCHEMA = ("sequence_id long, n_tokens int, n_documents int, ids binary, cu_seqlens array<int>, "
          "position_starts array<long>, doc_ids array<long>")


class Rooms:
    """Segment tree over room sizes 0..capacity: how many open rows have that much room."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _add(self, room: int, by: int) -> None:
        at = self.leaves + room
        while at:
            self.count[at] += by
            at >>= 1

    def put(self, row: int, room: int) -> None:
        self.rows[room].append(row)
        self._add(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """(row, room) of an open row with the least room that suffices."""
        count, at = self.count, self.leaves + need
        if not count[at]:
            # up to the first subtree further right that holds a row, then down to its left end
            while at > 1 and (at & 1 or not count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if count[2 * at] else 2 * at + 1
        room = at - self.leaves
        self._add(room, -1)
        return self.rows[room].pop(), room


def fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Rows of items: best fit, longest items first."""
    rooms, rows = Rooms(capacity), []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        found = rooms.take(lengths[i])
        row, room = found or (len(rows), capacity)
        if found is None:
            rows.append([])
        rows[row].append(i)
        if room > lengths[i]:
            rooms.put(row, room - lengths[i])
    return rows


def _packer(path: str, ranks: str, capacity: int, end_id: int, pad_id: int, code: str, block: int):
    kind = np.dtype({"H": "<u2", "I": "<u4"}[code])

    def rows_of(pieces, number):
        """Rows of the matrix from pieces (document, place in it, ids)."""
        placed = fit([len(p[2]) for p in pieces], capacity)
        for a in range(0, len(placed), 1000):
            part = placed[a : a + 1000]
            order = [i for row in part for i in row]
            lengths = np.array([len(pieces[i][2]) for i in order], np.int64)
            counts = np.array([len(row) for row in part], np.int64)
            rows = np.repeat(np.arange(len(part)), counts)
            # where each piece begins in its row, and where each row's segments begin in the list
            ends = np.cumsum(lengths)
            first = np.concatenate([[0], np.cumsum(counts)])
            filled = np.add.reduceat(lengths, first[:-1])
            starts = ends - lengths - (ends - lengths)[first[:-1]][rows]
            matrix = np.full((len(part), capacity), pad_id, kind)
            for i, row, start in zip(order, rows.tolist(), starts.tolist()):
                matrix[row, start : start + len(pieces[i][2])] = pieces[i][2]
            cumulative = np.insert(starts, first[1:], filled).astype(np.int32)
            segments = pa.array(first, pa.int32())
            yield pa.RecordBatch.from_arrays([
                pa.array(np.arange(number + a, number + a + len(part))),
                pa.array(filled.astype(np.int32)), pa.array(counts.astype(np.int32)),
                pa.Array.from_buffers(pa.binary(), len(part), [
                    None, pa.py_buffer((np.arange(len(part) + 1) * capacity * kind.itemsize)
                                       .astype(np.int32)), pa.py_buffer(matrix)]),
                pa.ListArray.from_arrays(
                    pa.array((first + np.arange(len(first))).astype(np.int32)),
                    pa.array(cumulative)),
                pa.ListArray.from_arrays(
                    segments, pa.array([pieces[i][1] for i in order], pa.int64())),
                pa.ListArray.from_arrays(
                    segments, pa.array([pieces[i][0] for i in order], pa.int64())),
            ], names=[f.split()[0] for f in SCHEMA.split(", ")])

    def run(batches):
        encoder = tokens.ranks(ranks, path)
        number, pieces, held = TaskContext.get().partitionId() << 40, [], 0
        for (ids,), texts in tokens.parts(batches):
            for doc, text in zip(ids, texts):
                data = np.append(encoder.of(text).astype(kind), kind.type(end_id))
                for a in range(0, len(data), capacity):
                    pieces.append((doc, a, data[a : a + capacity]))
                held += len(data)
            if held >= block:
                yield from rows_of(pieces, number)
                number, pieces, held = number + len(pieces), [], 0
        if pieces:
            yield from rows_of(pieces, number)

    return run


def packed_sequences(docs: DataFrame, path: str, ranks: str, end_id: int,
                     capacity: int = CAPACITY, pad_id: int = 0, code: str = "H",
                     block: int = BLOCK_TOKENS) -> DataFrame:
    """One row for each row of the id matrix.

    `path` and `ranks` are one vocabulary as a file of each tokenizer library.

    ids: `capacity` little-endian unsigned ids (`code` H: 16 bits, I: 32 bits), padded with
    `pad_id`. cu_seqlens: where segments begin, and the filled length at the end. position_starts:
    the position in its document at which each segment begins (0: positions restart; a document
    longer than a row goes on in several segments without loss). doc_ids: document of each segment.

    Every document, null and empty texts included, ends in `end_id`, so none is lost. A null
    doc_id stays null. Repeated rows are packed each; other columns are ignored; an empty table
    gives no rows.
    """
    return mapped(
        docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")),
        _packer(path, ranks, capacity, end_id, pad_id, code, block), SCHEMA)


def write_sequences(sequences: DataFrame, path: str) -> None:
    """The matrices as Parquet in any store Spark can write: one file for each partition."""
    sequences.write.mode("overwrite").parquet(path)


def position_ids(cu_seqlens, position_starts, capacity: int, resets: bool = True) -> np.ndarray:
    """Position of each token of a row; `resets`: from 0 in each segment, else in its document."""
    out = np.zeros(capacity, np.int64)
    for a, b, start in zip(cu_seqlens[:-1], cu_seqlens[1:], position_starts):
        out[a:b] = np.arange(b - a) + (0 if resets else start)
    return out
