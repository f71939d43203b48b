"""Best-fit packing of documents into sequences of a fixed length.

Documents are tokenized, end with one separator id, and only those longer than
a sequence are cut into pieces of its length. Pieces are then placed online by
bounded-space best fit: a task keeps a fixed number of open sequences, indexed
by their free space in a bitset; a piece goes to the open sequence with the
least free space that still holds it, and when a new sequence is needed and all
places are taken the fullest closes first. Pieces are dealt evenly over tasks
and arrive longest first, so nearly all sequences are filled to the end; the
state of a task is the open sequences, whatever it reads.

Defined results: null or empty text is the separator alone (one piece of length
1); every row is packed, repeated rows and null ids included; an empty table
gives no rows; a text of any length is cut into as many pieces as it needs, but is
tokenized whole, in the memory of one task; pieces of equal length are placed in
the order of doc_id and piece, equal free space by the sequence opened last;
``pack_docs`` reads no other columns, ``pack`` passes them through (the names
``sequence_id`` and ``offset`` are its own).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revkit.llm.bpe import encoded, read_spec
from revkit.llm.common import materialize, ship

CAPACITY, SEPARATOR, OPEN_BINS = 4096, 1, 1024
#: Tokens that one packing task places, about.
TASK_TOKENS = 1 << 26

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, and on demand the ids."""
    spec = ship(docs.sparkSession).sparkContext.broadcast(read_spec(path))  # under 2 MB, whatever the input

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, ids in encoded(spec.value, batch.column(1)):
                row, piece, start, length, crc, parts = [], [], [], [], [], []
                for i, x in enumerate(ids):
                    full = np.empty(len(x) + 1, "<u4")
                    full[:-1], full[-1] = x, SEPARATOR
                    for k, at in enumerate(range(0, len(full), capacity)):
                        part = full[at : at + capacity]
                        row.append(lo + i)
                        piece.append(k)
                        start.append(at)
                        length.append(len(part))
                        crc.append(zlib.crc32(part))
                        if with_ids:
                            parts.append(part.astype(np.int32))
                cols = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    cols.append(pa.array(parts, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(cut, PIECES + ", ids array<int>" * with_ids)


class OpenBins:
    """Open sequences keyed by free space; ``place`` returns (sequence, offset)."""

    def __init__(self, capacity: int, limit: int):
        self.capacity, self.limit = capacity, limit
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.bits = 0  # bit f: some open sequence has f places free
        self.count = self.made = 0

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        number = bins.pop()
        if not bins:
            self.bits &= ~(1 << free)
        self.count -= 1
        return number

    def place(self, length: int) -> tuple[int, int]:
        fitting = self.bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            number = self._take(free)
        else:
            if self.count >= self.limit:  # the fullest closes
                self._take((self.bits & -self.bits).bit_length() - 1)
            free, number = self.capacity, self.made
            self.made += 1
        if free > length:
            left = free - length
            self.by_free[left].append(number)
            self.bits |= 1 << left
            self.count += 1
        return number, self.capacity - free


def pack(cut: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, task_tokens: int = TASK_TOKENS) -> DataFrame:
    """``cut`` (with ``doc_id``, ``piece``, ``length``) plus ``sequence_id`` and ``offset``.

    ``cut`` is read twice; pass a written table.
    """
    total = cut.agg(F.sum("length")).first()[0] or 0
    tasks = max(1, round(total / task_tokens))
    names = cut.columns
    at = names.index("length")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, first = OpenBins(capacity, open_bins), TaskContext.get().partitionId() << 40
        for batch in batches:
            placed = [bins.place(n) for n in batch.column(at).to_pylist()]
            extra = [pa.array([first + s for s, _ in placed], pa.int64()), pa.array([o for _, o in placed], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [*names, "sequence_id", "offset"])

    dealt = cut.repartition(tasks, F.xxhash64("doc_id", "piece", "start", "length"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema.fields)
    return dealt.sortWithinPartitions(F.desc("length"), "doc_id", "piece").mapInArrow(place, f"{schema}, sequence_id long, offset long")


def pack_docs(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> DataFrame:
    """Per piece of every document: where it stands in which sequence."""
    return pack(materialize(pieces(docs, path, doc_id, text, capacity), "pieces"), capacity, open_bins)
