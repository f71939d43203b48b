"""Best-fit decreasing packing of documents into sequences of a fixed length.

Documents are tokenized and end with one separator id. Overlong documents are
first cut into full windows, each a sequence of its own; what is left of a
document, and every shorter document, is one *rest*. Rests are dealt over tasks
of bounded size by a hash of the row and placed longest first: a segment tree
indexed by remaining capacity finds the tightest open window that still holds a
rest, else a new window opens.

A sequence is padded to the full length unless its length is a power of two. As
pieces may be cut freely, no task leaves padding: windows that are not full are
topped up, fullest first, from the emptiest ones (whole rests where they fit,
one cut for what still lacks), and the one window that stays is closed as
sequences whose lengths are the powers of two that it is the sum of.

A cut needs the checksums of its two parts. Only texts with such a cut are read
and tokenized again; they are known by the SHA-256 of the text.

Defined results: null or empty text is the separator alone (one piece of one
id); every row is packed, repeated rows and null ids included, and equal rows
are told apart by nothing but their places; ties of length are placed in order
of doc_id and a row hash; a text of any length is cut into as many windows as it
needs, but is tokenized whole, in memory; an empty table gives no rows; other
columns of the documents, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revkit.llm.bpe import encoded, read_spec
from revkit.llm.common import materialize, ship, text_or_empty

CAPACITY, SEPARATOR = 4096, 2
#: Tokens and rests that one packing task holds, about.
TASK_TOKENS, TASK_RESTS = 1 << 26, 1 << 18
#: Texts (32-byte keys, counted before) up to which the keys of cut texts are
#: broadcast; beyond, the texts are shuffled by their keys.
BROADCAST_KEYS = 200_000

_CUT = "doc_id long, text_key binary, start long, length long, ids_crc32 long, doc_tokens long"
_PLACED = "doc_id long, text_key binary, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _with_end(ids: np.ndarray, separator: int) -> np.ndarray:
    full = np.empty(len(ids) + 1, "<u4")
    full[:-1], full[-1] = ids, separator
    return full


def windows(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, separator: int = SEPARATOR) -> DataFrame:
    """Per full window and rest: doc_id, SHA-256 of the text, start, length,
    ids_crc32 and the tokens of the document."""
    spec = ship(docs.sparkSession).sparkContext.broadcast(read_spec(path))  # under 2 MB, whatever the input

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, ids in encoded(spec.value, batch.column(1)):
                row, start, length, crc, total = [], [], [], [], []
                for i, x in enumerate(ids):
                    full = _with_end(x, separator)
                    for at in range(0, len(full), capacity):
                        part = full[at : at + capacity]
                        row.append(lo + i)
                        start.append(at)
                        length.append(len(part))
                        crc.append(zlib.crc32(part))
                        total.append(len(full))
                keys = [hashlib.sha256((t or "").encode()).digest() for t in batch.column(1).slice(lo, len(ids)).to_pylist()]
                cols = [batch.column(0).take(pa.array(row, pa.int64())), pa.array([keys[r - lo] for r in row], pa.binary())]
                cols += [pa.array(x, pa.int64()) for x in (start, length, crc, total)]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "text_key", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(cut, _CUT)


class CapacityTree:
    """Open windows under the leaves of their remaining capacity; each node of
    the segment tree counts the windows below it."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.counts = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _add(self, free: int, by: int) -> None:
        node = self.size + free
        while node:
            self.counts[node] += by
            node >>= 1

    def put(self, free: int, window: int) -> None:
        self.open[free].append(window)
        self._add(free, 1)

    def take(self, length: int) -> tuple[int, int] | None:
        """(remaining capacity, window) of the tightest window that holds ``length``."""
        node, counts = self.size + length, self.counts
        if not counts[node]:
            # up to the first right sibling with windows below it, then down its left side
            while node > 1 and (node & 1 or not counts[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node *= 2
                if not counts[node]:
                    node += 1
        free = node - self.size
        window = self.open[free].pop()
        self._add(free, -1)
        return free, window


#: A piece: (row, start, length); row is the caller's.
Piece = tuple[int, int, int]


def best_fit(rests: Iterator[tuple[int, int, int]], capacity: int) -> Iterator[list[Piece]]:
    """Sequences (lists of pieces) from rests that arrive longest first. Full
    windows come out as they fill; the rest of the windows is topped up at the end."""
    tree, held = CapacityTree(capacity), {}
    made = 0
    for row, start, length in rests:
        found = tree.take(length)
        if found is None:
            free, window = capacity, made
            held[window] = []
            made += 1
        else:
            free, window = found
        held[window].append((row, start, length))
        if free > length:
            tree.put(free - length, window)
        else:
            yield held.pop(window)
    yield from top_up([held[w] for free in range(capacity + 1) for w in tree.open[free]], capacity)


def top_up(partial: list[list[Piece]], capacity: int) -> Iterator[list[Piece]]:
    """Sequences without padding from windows that are not full, fullest first."""
    lo, hi = 0, len(partial) - 1
    while lo < hi:
        window = partial[lo]
        lack = capacity - sum(p[2] for p in window)
        while lack and lo < hi:
            donor = partial[hi]
            fits = [p for p in donor if p[2] <= lack]
            if fits:
                best = max(fits, key=lambda p: p[2])
                donor.remove(best)
                window.append(best)
                lack -= best[2]
                if not donor:
                    hi -= 1
            else:
                least = min(range(len(donor)), key=lambda k: donor[k][2])
                row, start, length = donor[least]
                window.append((row, start, lack))
                donor[least] = (row, start + lack, length - lack)
                lack = 0
        if lack:  # no donor is left: this is the last window
            break
        yield window
        lo += 1
    if lo == hi:
        yield from binary(partial[lo])


def binary(window: list[Piece]) -> Iterator[list[Piece]]:
    """One window as sequences whose lengths are powers of two, longest first."""
    left = sum(p[2] for p in window)
    pieces = window[::-1]
    while left:
        size = 1 << (left.bit_length() - 1)
        left -= size
        out = []
        while size:
            row, start, length = pieces.pop()
            if length > size:
                pieces.append((row, start + size, length - size))
                length = size
            out.append((row, start, length))
            size -= length
        yield out


def pack(cut: DataFrame, capacity: int = CAPACITY, task_tokens: int = TASK_TOKENS, task_rests: int = TASK_RESTS) -> DataFrame:
    """``cut`` (the columns of ``windows``) with ``sequence_id`` and ``offset``;
    rests that were cut once more come as several rows with a null checksum.

    ``cut`` is read twice; pass a written table.
    """
    small = F.col("length") < capacity
    total, rows = cut.where(small).agg(F.coalesce(F.sum("length"), F.lit(0)), F.count("*")).first()
    tasks = max(1, round(total / task_tokens), -(-rows // task_rests))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 40
        known: list[tuple] = []

        def rests() -> Iterator[tuple[int, int, int]]:
            for batch in batches:
                for row in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                    known.append(row)
                    yield len(known) - 1, row[2], row[3]

        out: list[tuple] = []
        for k, sequence in enumerate(best_fit(rests(), capacity)):
            at = 0
            for row, start, length in sequence:
                doc, key, _, whole, crc, tokens = known[row]
                out.append((doc, key, start, length, crc if length == whole else None, tokens, first + k, at))
                at += length
            if len(out) >= 10_000:
                yield _batch(out)
                out = []
        yield _batch(out)

    fresh = F.xxhash64("doc_id", "text_key", "start", F.monotonically_increasing_id())
    dealt = cut.where(small).withColumn("deal", fresh).repartition(tasks, "deal").sortWithinPartitions(F.desc("length"), "doc_id", "deal").drop("deal")
    whole = cut.where(~small).select("*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return whole.unionByName(dealt.mapInArrow(place, _PLACED))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.binary(), *[pa.int64()] * 6]
    cols = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
    return pa.RecordBatch.from_arrays(cols, ["doc_id", "text_key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])


def checksums(ranges: DataFrame, docs: DataFrame, path: str, text: str = "text", separator: int = SEPARATOR) -> DataFrame:
    """The checksum of every range (text_key, start, length) of distinct texts."""
    spec = ship(docs.sparkSession).sparkContext.broadcast(read_spec(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, ids in encoded(spec.value, batch.column(1)):
                keys = batch.column(0).slice(lo, len(ids)).to_pylist()
                wanted = batch.column(2).slice(lo, len(ids)).to_pylist()
                key, start, length, crc = [], [], [], []
                for k, x, want in zip(keys, ids, wanted, strict=True):
                    full = _with_end(x, separator)
                    for r in want:
                        key.append(k)
                        start.append(r["start"])
                        length.append(r["length"])
                        crc.append(zlib.crc32(full[r["start"] : r["start"] + r["length"]]))
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.binary()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], ["text_key", "start", "length", "cut_crc"])

    # the distinct ranges of one text; copies that were cut alike share them
    wanted = materialize(ranges.distinct().groupBy("text_key").agg(F.collect_list(F.struct("start", "length")).alias("ranges")), "ranges")
    keys = wanted.select("text_key")
    if keys.count() <= BROADCAST_KEYS:
        keys = F.broadcast(keys)
    texts = docs.select(text_or_empty(F.col(text)).alias("text")).withColumn("text_key", F.unhex(F.sha2("text", 256)))
    found = texts.join(keys, "text_key", "left_semi").groupBy("text_key").agg(F.first("text").alias("text"))
    return found.join(wanted, "text_key").select("text_key", "text", "ranges").mapInArrow(run, "text_key binary, start long, length long, cut_crc long")


def pack_docs(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, separator: int = SEPARATOR, task_tokens: int = TASK_TOKENS) -> DataFrame:
    """Per piece of every document: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id and offset."""
    placed = materialize(pack(materialize(windows(docs, path, doc_id, text, capacity, separator), "windows"), capacity, task_tokens), "placed")
    open_ = placed.where("ids_crc32 IS NULL").select("text_key", "start", "length")
    sums = checksums(open_, docs, path, text, separator)
    known = placed.where("ids_crc32 IS NOT NULL").unionByName(placed.where("ids_crc32 IS NULL").join(sums, ["text_key", "start", "length"]).withColumn("ids_crc32", F.col("cut_crc")).drop("cut_crc"))
    return known.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
