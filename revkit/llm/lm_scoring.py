"""LM scoring with stupid backoff over n-gram counts of the whole corpus.

Documents are gathered into blocks of words. Each block sends every distinct
n-gram once, with its count, to the partition of the count table that owns the
n-gram's hash (64-bit hashes, sorted and packed; an n-gram of every document is
one entry a block). The owner adds the counts up and answers each block with
the corpus counts of its n-grams, in the order asked. Blocks lie in a table
bucketed by block, so the join with their answers moves the answers only. The
block joins them to its exploded n-grams and sums per document

    S(w | context) = c(context w) / c(context)   if c(context w) >= MIN_COUNT
                     0.4 * S(w | shorter context) else,  S(w) = c(w) / words

in logarithms. The count table has a partition for about PART_WORDS words of
input, so neither a partition's table nor a block's answers grow with it.

Defined results: null, empty and blank texts have no words, score 0 and a null
mean; every row is scored and counted, repeated rows and null ids too; an empty
table gives no rows; a text of any length is one row of a block; equal texts get
equal scores; other columns, whatever their names, are not read. Words are taken
as written (case kept).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revkit.llm.common import bucketed, ship
from revkit.llm.wordhash import blocks, ngrams, utf8, word_starts, words

ORDER, BACKOFF, MIN_COUNT = 3, 0.4, 2
#: Bytes of text in a block (a longer text is a block of its own); words of input per partition of the table.
BLOCK_BYTES, PART_WORDS = 6 << 20, 1_000_000
#: Bits of a hash that are compared inside a partition; the partition number holds the top ones.
LOW_BITS = 48


def _pack(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(values.tobytes())


def _unpack(blob: bytes, dtype: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype)


def _pack_sorted(values: np.ndarray) -> bytes:
    """Ascending numbers below 2**48 as differences: low 32 bits apart from the high ones."""
    step = np.diff(values, prepend=np.uint64(0))
    return b"".join((len(values).to_bytes(4, "little"), (step & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes(), _pack((step >> np.uint64(32)).astype("<u2"))))


def _unpack_sorted(blob: bytes) -> np.ndarray:
    n = int.from_bytes(blob[:4], "little")
    low = np.frombuffer(blob, "<u4", n, 4).astype(np.uint64)
    high = _unpack(blob[4 + 4 * n :], "<u2").astype(np.uint64)
    return np.cumsum(low + (high << np.uint64(32)), dtype=np.uint64)


def _pack_counts(counts: np.ndarray) -> bytes:
    """Counts as bytes, those of 255 or more apart."""
    small = np.minimum(counts, 255).astype(np.uint8)
    large = _pack(counts[counts >= 255].astype("<i8"))
    return len(large).to_bytes(4, "little") + large + _pack(small)


def _unpack_counts(blob: bytes) -> np.ndarray:
    n = int.from_bytes(blob[:4], "little")
    counts = _unpack(blob[4 + n :], "u1").astype(np.int64)
    counts[counts == 255] = _unpack(blob[4 : 4 + n], "<i8")
    return counts


def block_rows(docs: DataFrame) -> DataFrame:
    """Blocks of (doc_id, text): the ids, the number of words, the texts' sizes and the texts."""
    ship(docs.sparkSession)

    def block(ids: list[int | None], parts: list[pa.Array], number: int) -> pa.RecordBatch:
        offsets, data = utf8(pa.concat_arrays(parts))
        n = sum(len(word_starts(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])) for lo, hi in blocks(np.diff(offsets)))
        cells = [
            pa.array([number], pa.int64()),
            pa.array([ids], pa.list_(pa.int64())),
            pa.array([n], pa.int64()),
            pa.array([_pack(np.diff(offsets).astype("<u4"))], pa.binary()),
            pa.array([zstandard.ZstdCompressor(level=3).compress(data.tobytes())], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(cells, ["block", "ids", "n", "sizes", "body"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids: list[int | None] = []
        parts: list[pa.Array] = []
        held = 0
        for batch in batches:
            offsets, _ = utf8(batch.column(1))
            lo = 0
            names = batch.column(0).to_pylist()
            for i, size in enumerate(np.diff(offsets).tolist()):
                if held and held + size > BLOCK_BYTES:
                    parts.append(batch.column(1).slice(lo, i - lo))
                    yield block(ids + names[lo:i], parts, number)
                    ids, parts, held, lo, number = [], [], 0, i, number + 1
                held += size
            ids += names[lo:]
            parts.append(batch.column(1).slice(lo))
        if ids:
            yield block(ids, parts, number)

    return docs.mapInArrow(run, "block long, ids array<long>, n long, sizes binary, body binary")


def _block_grams(sizes: bytes, body: bytes, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(hashes, offsets of the documents) of every order, 1 first."""
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(body), np.uint8)
    offsets = np.concatenate([[0], np.cumsum(_unpack(sizes, "<u4"), dtype=np.int64)])
    hashes, at = [], [np.zeros(1, np.int64)]
    for lo, hi in blocks(np.diff(offsets)):
        got, upto = words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], lower=False)
        hashes.append(got)
        at.append(upto[1:] + at[-1][-1])
    joined, bounds = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), np.concatenate(at)
    return [(joined, bounds), *(ngrams(joined, bounds, k) for k in range(2, order + 1))]


def _cuts(distinct: np.ndarray, bits: int) -> np.ndarray:
    """Where each partition's hashes begin in ascending hashes."""
    return np.searchsorted(distinct >> np.uint64(64 - bits) if bits else np.zeros(len(distinct), np.uint64), np.arange((1 << bits) + 1, dtype=np.uint64))


def _low(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes << np.uint64(bits)) >> np.uint64(64 - LOW_BITS)


def asked(rows: DataFrame, order: int, bits: int) -> DataFrame:
    """Per block, order and partition: the block's distinct n-grams and their counts in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, *cells in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                for k, (hashes, _) in enumerate(_block_grams(*cells, order), 1):
                    distinct, counts = np.unique(hashes, return_counts=True)
                    cuts = _cuts(distinct, bits)
                    low = _low(distinct, bits)
                    rows = [(p, lo, hi) for p, (lo, hi) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) if hi > lo]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([k << 24 | p for p, _, _ in rows], pa.int32()),
                            pa.array([block] * len(rows), pa.int64()),
                            pa.array([_pack_sorted(low[lo:hi]) for _, lo, hi in rows], pa.binary()),
                            pa.array([_pack_counts(counts[lo:hi]) for _, lo, hi in rows], pa.binary()),
                        ],
                        ["part", "block", "grams", "counts"],
                    )

    return rows.select("block", "sizes", "body").mapInArrow(run, "part int, block long, grams binary, counts binary")


def answered(grams: DataFrame, parts: int) -> DataFrame:
    """Per block, order and partition: the corpus counts of the n-grams asked for, in their order."""

    def answer(part: int, rows: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
        lists = [_unpack_sorted(g) for _, g, _ in rows]
        table, where = np.unique(np.concatenate(lists), return_inverse=True)
        total = np.bincount(where, np.concatenate([_unpack_counts(c) for _, _, c in rows]).astype(float), len(table)).astype(np.int64)
        cuts = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
        blobs = [_pack_counts(total[where[lo:hi]]) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([part] * len(rows), pa.int32()), pa.array([r[0] for r in rows], pa.int64()), pa.array(blobs, pa.binary())], ["part", "block", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, rows = None, []
        for batch in batches:
            for part, *row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if part != last and rows:
                    yield answer(last, rows)
                    rows = []
                last = part
                rows.append(tuple(row))
        if rows:
            yield answer(last, rows)

    return grams.repartition(parts, "part").sortWithinPartitions("part", "block").mapInArrow(run, "part int, block long, counts binary")


def _scores(grams: list[tuple[np.ndarray, np.ndarray]], counts: dict[int, np.ndarray], total: int) -> tuple[np.ndarray, np.ndarray]:
    """(words, summed log scores) of each document of a block."""
    n = len(grams[0][0])
    at = grams[0][1]
    size = np.diff(at)
    log_s = np.zeros(n)
    per_word: list[np.ndarray] = []  # corpus count of the n-gram that ends at each word, 0 where there is none
    for k, (hashes, upto) in enumerate(grams, 1):
        _, where = np.unique(hashes, return_inverse=True)
        got = counts[k][where] if len(hashes) else np.zeros(0, np.int64)
        ends = np.zeros(n, np.int64)
        # the n-gram that begins at word i of a document ends k - 1 words later
        first = np.repeat(at[:-1] - upto[:-1], np.diff(upto)) + np.arange(len(hashes)) + k - 1
        ends[first] = got
        if k == 1:
            log_s = np.log(ends / max(total, 1)) if n else log_s
        else:
            context = np.zeros(n, np.int64)
            context[1:] = per_word[-1][:-1]  # the n-gram before, one shorter
            # only a word with k - 1 words before it has a context of that length
            place = np.arange(n) - np.repeat(at[:-1], size)
            deep, known = place >= k - 1, ends >= MIN_COUNT
            log_s = np.where(deep & known, np.log(np.maximum(ends, 1) / np.maximum(context, 1)), np.where(deep, np.log(BACKOFF) + log_s, log_s))
        per_word.append(ends)
    sums = np.concatenate([[0.0], np.cumsum(log_s)])
    return size, sums[at[1:]] - sums[at[:-1]]


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", order: int = ORDER) -> DataFrame:
    """Per document: doc_id, n_words, log_score (sum over its words), mean_log_score."""
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = bucketed(block_rows(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))), "lm_blocks", "block", buckets)
    total = rows.agg(F.sum("n")).first()[0] or 0
    bits = max(0, (total // PART_WORDS).bit_length())
    answers = answered(asked(rows, order, bits), max(1, order << bits))
    # a block's answers are as many counts as it has distinct n-grams
    back = answers.groupBy("block").agg(F.collect_list(F.struct("part", "counts")).alias("answers"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, sizes, body, answers in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                got: dict[int, list[np.ndarray]] = {k: [] for k in range(1, order + 1)}
                for a in sorted(answers or (), key=lambda x: x["part"]):
                    got[a["part"] >> 24].append(_unpack_counts(a["counts"]))
                counts = {k: np.concatenate(v) if v else np.zeros(0, np.int64) for k, v in got.items()}
                n, logs = _scores(_block_grams(sizes, body, order), counts, total)
                mean = [s / c if c else None for s, c in zip(logs.tolist(), n.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(logs), pa.array(mean, pa.float64())], ["doc_id", "n_words", "log_score", "mean_log_score"])

    joined = rows.join(back.hint("merge"), "block", "left").select("ids", "sizes", "body", "answers")
    return joined.mapInArrow(run, "doc_id long, n_words long, log_score double, mean_log_score double")
