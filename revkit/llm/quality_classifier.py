"""Quality classifier: hashed word n-gram logistic regression, trained with
follow-the-regularised-leader (FTRL-proximal) updates.

Features of a text are its words, word pairs, word shapes (capitals, digits,
last character, length, repetition of the word before) and shape pairs, hashed
into 2**18 slots; a value is the feature's share of all features. Training
reads a bounded sample of labelled rows, dealt into shards: each shard makes
FTRL passes over its rows, and the shards' weights are averaged. A score is a
sparse dot product through the logistic function, computed for every whole
text with the weights as a broadcast array of fixed size (1 MB).

Defined results: null or empty text has no features and gets the bias alone;
repeated label rows count once (label 1 only if all say so); without labels of
both classes every score is the share of label 1, or 0.5; null ids are scored
and never held out; of several texts of one labelled id the least is learned;
equal texts get equal scores; a text of any length is scored whole, a shard of
labelled rows is held by one task; an empty table gives no rows; other columns,
whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revkit.llm.common import ship
from revkit.llm.wordhash import blocks, mix, ngrams, utf8, word_bounds, words

BITS = 18
#: Labelled rows that training reads at most, and the rows of a shard.
SAMPLE, SHARD_ROWS = 16_000, 2_000
PASSES, ALPHA, BETA, L1, L2 = 4, 0.3, 1.0, 0.0005, 0.002
#: A text's feature values sum to this.
SCALE = 12.0
THRESHOLD = 0.3

_UPPER = np.zeros(256, np.uint8)
_UPPER[65:91] = 1
_SMALL = np.zeros(256, np.uint8)
_SMALL[97:123] = 1
_DIGIT = np.zeros(256, np.uint8)
_DIGIT[48:58] = 1
_LAST = np.full(256, 7, np.uint64)
for _i, _set in enumerate(("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ",;:", ".", "!?", "#*$%&|<>=~^", "\"')]}")):
    _LAST[[ord(c) for c in _set]] = _i
_LAST[128:] = 0


def _shapes(data: np.ndarray, offsets: np.ndarray, hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    starts, stops = word_bounds(data, offsets)
    some = lambda mask: (np.add.reduceat(mask[data].astype(np.int64), starts) > 0).astype(np.uint64)
    upper, small, digit = some(_UPPER), some(_SMALL), some(_DIGIT)
    length = np.minimum(np.log2(stops - starts).astype(np.uint64), 5)
    same = np.zeros(len(hashes), np.uint64)
    same[1:] = hashes[1:] == hashes[:-1]
    heads = at[:-1][at[:-1] < len(same)]
    same[heads] = 0
    u = np.uint64
    code = _UPPER[data[starts]].astype(u) | upper << u(1) | small << u(2) | digit << u(3) | _LAST[data[stops - 1]] << u(4) | length << u(7) | same << u(10)
    return mix(code + u(0x51A9E))


def hashed_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(slots of every feature, feature offsets of the rows) of one block."""
    hashes, at = words(data, offsets, lower=False)
    if not len(hashes):
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    shapes = _shapes(data, offsets, hashes, at)
    parts = [(hashes, at), ngrams(hashes, at, 2), (shapes, at), ngrams(shapes, at, 2)]
    count = sum(np.diff(upto) for _, upto in parts)
    out = np.concatenate([[0], np.cumsum(count)])
    slots = np.empty(out[-1], np.int64)
    begin = out[:-1].copy()
    for k, (values, upto) in enumerate(parts):
        size = np.diff(upto)
        slots[np.repeat(begin - upto[:-1], size) + np.arange(len(values))] = (mix(values + np.uint64(k)) >> np.uint64(64 - BITS)).astype(np.int64)
        begin += size
    return slots, out


def _rows(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    offsets, data = utf8(column)
    for lo, hi in blocks(np.diff(offsets)):
        base = offsets[lo]
        yield lo, hi, *hashed_features(data[base : offsets[hi]], offsets[lo : hi + 1] - base)


def _train_shard(table: pa.Table) -> pa.Table:
    """FTRL passes over one shard (rows in a fixed order): its nonzero weights; slot -1 is the bias."""
    table = table.sort_by([("place", "ascending"), ("label", "ascending")])
    examples = []
    labels = table.column("label").to_pylist()
    for lo, hi, slots, upto in _rows(table.column("text")):
        for i in range(lo, hi):
            got, count = np.unique(slots[upto[i - lo] : upto[i - lo + 1]], return_counts=True)
            examples.append((np.append(got, 1 << BITS), np.append(SCALE * count / max(count.sum(), 1), 1.0), labels[i]))
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        l1 = np.where(i == 1 << BITS, 0.0, L1)
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    for _ in range(PASSES):
        for i, x, y in examples:
            w = weights(i)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA * w
            n[i] += g * g
    every = weights(np.arange(len(z)))
    slot = np.flatnonzero(every)
    return pa.table({"slot": pa.array(np.where(slot == 1 << BITS, -1, slot), pa.int32()), "weight": pa.array(every[slot])})


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> np.ndarray:
    """Weights of all slots, the bias last. Rows held out are never read."""
    ship(docs.sparkSession)
    truth = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
    truth = truth.groupBy("doc_id").agg(F.min("quality").alias("label"))
    out = np.zeros((1 << BITS) + 1)
    total, ones = truth.agg(F.count("*"), F.sum("label")).first()
    if not ones or ones == total:
        return out
    place = F.xxhash64(F.lit("sample"), "doc_id")
    # the first ``sample`` rows by hash: the same whatever the partitions are
    drawn = truth.select(F.col("doc_id").alias("id"), "label", place.alias("place")).orderBy("place", "id").limit(sample)
    drawn = F.broadcast(drawn)  # at most ``sample`` rows of three numbers
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(drawn, "id")
    rows = rows.groupBy("id", "label", "place").agg(F.min("text").alias("text"))  # one text of a repeated id
    shards = max(1, round(min(total, sample) / SHARD_ROWS))
    shard = F.pmod(F.shiftright("place", 32), F.lit(shards))
    trained = rows.select(shard.alias("shard"), "place", "label", "text").groupBy("shard").applyInArrow(_train_shard, "slot int, weight double")
    mean = trained.groupBy("slot").agg((F.sum("weight") / shards).alias("weight")).toArrow()  # at most 2**18 + 1 rows
    out[mean.column("slot").to_numpy()] = mean.column("weight").to_numpy()
    return out


def score(docs: DataFrame, weights: np.ndarray, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    shared = ship(docs.sparkSession).sparkContext.broadcast(weights.astype(np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = shared.value
            for lo, hi, slots, upto in _rows(batch.column(1)):
                sums = np.concatenate([[0.0], np.cumsum(w[slots], dtype=np.float64)])
                size = np.diff(upto)
                logit = w[-1] + SCALE * (sums[upto[1:]] - sums[upto[:-1]]) / np.maximum(size, 1)
                p = 1 / (1 + np.exp(-np.clip(logit, -35, 35)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(p)], ["doc_id", "score"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    scored = rows.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
