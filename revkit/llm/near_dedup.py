"""MinHash near-dedup by a multi-index Hamming join.

A document is the set of its distinct word shingles (five words if not told
otherwise, lower-cased A-Z; a text of fewer words is one shingle). Its signature is 64 MinHash values cut to 16
bits. Two signatures at most ``DISTANCE`` = 25 values apart are found for
certain: the 64 positions are split into 13 chunks, and as 25 < 13 * 2 at least
one chunk differs in at most one value. All chunk errors that are allowed are
enumerated: each chunk gives one key per position left out, so such a pair
shares a key. Sets with similarity 0.8 are farther apart than that with a
chance of 1 in 10,000.

Candidates are confirmed on the full shingle sets, and links become components.
No key's documents are paired with each other: in round one each is compared
with the key's hub only, one of its documents. The hub is the least in one of
``ORDERS`` random orders of the ids, so a document of a large group meets that
many different ones, which joins whole groups of copies. In keys that do not fit a
block further hub rounds compare one document of each component that the key
still holds, while that joins a fair part of them. In round two only documents of a key that still lie in different
components are compared, by signature, in blocks of bounded size (a key's
largest component is never compared with itself), and a pair that shares several
keys comes out of the first one alone. A key of very many blocks is split by a
second level of the index, so that rows are dealt out a bounded number of times.
Round two leaves out no pair that could link two components, so the components
are those of all pairs.

Equal shingle sequences are collapsed before, so copies cost one row.

Defined results: null, empty and blank texts have no shingles and link with
nothing; rows with a null id have their size but no component and are kept;
rows that repeat an id are one document that links as any of them does; a pair at
exactly the similarity is a link; a text of any length is one set, held by one
task; an empty table gives no rows; other columns, whatever their names, are not
read and pass through ``drop_near_copies``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revkit.llm.common import materialize, ship
from revkit.llm.components import connected, merge_labels
from revkit.llm.wordhash import blocks, mix, ngrams, utf8, words

SHINGLE, VALUES, DISTANCE, CHUNK = 5, 64, 25, 5
#: Links need 100 * |A & B| >= SIMILARITY * |A | B|.
SIMILARITY = 80
#: Documents of a key that are compared at once, and members sent to one task with their hub.
BLOCK_DOCS, HUB_ROWS = 4096, 2000
#: Blocks above which a key is split by the next index level, and levels in all.
SPLIT_BLOCKS, LEVELS = 100, 3
#: Hub rounds go on while one pair in so many that they compare is a link.
FAIR_PART = 50

#: Random orders of the ids by which keys choose their hubs.
ORDERS = 8

_FACTORS = np.random.default_rng(20240305).integers(0, 1 << 32, VALUES, dtype=np.uint32) | np.uint32(1)
_FLIPS = np.random.default_rng(20240306).integers(0, 1 << 32, VALUES, dtype=np.uint32)


def chunk_keys() -> list[list[int]]:
    """The positions of each key: every chunk with each one of its positions left out."""
    starts = range(0, VALUES, CHUNK)
    chunks = [list(range(s, min(s + CHUNK, VALUES))) for s in starts]
    assert 2 * len(chunks) > DISTANCE
    return [[p for p in chunk if p != out] for chunk in chunks for out in chunk]


def shingles(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingle hashes, shingle offsets of the rows, word offsets of the rows);
    rows with fewer words than a shingle get one of all their words."""
    hashes, at = words(data, offsets, lower=True)
    got, upto = ngrams(hashes, at, n)
    size = np.diff(at)
    few = np.flatnonzero((size > 0) & (size < n))
    if len(few):
        whole = np.array([mix(np.add.reduce(hashes[at[i] : at[i + 1]] * np.uint64(0x9E3779B97F4A7C15) ** np.arange(1, size[i] + 1, dtype=np.uint64), keepdims=True) + np.uint64(size[i]))[0] for i in few], np.uint64)
        got = np.insert(got, upto[few], whole)
        extra = np.zeros(len(upto), np.int64)
        extra[few + 1] = 1
        upto = upto + np.cumsum(extra)
    return got, upto, at


def signatures(got: np.ndarray, upto: np.ndarray) -> np.ndarray:
    """rows x VALUES 16-bit values; rows must have shingles."""
    low = (got >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(upto) - 1, VALUES), np.uint16)
    for k in range(VALUES):
        least = np.minimum.reduceat((low ^ _FLIPS[k]) * _FACTORS[k], upto[:-1])
        out[:, k] = ((least * np.uint32(0x9E3779B1)) ^ (least >> np.uint32(15))) >> np.uint32(16)
    return out


def _features(batch: pa.RecordBatch, n: int) -> Iterator[pa.RecordBatch]:
    offsets, data = utf8(batch.column(1))
    for lo, hi in blocks(np.diff(offsets)):
        base = offsets[lo]
        got, upto, _ = shingles(data[base : offsets[hi]], offsets[lo : hi + 1] - base, n)
        count = np.diff(upto)
        sizes = np.array([len(np.unique(got[upto[i] : upto[i + 1]])) for i in range(hi - lo)], np.int64)
        full = np.flatnonzero(count)
        sigs: list[bytes | None] = [None] * (hi - lo)
        seq: list[bytes | None] = [None] * (hi - lo)
        if len(full):
            heads = upto[full]
            for k, values in enumerate(signatures(got, np.append(heads, len(got)))):
                sigs[full[k]] = values.tobytes()
            # the shingles in order, by two sums: equal for equal word sequences
            place = np.arange(len(got), dtype=np.uint64) - np.repeat(heads, count[full]).astype(np.uint64)
            one = np.add.reduceat(got * (place * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)), heads)
            two = np.add.reduceat(mix(got + place * np.uint64(0xC2B2AE3D27D4EB4F)), heads)
            for k, pair in enumerate(np.stack([mix(one), two + count[full].astype(np.uint64)], 1)):
                seq[full[k]] = pair.tobytes()
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).slice(lo, hi - lo), pa.array(sizes), pa.array(seq, pa.binary()), pa.array(sigs, pa.binary())], ["doc_id", "n_shingles", "seq", "sig"]
        )


def features(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """Per row of (doc_id, text): set size, digest of the shingle sequence, signature."""
    ship(docs.sparkSession)
    run = lambda batches: (out for b in batches for out in _features(b, shingle))
    return docs.mapInArrow(run, "doc_id long, n_shingles long, seq binary, sig binary")


def index_keys(reps: DataFrame) -> DataFrame:
    """(key, k, id): the chunk keys of every signature; k tells which of them it is."""
    picks = chunk_keys()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(len(ids), VALUES).astype(np.uint64)
            for k, pick in enumerate(picks):
                packed = np.full(len(ids), k + 1, np.uint64)
                for p in pick:
                    packed = mix(packed + sig[:, p] * np.uint64(0x9E3779B97F4A7C15))
                yield pa.RecordBatch.from_arrays([pa.array(packed.view(np.int64)), pa.array(np.full(len(ids), k, np.int32)), pa.array(ids)], ["key", "k", "id"])

    return reps.select("id", "sig").mapInArrow(run, "key long, k int, id long")


def shared_keys(keyed: DataFrame) -> DataFrame:
    """(key, k, hub, id) of the keys that several ids share."""
    rng = np.random.default_rng(20240307)
    masks = F.array(*[F.lit(int(x)) for x in rng.integers(0, 1 << 62, ORDERS)])
    turned = F.col("id").bitwiseXOR(F.get(masks, F.col("k") % ORDERS))
    ends = keyed.groupBy("key", "k").agg(F.min(turned).alias("lo"), F.max(turned).alias("hi")).where("lo <> hi")
    hubs = ends.select("key", F.col("lo").bitwiseXOR(F.get(masks, F.col("k") % ORDERS)).alias("hub"))
    return keyed.join(hubs, "key").select("key", "k", "hub", "id")


def _near(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """The pairs (a, b) whose signatures are at most DISTANCE values apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, VALUES) for i in (2, 3))
            ok = pa.array((x != y).sum(1) <= DISTANCE)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], ["a", "b"])

    sig = lambda c: reps.select(F.col("id").alias(c), F.col("sig").alias(f"{c}_sig"))
    return pairs.join(sig("a"), "a").join(sig("b"), "b").select("a", "b", "a_sig", "b_sig").mapInArrow(run, "a long, b long")


def _confirm(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (hub, salt, member): a hub's own text comes first, then the members."""
    hub, own = None, np.zeros(0, np.uint64)
    for batch in batches:
        hubs, salts, ids, expect = (batch.column(i).to_pylist() for i in (0, 1, 3, 4))
        members = batch.column(2).to_pylist()
        offsets, data = utf8(batch.column(5))
        a, b = [], []
        for lo, hi in blocks(np.diff(offsets)):
            base = offsets[lo]
            at = offsets[lo : hi + 1] - base
            got, upto, _ = shingles(data[base : offsets[hi]], at, shingle)
            for i in range(lo, hi):
                mine = got[upto[i - lo] : upto[i - lo + 1]]
                if _sequence(mine) != expect[i]:  # another text under the same id
                    continue
                mine = np.unique(mine)
                if not members[i]:
                    hub, own = (hubs[i], salts[i]), mine
                elif hub == (hubs[i], salts[i]):
                    both = len(np.intersect1d(own, mine, assume_unique=True))
                    if 100 * both >= SIMILARITY * (len(own) + len(mine) - both):
                        a.append(hubs[i])
                        b.append(ids[i])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _sequence(got: np.ndarray) -> bytes | None:
    """The digest of one row's shingle sequence, as ``_features`` makes it."""
    if not len(got):
        return None
    place = np.arange(len(got), dtype=np.uint64)
    one = np.add.reduce(got * (place * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)), keepdims=True)
    two = np.add.reduce(mix(got + place * np.uint64(0xC2B2AE3D27D4EB4F)), keepdims=True)
    return np.stack([mix(one), two + np.uint64(len(got))], 1).tobytes()


def texts_of(need: DataFrame, docs: DataFrame, reps: DataFrame) -> DataFrame:
    """(id, seq, text) of the ids needed; repeated rows of one id and text are one."""
    texts = docs.select(F.col("doc_id").alias("id"), "text").join(need.distinct().join(reps.select("id", "seq"), "id"), "id")
    return materialize(texts.withColumn("h", F.xxhash64("text")).dropDuplicates(["id", "h"]).drop("h"), "texts")


def confirmed(pairs: DataFrame, docs: DataFrame, reps: DataFrame, shingle: int) -> DataFrame:
    """The pairs (a = hub, b) that are links by their full sets. Members meet
    their hub in runs of about HUB_ROWS, so a hub of any size is spread out."""
    pairs = materialize(pairs, "pairs")
    texts = texts_of(pairs.select(F.explode(F.array("a", "b")).alias("id")), docs, reps)
    big = pairs.groupBy("a").count().where(F.col("count") > HUB_ROWS)
    spread = F.coalesce((F.col("count") / HUB_ROWS).cast("int") + 1, F.lit(1))
    dealt = pairs.join(big, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), spread).cast("int").alias("salt"))
    hubs = dealt.select("a", "salt").distinct().join(texts.withColumnRenamed("id", "a"), "a")
    rows = hubs.select("a", "salt", F.lit(False).alias("member"), F.col("a").alias("id"), "seq", "text").unionByName(
        dealt.join(texts.withColumnRenamed("id", "b"), "b").select("a", "salt", F.lit(True).alias("member"), F.col("b").alias("id"), "seq", "text")
    )
    return rows.repartition("a", "salt").sortWithinPartitions("a", "salt", "member", "id").mapInArrow(lambda b: _confirm(b, shingle), "a long, b long")


def _near_in_cell(k: int, comp: np.ndarray, minor: np.ndarray, sig: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(i, all j) of the cell's pairs of different components that are near by
    signature and share no earlier key. (If they share one, they come out of its
    cell, or one of them is its hub and round one compared them.)"""
    picks = chunk_keys()[:k]
    for i in np.flatnonzero(minor).tolist():
        other = comp != comp[i]
        other[:i] &= ~minor[:i]  # two minor documents meet once
        j = np.flatnonzero(other)
        same = sig[j] == sig[i]
        ok = (~same).sum(1) <= DISTANCE
        j, same = j[ok], same[ok]
        for pick in picks if len(j) else ():
            later = ~same[:, pick].all(1)
            j, same = j[later], same[later]
        if len(j):
            yield i, j


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of rows with equal (key, cell, k); a cell holds two blocks at most."""
    last, run = None, []
    for batch in batches:
        for key, cell, k, *row in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True):
            if (key, cell, k) != last:
                if len(run) > 1:
                    yield last, run
                last, run = (key, cell, k), []
            run.append(tuple(row))
    if len(run) > 1:
        yield last, run


def _columns(run: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, components, minor, signatures) of a cell."""
    ids, comp, minor = (np.array([r[c] for r in run]) for c in range(3))
    return ids, comp, minor, np.frombuffer(b"".join(r[3] for r in run), np.uint16).reshape(len(run), VALUES)


def _involved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each cell that are in some near pair."""
    for (key, cell, k), run in _cells(batches):
        ids, comp, minor, sig = _columns(run)
        hit = np.zeros(len(run), bool)
        for i, j in _near_in_cell(k, comp, minor, sig):
            hit[i] = hit[j] = True
        n = int(hit.sum())
        if n:
            cols = [pa.array([key] * n, pa.int64()), pa.array([cell] * n, pa.string()), pa.array([k] * n, pa.int32()), pa.array(ids[hit]), pa.array(comp[hit]), pa.array(minor[hit])]
            yield pa.RecordBatch.from_arrays(cols, ["key", "cell", "k", "id", "comp", "minor"])


def _links_in_cell(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    """The near pairs of each cell that are links by their full sets; pairs that
    the cell's links have already joined are left out."""
    for (_, _, k), run in _cells(batches):
        ids, comp, minor, sig = _columns(run)
        sets: dict[int, np.ndarray | None] = {}
        up = {c: c for c in comp.tolist()}

        def find(c: int, up: dict = up) -> int:
            while up[c] != c:
                up[c] = up[up[c]]
                c = up[c]
            return c

        def full(i: int, sets: dict = sets, run: list = run) -> np.ndarray | None:
            if i not in sets:
                data = np.frombuffer((run[i][5] or "").encode(), np.uint8)
                got, _, _ = shingles(data, np.array([0, len(data)]), shingle)
                sets[i] = np.unique(got) if _sequence(got) == run[i][4] else None  # else another text under the same id
            return sets[i]

        a, b = [], []
        for i, others in _near_in_cell(k, comp, minor, sig):
            for j in others.tolist():
                if find(comp[i]) == find(comp[j]):
                    continue
                x, y = full(i), full(j)
                if x is None or y is None:
                    continue
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= SIMILARITY * (len(x) + len(y) - both):
                    up[find(comp[i])] = find(comp[j])
                    a.append(ids[i])
                    b.append(ids[j])
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def more_hubs(buckets: DataFrame, labels: DataFrame, docs: DataFrame, reps: DataFrame, shingle: int) -> DataFrame:
    """``labels`` (id, comp) after further hub rounds over the keys that do not fit
    a block, which are linear: of every such key that still holds several
    components each sends one document, and all of these are compared with one of
    them, both chosen anew each round. Rounds go on while they join a fair part of
    what they compare (round two is exact in any case)."""
    large = materialize(buckets.groupBy("key").count().where(F.col("count") > BLOCK_DOCS).select("key"), "large")
    if large.isEmpty():
        return labels
    buckets = materialize(buckets.join(large, "key", "left_semi"), "large-keys")
    for turn in count(1):
        members = buckets.join(labels, "id", "left").select("key", "id", F.coalesce("comp", "id").alias("comp"))
        heads = members.groupBy("key", "comp").agg(F.min(F.struct(F.xxhash64("id", F.lit(turn)).alias("h"), "id")).alias("m")).select("key", "comp", F.col("m.id").alias("id"))
        heads = materialize(heads, "heads")
        hubs = heads.groupBy("key").agg(F.min(F.struct(F.xxhash64("comp", "key", F.lit(turn)).alias("h"), "id")).alias("m"), F.count("*").alias("n")).where("n > 1")
        pairs = heads.join(hubs.select("key", F.col("m.id").alias("hub")), "key").where("id <> hub")
        pairs = materialize(pairs.select(F.least("hub", "id").alias("a"), F.greatest("hub", "id").alias("b")).distinct(), "pairs")
        links = materialize(confirmed(_near(pairs, reps), docs, reps, shingle), "links")
        compared, joined = pairs.count(), links.count()
        if joined:
            labels = materialize(merge_labels(labels, links), "labels")
        if joined * FAIR_PART <= compared:
            return labels


def _next_keys(rows: DataFrame, level: int) -> DataFrame:
    """Rows of (key, k, id, comp, used, sig) under the keys of the next index
    level; ``used`` holds the bits of the chunks that a key is made of.

    Two documents that are at most DISTANCE values apart and were brought
    together by chunks with few errors differ by at most DISTANCE in all the
    chunks, so in one of the m chunks not used yet by at most DISTANCE // m. All
    ways to leave out that many positions of such a chunk are enumerated."""
    chunks = [list(range(s, min(s + CHUNK, VALUES))) for s in range(0, VALUES, CHUNK)]
    errors = DISTANCE // (len(chunks) - level)
    picks = [(c, pick) for c, chunk in enumerate(chunks) for pick in combinations(chunk, max(len(chunk) - errors, 0))]
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, k, ids, comp, used = (batch.column(i).to_numpy() for i in range(5))
            sig = np.frombuffer(b"".join(batch.column(5).to_pylist()), np.uint16).reshape(len(ids), VALUES).astype(np.uint64)
            for n, (c, pick) in enumerate(picks):
                mine = (used >> c & 1) == 0
                packed = mix(key[mine].view(np.uint64) + np.uint64((n + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
                for p in pick:
                    packed = mix(packed + sig[mine, p] * np.uint64(0x9E3779B97F4A7C15))
                cols = [packed.view(np.int64), k[mine], ids[mine], comp[mine], used[mine] | 1 << c]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], ["key", "k", "id", "comp", "used"])

    return rows.mapInArrow(run, "key long, k int, id long, comp long, used long")


def unsettled(buckets: DataFrame, labels: DataFrame, reps: DataFrame) -> DataFrame:
    """Rows (key, cell, k, id, comp, minor) of the documents that share a key with
    one of another component, near by signature; within a cell, each such pair
    that round one has not compared is there."""
    return by_cell(in_cells(buckets, labels, reps)).mapInArrow(_involved, "key long, cell string, k int, id long, comp long, minor boolean")


def in_cells(buckets: DataFrame, labels: DataFrame, reps: DataFrame) -> DataFrame:
    """The documents of every key that several components share, in the cells
    where they are compared: (key, cell, k, id, comp, minor, sig).

    Cells of up to two blocks take a key of any size, but a key of n blocks
    deals its rows n times. A key above ``SPLIT_BLOCKS`` is split by a second
    level of the index instead, which costs each row a constant number of keys
    (and those that are still as large by a third)."""
    used = F.get(F.array(*[F.lit(1 << k // CHUNK).cast("long") for k in range(VALUES)]), F.col("k"))  # the chunk of a key's number
    rows = buckets.where("id <> hub").join(labels, "id", "left").select("key", "k", "id", F.coalesce("comp", "id").alias("comp"), used.alias("used"))
    rows = materialize(rows, "members")
    out = None
    for level in range(1, LEVELS + 1):
        mixed = rows.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
        sizes = rows.join(mixed, "key").groupBy("key", "comp").count()
        sizes = sizes.groupBy("key").agg(F.sum("count").alias("n"), F.max(F.struct("count", "comp")).alias("top"))
        large = F.col("n") > BLOCK_DOCS * SPLIT_BLOCKS
        last = level == LEVELS or sizes.where(large).isEmpty()
        sized = rows.join(sizes if last else sizes.where(~large), "key")
        part = _dealt(sized).join(reps.select("id", "sig"), "id").select("key", "cell", "k", "id", "comp", "minor", "sig")
        out = part if out is None else out.unionByName(part)
        if last:
            break
        below = rows.join(sizes.where(large).select("key"), "key").join(reps.select("id", "sig"), "id").select("key", "k", "id", "comp", "used", "sig")
        rows = materialize(_next_keys(below, level), "members")
    return out


def _dealt(sized: DataFrame) -> DataFrame:
    """Rows (key, k, id, comp, n, top) in every cell where they are compared."""
    rows = sized.withColumn("minor", (F.col("comp") != F.col("top.comp")) | (F.col("n") <= BLOCK_DOCS))
    block = lambda n: F.greatest(F.ceil(n / BLOCK_DOCS), F.lit(1)).cast("int")
    small, large = block(F.col("n") - F.col("top.count")), block(F.col("top.count"))
    mine = F.pmod(F.xxhash64("id"), F.when(F.col("minor"), small).otherwise(large)).cast("int")
    # cells: "s" the whole key; "m i j" minor blocks i <= j; "M i j" minor block i and block j of the largest component
    both = lambda kind, i, j: F.concat_ws(" ", F.lit(kind), i, j)
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    minor_cells = F.concat(
        F.transform(upto(F.col("small")), lambda j: both("m", F.least("mine", j), F.greatest("mine", j))),
        F.transform(upto(F.col("large")), lambda j: both("M", F.col("mine"), j)),
    )
    major_cells = F.transform(upto(F.col("small")), lambda i: both("M", i, F.col("mine")))
    rows = rows.withColumns({"small": small, "large": large, "mine": mine})
    cells = F.when(F.col("n") <= BLOCK_DOCS, F.array(F.lit("s"))).when(F.col("minor"), minor_cells).otherwise(major_cells)
    return rows.select("key", F.explode(cells).alias("cell"), "k", "id", "comp", "minor")


def by_cell(rows: DataFrame) -> DataFrame:
    return rows.repartition("key", "cell").sortWithinPartitions("key", "cell", "k", "id")


def cross_links(rows: DataFrame, docs: DataFrame, reps: DataFrame, shingle: int) -> DataFrame:
    """Links (a, b) between the components of the cells of ``rows``."""
    rows = materialize(rows, "unsettled")
    texts = texts_of(rows.select("id"), docs, reps)
    full = rows.join(reps.select("id", "sig"), "id").join(texts, "id").select("key", "cell", "k", "id", "comp", "minor", "sig", "seq", "text")
    return by_cell(full).mapInArrow(lambda b: _links_in_cell(b, shingle), "a long, b long")


def components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    feats = materialize(features(docs, shingle), "features")
    named = feats.where("doc_id IS NOT NULL AND seq IS NOT NULL")
    least = named.groupBy("seq").agg(F.min(F.struct("doc_id", "sig")).alias("m"))
    reps = materialize(least.select(F.col("m.doc_id").alias("id"), "seq", "m.sig"), "classes")
    buckets = materialize(shared_keys(index_keys(reps)), "buckets")
    first = buckets.where("id <> hub").select(F.least("hub", "id").alias("a"), F.greatest("hub", "id").alias("b")).distinct()
    links = confirmed(_near(first, reps), docs, reps, shingle)
    # an id that stands for two sequences links them, and all rows of an id are one document
    twice = named.join(reps.select("seq", "id"), "seq").select(F.col("doc_id").alias("a"), F.col("id").alias("b")).where("a <> b")
    repeated = named.groupBy("doc_id").agg(F.min("seq").alias("s"), F.max("seq").alias("t")).where("s <> t").select(F.col("doc_id").alias("a"))
    labels = connected(links.unionByName(twice.join(repeated, "a", "left_semi")))
    labels = more_hubs(buckets, labels, docs, reps, shingle)
    more = cross_links(unsettled(buckets, labels, reps), docs, reps, shingle)
    labels = materialize(merge_labels(labels, more), "components")
    classes = reps.join(labels, "id", "left").select("seq", F.coalesce("comp", "id").alias("comp"))
    out = feats.join(classes, "seq", "left")
    component = F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("comp", "doc_id"))
    kept = F.col("doc_id").isNull() | (F.col("doc_id") == component)
    return out.select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"))


def drop_near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    out = materialize(components(docs, doc_id, text, shingle), "near")
    gone = out.where(~F.col("kept")).select(F.col("doc_id").alias(doc_id)).distinct()
    return docs.join(gone, doc_id, "left_anti").select(*docs.columns)
