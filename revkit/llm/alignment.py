"""Cross-tokenizer alignment by lockstep vectorised merging.

Each text, with one space before it, is tokenized by a byte-level BPE file (A)
and a piece model (B). Token ends are byte offsets; where a token of A and one of
B end together is a *cut*, and the two are *linked*. Cuts divide both token rows
into the smallest groups that cover the same bytes.

The cuts of a batch come from one merge of all its documents at once: a NumPy
state vector holds a pointer into A and one into B for every lane; each step
compares the two ends of all lanes, emits the links and cuts of those that are
equal, advances the pointer that is behind (both on a cut), and compacts the
lanes that are finished. A lane is a document, or a stretch of ``LANE`` bytes of
a long one: ends are compared only with ends of the same stretch, so a stretch is
merged on its own.

Links are counted over the corpus by their pair of ids. Documents are gathered
into blocks of bounded size that know their distinct pairs; pairs are counted
with map-side combine, and a block gets the counts of its own pairs back by a
join of (block, pair) rows, so no row is as frequent as a frequent pair. The
highest count of each id of B is one row per entry of B's vocabulary, which
bounds the broadcast.

Defined results: a text that is null, empty, or whose tokens of A or B do not
spell the space and the text (a text that holds U+2581, or that B normalizes) has
no tokens: zeros, and no groups; rows with a null id are kept; equal rows give
equal rows; equal counts are all the highest; a text of any length is merged in
lanes but held by one task; an empty table gives no rows; other columns,
whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import cached_property
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revkit.llm.bpe import byte_chars, read_spec
from revkit.llm.common import materialize, ship
from revkit.llm.wordhash import blocks

#: Bytes of one lane, and of the texts that are merged at once (or one text).
LANE, BATCH = 256, 1 << 19
#: Documents' distinct pairs and documents of a block, about.
BLOCK_LINKS, BLOCK_DOCS = 1 << 18, 1 << 14
#: Words of so many characters are split by the file's own library.
LONG_WORD = 1000
#: Bits of an id of B in a pair of ids.
B_BITS = 15
#: Fixed value: how byte-level files split a text.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Spelling(NamedTuple):
    """The bytes of every id: ``data[at[i]:at[i + 1]]``."""

    data: np.ndarray
    at: np.ndarray

    @classmethod
    def of(cls, tokens: list[bytes]) -> Spelling:
        return cls(np.frombuffer(b"".join(tokens), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in tokens])]).astype(np.int64))

    def sizes(self, ids: np.ndarray) -> np.ndarray:
        return self.at[ids + 1] - self.at[ids]

    def join(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The bytes of the tokens one after another."""
        ends = np.cumsum(sizes)
        return self.data[np.repeat(self.at[ids] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]


class ByteSide:
    """Ids by a byte-level BPE file (its JSON text); special tokens are plain text."""

    def __init__(self, spec: str):
        self.spec = spec
        model = json.loads(spec)
        vocab = model["model"]["vocab"]
        to_byte = {c: b for b, c in enumerate(byte_chars())}
        spelled = {i: bytes(to_byte[c] for c in token) if all(c in to_byte for c in token) else token.encode() for token, i in vocab.items()}
        added = {t["id"]: t["content"].encode() for t in model["added_tokens"]}
        tokens = added | spelled
        self.spelling = Spelling.of([tokens.get(i, b"") for i in range(max(tokens) + 1)])
        self.fast = self._ranked(model, vocab, spelled, added)

    def _ranked(self, model: dict, vocab: dict[str, int], spelled: dict[int, bytes], added: dict[int, bytes]):
        """A faster encoder with the same results where the file is of the plain
        form: merges in the order of the ids they make, the usual split."""
        import tiktoken

        pre, merges = model.get("pre_tokenizer") or {}, model["model"]["merges"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        made = [vocab.get(a + b) for a, b in pairs]
        plain = {i: t for i, t in spelled.items() if i not in added}
        form = model.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        if not form or made != list(range(256, 256 + len(made))) or set(plain) != set(range(256 + len(made))) or any(len(plain[i]) != 1 for i in range(256)):
            return None
        return tiktoken.Encoding("plain", pat_str=SPLIT, mergeable_ranks={t: i for i, t in plain.items()}, special_tokens={})

    @cached_property
    def library(self):
        from tokenizers import Tokenizer

        out = Tokenizer.from_str(self.spec)
        out.encode_special_tokens = True
        out.no_truncation()
        out.no_padding()
        return out

    @property
    def splits(self) -> bool:
        """Whether a word's ids are its own (the usual split never joins two)."""
        return self.fast is not None

    def ids(self, texts: list[str]) -> list[list[int]]:
        """Ids of a space and each text."""
        plain = lambda t: self.fast is not None and len(t) < LONG_WORD
        return [self.fast.encode_ordinary(" " + t) if plain(t) else self.library.encode(" " + t, add_special_tokens=False).ids for t in texts]


class PieceSide:
    """Ids by a piece model (its bytes), which adds the space itself."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        byte = re.compile("<0x([0-9A-F]{2})>")
        pieces = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        self.spelling = Spelling.of([bytes([int(m[1], 16)]) if (m := byte.fullmatch(p)) else p.replace("▁", " ").encode() for p in pieces])
        #: Whether a word's ids are its own: no piece holds a space after another character.
        self.splits = not any(re.search("[^▁]▁", p) for p in pieces)
        if len(pieces) > 1 << B_BITS:
            raise ValueError(f"B has {len(pieces)} ids; pairs of ids hold {1 << B_BITS}")

    def ids(self, texts: list[str]) -> list[list[int]]:
        return self.library.encode(texts, num_threads=1) if texts else []


#: A space between two characters that are white space to nobody (U+2581 is a
#: space to B): neither tokenizer joins anything across it.
BETWEEN = re.compile(r"(?<=[^\s▁]) (?=[^\s▁])")


#: White space beside a space, and rare white space: such texts are split by ``BETWEEN``.
_BESIDE = tuple(x for c in " \n\t\r" for x in (f" {c}", f"{c} "))
_RARE = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000▁]")


def words_of(text: str) -> list[str]:
    if text[0] == " " or text[-1] == " " or any(x in text for x in _BESIDE) or _RARE.search(text):
        return BETWEEN.split(text)
    return text.split(" ")


class Words:
    """Ids of both sides for words (a text between two ``BETWEEN``), remembered."""

    #: Words remembered between batches.
    MEMORY = 150_000

    def __init__(self, a: ByteSide, b: PieceSide):
        self.sides = (a, b)
        self.split = a.splits and b.splits
        self._clear()

    def _clear(self) -> None:
        self.place: dict[str, int] = {}
        self.flat = [np.zeros(0, np.int32)] * 2
        self.at = [np.zeros(1, np.int64)] * 2

    def _learn(self, words: list[str]) -> None:
        new = list(set(words).difference(self.place))
        if len(self.place) + len(new) > self.MEMORY:
            self._clear()
            new = list(set(words))
        if not new:
            return
        self.place.update(zip(new, range(len(self.place), len(self.place) + len(new)), strict=True))
        for k, side in enumerate(self.sides):
            ids, at = _flat(side.ids(new))
            self.flat[k] = np.concatenate([self.flat[k], ids.astype(np.int32)])
            self.at[k] = np.concatenate([self.at[k], at[1:] + self.at[k][-1]])

    def encode(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per side (ids, offsets of the texts); none for null and empty texts."""
        rows = [[] if not t else words_of(t) if self.split else [t] for t in texts]
        words = list(chain.from_iterable(rows))
        self._learn(words)
        upto = np.concatenate([[0], np.cumsum(np.fromiter(map(len, rows), np.int64, len(rows)))])
        place = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))
        out = []
        for flat, at in zip(self.flat, self.at, strict=True):
            size = at[place + 1] - at[place]
            ends = np.concatenate([[0], np.cumsum(size)])
            out.append((flat[np.repeat(at[place] - ends[:-1], size) + np.arange(ends[-1])].astype(np.int64), ends[upto]))
        return out


def _flat(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    at = np.concatenate([[0], np.cumsum(np.fromiter(map(len, rows), np.int64, len(rows)))])
    return np.fromiter(chain.from_iterable(rows), np.int64, int(at[-1])), at


def lockstep(ends_a: np.ndarray, ends_b: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links (index into A, index into B) of tokens with equal ends, in order.

    Both arrays are strictly increasing. ``marks`` are offsets between which the
    lanes run, each a stretch (marks[i], marks[i + 1]] of ends.
    """
    upto_a, upto_b = np.searchsorted(ends_a, marks, "right"), np.searchsorted(ends_b, marks, "right")
    state = np.stack([upto_a[:-1], upto_b[:-1]])
    stop = np.stack([upto_a[1:], upto_b[1:]])
    out: list[np.ndarray] = []
    while True:
        live = (state < stop).all(0)
        if not live.all():  # finished lanes leave
            state, stop = state[:, live], stop[:, live]
        if not state.shape[1]:
            break
        a, b = ends_a[state[0]], ends_b[state[1]]
        out.append(state[:, a == b])
        state[0] += a <= b
        state[1] += b <= a
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    links = np.concatenate(out, 1)
    links = links[:, np.argsort(links[0], kind="stable")]
    return links[0], links[1]


class Alignment(NamedTuple):
    """Tokens and links of a batch; ``at_*`` are the documents' offsets."""

    a: np.ndarray
    at_a: np.ndarray
    b: np.ndarray
    at_b: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray
    at_links: np.ndarray
    ends: np.ndarray  # byte offset of every link's cut in space + text


class Aligner:
    def __init__(self, spec_a: str, model_b: bytes):
        self.words = Words(ByteSide(spec_a), PieceSide(model_b))

    def align(self, texts: list[str | None]) -> Alignment:
        spelled = [(" " + t).encode() if t else b"" for t in texts]
        base = np.concatenate([[0], np.cumsum(np.fromiter(map(len, spelled), np.int64, len(spelled)))])
        want = np.frombuffer(b"".join(spelled), np.uint8)
        spellings = [side.spelling for side in self.words.sides]
        tokens = self.words.encode(texts)
        bad = np.zeros(len(texts), bool)
        for spelling, (ids, at) in zip(spellings, tokens, strict=True):
            bad |= self._differs(spelling, ids, at, want, base)
        if bad.any():  # their tokens go
            tokens = [(ids[np.repeat(~bad, np.diff(at))], np.concatenate([[0], np.cumsum(np.where(bad, 0, np.diff(at)))])) for ids, at in tokens]
            base = np.concatenate([[0], np.cumsum(np.where(bad, 0, np.diff(base)))])
        (a, at_a), (b, at_b) = tokens
        ends_a, ends_b = np.cumsum(spellings[0].sizes(a)), np.cumsum(spellings[1].sizes(b))
        # every document's end is a mark, and long ones are cut into lanes
        marks = np.unique(np.concatenate([base, np.arange(0, base[-1] + 1, LANE)]))
        link_a, link_b = lockstep(ends_a, ends_b, marks)
        at_links = np.searchsorted(link_a, at_a)
        ends = ends_a[link_a] - np.repeat(base[:-1], np.diff(at_links)) if len(link_a) else np.zeros(0, np.int64)
        return Alignment(a, at_a, b, at_b, link_a, link_b, at_links, ends)

    @staticmethod
    def _differs(spelling: Spelling, ids: np.ndarray, at: np.ndarray, want: np.ndarray, base: np.ndarray) -> np.ndarray:
        """Which documents' tokens do not spell ``want[base[i]:base[i + 1]]``."""
        sizes = spelling.sizes(ids)
        got_at = np.concatenate([[0], np.cumsum(sizes)])[at]
        out = np.diff(got_at) != np.diff(base)
        got = spelling.join(ids, sizes)
        if not out.any():
            wrong = np.flatnonzero(got != want)
            out[np.searchsorted(base, wrong, "right") - 1] = True
            return out
        for i in np.flatnonzero(~out).tolist():
            out[i] = not np.array_equal(got[got_at[i] : got_at[i + 1]], want[base[i] : base[i + 1]])
        return out


#: Decimal digits of every 16-bit number, right-aligned, with a place for a separator.
_DIGITS = np.array([list(f"{i:>5} ".encode()) for i in range(1 << 16)], np.uint8)
_SHOWN = (_DIGITS != 0x20) | (np.arange(6) == 5)
_WIDTH = _SHOWN.sum(1)


def group_digests(got: Alignment) -> list[str]:
    """SHA-256 of ``a1,a2|b1;a3|b2,b3`` of every document; '' without tokens."""
    sizes_a, sizes_b = np.diff(got.link_a, prepend=-1), np.diff(got.link_b, prepend=-1)
    at_a = np.arange(len(got.a)) + np.repeat(got.link_b + 1 - sizes_b, sizes_a)
    at_b = np.arange(len(got.b)) + np.repeat(got.link_a + 1, sizes_b)
    ids = np.empty(len(got.a) + len(got.b), np.int64)
    ids[at_a], ids[at_b] = got.a, got.b
    between = np.full(len(ids), ord(","), np.uint8)
    between[at_a[got.link_a]], between[at_b[got.link_b]] = ord("|"), ord(";")
    shown = _SHOWN[ids]
    table = _DIGITS[ids]
    table[:, 5] = between
    upto = np.concatenate([[0], np.cumsum(_WIDTH[ids])])[got.at_a + got.at_b].tolist()
    data = table[shown].tobytes()
    return [hashlib.sha256(data[lo : hi - 1]).hexdigest() if hi > lo else "" for lo, hi in zip(upto[:-1], upto[1:], strict=True)]


_aligners: dict[int, Aligner] = {}


def aligner(spec_a: str, model_b: bytes) -> Aligner:
    """One a worker process and pair of files."""
    key = hash((spec_a, model_b))
    if key not in _aligners:
        _aligners.clear()
        _aligners[key] = Aligner(spec_a, model_b)
    return _aligners[key]


def read_model(path: str) -> bytes:
    with open(path, "rb") as fh:
        return fh.read()


def _aligned(files, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, Alignment]]:
    """(ids of the documents, their alignment) for bounded runs of rows."""
    tool = aligner(*files.value)
    for batch in batches:
        texts = batch.column(1).to_pylist()
        for lo, hi in blocks(np.array([len(t or "") for t in texts], np.int64), BATCH):
            yield batch.column(0).slice(lo, hi - lo), tool.align(texts[lo:hi])


def _read(docs: DataFrame, path_a: str, path_b: str, doc_id: str, text: str):
    files = ship(docs.sparkSession).sparkContext.broadcast((read_spec(path_a), read_model(path_b)))  # the two files, 2 MB
    return files, docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))


def align_docs(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: the ids of A and B, the links as places in either (from 0),
    and the cuts as byte offsets in space + text."""
    files, rows = _read(docs, path_a, path_b, doc_id, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, got in _aligned(files, batches):
            lists = [(got.a, got.at_a), (got.b, got.at_b)]
            lists += [(got.link_a - np.repeat(got.at_a[:-1], np.diff(got.at_links)), got.at_links), (got.link_b - np.repeat(got.at_b[:-1], np.diff(got.at_links)), got.at_links)]
            cols = [pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(x.astype(np.int32))) for x, at in lists]
            cols.append(pa.ListArray.from_arrays(pa.array(got.at_links.astype(np.int32)), pa.array(got.ends)))
            yield pa.RecordBatch.from_arrays([ids, *cols], ["doc_id", "a_ids", "b_ids", "link_a", "link_b", "cuts"])

    return rows.mapInArrow(run, "doc_id long, a_ids array<int>, b_ids array<int>, link_a array<int>, link_b array<int>, cuts array<long>")


_BLOCK = "block long, doc_id array<long>, n_a array<long>, n_b array<long>, n_links array<long>, n_own array<int>, groups_sha256 array<string>, own array<int>, own_times array<int>, pairs array<int>, times array<long>"


class Part(NamedTuple):
    """What a block keeps of aligned documents: per document its distinct pairs
    of linked ids (``n_own`` of them) and how often it has each."""

    ids: pa.Array
    n_a: np.ndarray
    n_b: np.ndarray
    n_links: np.ndarray
    n_own: np.ndarray
    digests: list[str]
    pairs: np.ndarray
    times: np.ndarray

    @classmethod
    def of(cls, ids: pa.Array, got: Alignment) -> Part:
        n_links = np.diff(got.at_links)
        doc = np.repeat(np.arange(len(n_links)), n_links)
        own, times = np.unique(doc << 31 | got.a[got.link_a] << B_BITS | got.b[got.link_b], return_counts=True)
        n_own = np.bincount(own >> 31, minlength=len(n_links))
        return cls(ids, np.diff(got.at_a), np.diff(got.at_b), n_links, n_own, group_digests(got), (own & ((1 << 31) - 1)).astype(np.int32), times.astype(np.int32))


def _block(number: int, parts: list[Part]) -> pa.RecordBatch:
    of = lambda name: np.concatenate([getattr(p, name) for p in parts])
    pairs, own = np.unique(of("pairs"), return_inverse=True)
    own_times = of("times")
    times = np.bincount(own, own_times, minlength=len(pairs)).astype(np.int64)
    one = lambda values, kind: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))
    cols = [pa.array([number], pa.int64()), one(pa.concat_arrays([p.ids for p in parts]), pa.int64())]
    cols += [one(of(n), pa.int64()) for n in ("n_a", "n_b", "n_links")]
    cols += [one(of("n_own").astype(np.int32), pa.int32()), one([d for p in parts for d in p.digests], pa.string())]
    cols += [one(x.astype(np.int32), pa.int32()) for x in (own, own_times, pairs)] + [one(times, pa.int64())]
    return pa.RecordBatch.from_arrays(cols, ["block", "doc_id", "n_a", "n_b", "n_links", "n_own", "groups_sha256", "own", "own_times", "pairs", "times"])


def doc_blocks(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Blocks of aligned documents: their digests, the distinct pairs of linked
    ids with their counts, and per document its own as places among those."""
    files, rows = _read(docs, path_a, path_b, doc_id, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, parts, links, count = TaskContext.get().partitionId() << 32, [], 0, 0
        for ids, got in _aligned(files, batches):
            parts.append(Part.of(ids, got))
            links, count = links + len(parts[-1].pairs), count + len(ids)
            if links >= BLOCK_LINKS or count >= BLOCK_DOCS:
                yield _block(number, parts)
                number, parts, links, count = number + 1, [], 0, 0
        if parts:
            yield _block(number, parts)

    return rows.mapInArrow(run, _BLOCK)


def pair_counts(held: DataFrame) -> DataFrame:
    """(pair, value): the corpus-wide count of every pair of linked ids, negative
    if it is the highest of its id of B."""
    own = held.select(F.explode(F.arrays_zip("pairs", "times")).alias("x")).select(F.col("x.pairs").alias("pair"), F.col("x.times").alias("n"))
    counts = own.groupBy("pair").agg(F.sum("n").alias("n")).withColumn("b", F.col("pair").bitwiseAND((1 << B_BITS) - 1))
    counts = materialize(counts, "pairs")
    best = counts.groupBy("b").agg(F.max("n").alias("best"))  # at most 2**B_BITS rows
    return counts.join(F.broadcast(best), "b").select("pair", F.when(F.col("n") == F.col("best"), -F.col("n")).otherwise(F.col("n")).alias("value"))


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks with the values of their pairs, as rows of documents."""
    for batch in batches:
        for k in range(batch.num_rows):
            flat = lambda name, k=k: batch.column(name)[k].values
            values = np.asarray(flat("value"), np.int64) if batch.column("value")[k].is_valid else np.zeros(0, np.int64)
            value, times = values[np.asarray(flat("own"), np.int64)], np.asarray(flat("own_times"), np.int64)
            upto = np.concatenate([[0], np.cumsum(np.asarray(flat("n_own"), np.int64))])
            total = lambda x, upto=upto: np.diff(np.concatenate([[0], np.cumsum(x)])[upto])
            cols = [flat("doc_id"), flat("n_a"), flat("n_b"), flat("n_links"), flat("n_links"), pa.array(total(times * (value < 0))), pa.array(total(times * np.abs(value))), flat("groups_sha256")]
            yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(cols, [pa.int64()] * 7 + [pa.string()], strict=True)], _NAMES)


_NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def digest_docs(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    held = materialize(doc_blocks(docs, path_a, path_b, doc_id, text), "aligned")
    asked = held.select("block", F.explode("pairs").alias("pair"))
    answers = asked.join(pair_counts(held), "pair").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("pair", "value"))).alias("known"))
    rows = held.drop("pairs", "times").join(answers, "block", "left").drop("block").withColumn("value", F.col("known.value")).drop("known")
    return rows.mapInArrow(_scored, ", ".join(f"{n} long" for n in _NAMES[:-1]) + ", groups_sha256 string")
