"""BPE encoding and decoding by speculate and verify.

For each distinct word, greedy longest match proposes tokens. A proposal is the
true encoding exactly if every adjacent pair of its tokens is *compatible*:
undoing merges at the seam, latest first, never meets a merge across it that
would have been done earlier. That test runs vectorised over all pairs of a
batch; only the words that fail it are merged step by step.

Texts are split in numpy where that is provably what the tokenizer file asks
for (code points under U+0250 without case or composition specials, no
apostrophe clitic, no added token); else by the file's own pattern, or by the
library's normalizer and pre-tokenizer.

Defined results: null text = empty text = no tokens; equal rows give equal rows;
of merges of equal rank the leftmost comes first; a text of any length is encoded
whole, in the memory of one task; an empty table gives no rows; other columns,
whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revkit.llm.common import ship
from revkit.llm.wordhash import blocks, powers

_BASE = 0x9E3779B97F4A7C15 | 5
_INVERSE = pow(_BASE, -1, 1 << 64)
_NEVER = np.int64(1 << 40)
#: Code points below this never change under NFC.
_PLAIN = 0x250
_SPACE, _LETTER, _DIGIT, _OTHER = range(4)
#: White space below U+0250.
_SPACE_POINTS = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0)
#: The clitics that the tokenizer's pattern splits off.
_CLITICS = "'s|'t|'re|'ve|'m|'ll|'d"


def _kind(cp: int) -> int:
    if cp in _SPACE_POINTS:
        return _SPACE
    return {"L": _LETTER, "N": _DIGIT}.get(unicodedata.category(chr(cp))[0], _OTHER)


_KIND = np.array([_kind(c) for c in range(_PLAIN)], np.uint8)
_LOWER = np.array([ord(chr(c).lower()[0]) for c in range(_PLAIN)], np.uint32)
_RANDOM = np.random.default_rng(20240301).integers(1, 1 << 63, int(_LOWER.max()) + 1, dtype=np.uint64) | np.uint64(1)
_VALUES = np.where(_KIND == _SPACE, np.uint64(0), _RANDOM[_LOWER])


def _class(kind: int) -> str:
    return "".join(re.escape(chr(c)) for c in range(_PLAIN) if _KIND[c] == kind)


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class Encoder:
    """Encodes and decodes with one tokenizer file (its JSON text)."""

    #: Distinct words remembered between batches.
    MEMORY = 400_000
    #: Bytes above which a word is merged on its own.
    LONG = 64

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(spec)
        model = json.loads(spec)
        vocab, merges = model["model"]["vocab"], model["model"]["merges"]
        self.suffix = model["model"]["end_of_word_suffix"] or ""
        added = {t["content"]: t["id"] for t in model["added_tokens"]}
        size = max([*vocab.values(), *added.values()]) + 1
        self.tokens = [""] * size
        for token, i in [*vocab.items(), *added.items()]:
            self.tokens[i] = token
        self.added = added
        self.added_pattern = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
        chars = byte_chars()
        self.to_byte = {ord(c): b for b, c in enumerate(chars)}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.rank, self.left, self.right = np.full(size, -1, np.int64), np.zeros(size, np.int64), np.zeros(size, np.int64)
        self.rank[made[::-1]] = np.arange(len(pairs))[::-1]
        self.left[made[::-1]], self.right[made[::-1]] = left[::-1], right[::-1]
        keys = (left << 32) | right
        order = np.argsort(keys, kind="stable")
        #: adjacent pair -> rank of its merge and the id it makes, in one number
        self.keys, self.merges = keys[order], (order.astype(np.int64) << 20) | made[order]
        self.seam = dict(zip(self.keys.tolist(), self.merges.tolist(), strict=True))
        self.inner_byte = np.array([vocab[c] for c in chars], np.int64)
        self.final_byte = np.array([vocab[c + self.suffix] for c in chars], np.int64)
        self._build_trie(vocab)
        self.by_hash: dict[int, bytes] = {}
        self.by_piece: dict[bytes, bytes] = {}
        letters, digits, spaces = _class(_LETTER), _class(_DIGIT), _class(_SPACE)
        self.pattern = re.compile(f"{_CLITICS}|[{letters}]+|[{digits}]|[^{spaces}{letters}{digits}]+")

    def _build_trie(self, vocab: dict[str, int]) -> None:
        """All tokens as byte strings: (node, byte) -> node, and per node the
        token that ends there inside a word and at its end."""
        cut = len(self.suffix)
        step: dict[int, int] = {}
        inner, final = [-1], [-1]
        for token, i in vocab.items():
            at_end = cut and token.endswith(self.suffix)
            node = 0
            for c in token[:-cut] if at_end else token:
                key = node << 8 | self.to_byte[ord(c)]
                if key not in step:
                    step[key] = len(inner)
                    inner.append(-1)
                    final.append(-1)
                node = step[key]
            if at_end or not cut:
                final[node] = i
            if not at_end:
                inner[node] = i
        self.inner, self.final = np.array(inner, np.int64), np.array(final, np.int64)
        order = sorted(step)
        self.step_keys = np.array(order, np.int64)
        self.step_nodes = np.array([step[k] for k in order], np.int64)

    # ------------------------------------------------------------ words

    def _next(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        key = (node << 8) | byte
        where = np.minimum(np.searchsorted(self.step_keys, key), len(self.step_keys) - 1)
        return np.where(self.step_keys[where] == key, self.step_nodes[where], -1)

    def _merge(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a << 32) | b
        where = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[where] == key, self.merges[where], _NEVER)

    def propose(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest match of all words at once, a byte a round:
        (word of every token, its id), in order."""
        who, at, node = np.arange(len(starts)), starts.copy(), np.zeros(len(starts), np.int64)
        best_id, best_end = np.full(len(starts), -1, np.int64), starts.copy()
        out_who, out_id = [], []
        while len(who):
            more = at < stops[who]
            nxt = np.where(more, self._next(node, data[np.minimum(at, len(data) - 1)].astype(np.int64)), -1)
            go = nxt >= 0
            at, node = at + go, np.where(go, nxt, node)
            last = at == stops[who]
            done = go & last & (self.final[node] >= 0)
            found = go & ~last & (self.inner[node] >= 0)
            best_id, best_end = np.where(found, self.inner[node], best_id), np.where(found, at, best_end)
            emit = ~go | (go & last & ~done)
            out_who += [who[done], who[emit]]
            out_id += [self.final[node[done]], best_id[emit]]
            at, node = np.where(emit, best_end, at), np.where(emit, 0, node)
            if done.any():
                left = ~done
                who, at, node, best_id, best_end = who[left], at[left], node[left], best_id[left], best_end[left]
        who, ids = np.concatenate(out_who), np.concatenate(out_id)
        order = np.argsort(who, kind="stable")
        return who[order], ids[order]

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether token b can stand right of token a, for arrays of ids."""
        ok = np.ones(len(a), bool)
        at, limit = np.arange(len(a)), np.full(len(a), _NEVER >> 20)
        while len(at):
            bad = (self._merge(a, b) >> 20) < limit
            ok[at[bad]] = False
            ra, rb = self.rank[a], self.rank[b]
            go = ~bad & ((ra >= 0) | (rb >= 0))
            at, a, b, ra, rb = at[go], a[go], b[go], ra[go], rb[go]
            undo = ra > rb
            limit = np.where(undo, ra, rb + 1)
            a, b = np.where(undo, self.right[a], a), np.where(undo, b, self.left[b])
        return ok

    def merge_exactly(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The merges of every word in order of rank, then place; each round does
        one merge in each word. Same result shape as ``propose``."""
        size = stops - starts
        ends = np.cumsum(size)
        who = np.repeat(np.arange(len(starts)), size)
        data = data[np.arange(int(ends[-1])) + np.repeat(starts - (ends - size), size)]
        ids = self.inner_byte[data]
        ids[ends - 1] = self.final_byte[data[ends - 1]]
        seam = np.full(len(ids), _NEVER)  # of a token with its right neighbour
        same = np.flatnonzero(who[1:] == who[:-1])
        seam[same] = self._merge(ids[same], ids[same + 1])
        out_who, out_id = [], []
        while len(ids):
            head = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]]))
            least = np.minimum.reduceat(seam, head)
            word = np.cumsum(np.concatenate([[0], who[1:] != who[:-1]]))
            open_ = least < _NEVER
            closed = ~open_[word]
            if closed.any():
                out_who.append(who[closed])
                out_id.append(ids[closed])
            hit = np.flatnonzero((seam == least[word]) & ~closed)
            hit = hit[np.concatenate([[True], word[hit[1:]] != word[hit[:-1]]])] if len(hit) else hit
            ids[hit] = seam[hit] & 0xFFFFF
            keep = ~closed
            keep[hit + 1] = False
            at = np.cumsum(keep)[hit] - 1  # where the merged tokens land
            seam[hit] = _NEVER
            who, ids, seam = who[keep], ids[keep], seam[keep]
            for i in (at - 1, at):
                i = i[(i >= 0) & (i + 1 < len(ids))]
                inside = who[i] == who[i + 1]
                i = i[inside]
                seam[i] = self._merge(ids[i], ids[i + 1])
        who, ids = np.concatenate(out_who), np.concatenate(out_id)
        order = np.argsort(who, kind="stable")
        return who[order], ids[order]

    def merge_long(self, word: bytes) -> list[int]:
        """One long word: a heap over a linked list, n log n."""
        ids = [*self.inner_byte[list(word[:-1])].tolist(), int(self.final_byte[word[-1]])] if len(word) > 1 else [int(self.final_byte[word[0]])]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        get = lambda a, b: self.seam.get(a << 32 | b)
        heap = [(m, i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := get(ids[i], ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            m, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = m & 0xFFFFF, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (m := get(ids[i], ids[k])) is not None:
                    heapq.heappush(heap, (m, i, ids[i], ids[k]))
            if (h := before[i]) >= 0 and (m := get(ids[h], ids[i])) is not None:
                heapq.heappush(heap, (m, h, ids[h], ids[i]))
        return [t for t in ids if t >= 0]

    def encode_words(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> list[bytes]:
        """Ids (as little-endian 32-bit bytes) of the words data[starts:stops]."""
        out = [b""] * len(starts)
        short = np.flatnonzero(stops - starts <= self.LONG)
        if len(short):
            lo, hi = starts[short], stops[short]
            who, ids = self.propose(data, lo, hi)
            seams = np.flatnonzero(who[1:] == who[:-1])
            pairs, which = np.unique((ids[seams] << 32) | ids[seams + 1], return_inverse=True)
            ok = self.compatible(pairs >> 32, pairs & 0xFFFFFFFF)[which]
            failed = np.unique(who[seams[~ok]])
            if len(failed):
                good = np.ones(len(short), bool)
                good[failed] = False
                who2, ids2 = self.merge_exactly(data, lo[failed], hi[failed])
                who, ids = np.concatenate([who[good[who]], failed[who2]]), np.concatenate([ids[good[who]], ids2])
                order = np.argsort(who, kind="stable")
                who, ids = who[order], ids[order]
            blob = ids.astype("<u4").tobytes()
            cuts = (np.searchsorted(who, np.arange(len(short) + 1)) * 4).tolist()
            for k, i in enumerate(short.tolist()):
                out[i] = blob[cuts[k] : cuts[k + 1]]
        for i in np.flatnonzero(stops - starts > self.LONG).tolist():
            out[i] = np.array(self.merge_long(data[starts[i] : stops[i]].tobytes()), "<u4").tobytes()
        return out

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ends = np.cumsum(size)
        return self.encode_words(np.frombuffer(b"".join(pieces), np.uint8), ends - size, ends)

    # ------------------------------------------------------------ texts

    def _by_pieces(self, text: str) -> bytes:
        """One text by the pattern or by the library's own splitting."""
        out: list[bytes] = []
        at = 0
        spans = [(m.start(), m.end()) for m in self.added_pattern.finditer(text)] if self.added_pattern else []
        for lo, hi in [*spans, (len(text), len(text))]:
            part = text[at:lo]
            if part and ord(max(part)) < _PLAIN and "İ" not in part:
                pieces = [p.encode() for p in self.pattern.findall(part.lower())]
            elif part:
                shown = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part))
                pieces = [p.translate(self.to_byte).encode("latin-1") for p, _ in shown]
            else:
                pieces = []
            new = list({p for p in pieces if p not in self.by_piece})
            if len(self.by_piece) + len(new) > self.MEMORY:
                self.by_piece.clear()
                new = list(set(pieces))
            self.by_piece.update(zip(new, self.encode_pieces(new), strict=True))
            out += [self.by_piece[p] for p in pieces]
            if hi > lo:
                out.append(np.array([self.added[text[lo:hi]]], "<u4").tobytes())
            at = hi
        return b"".join(out)

    def _in_bulk(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, token offsets of the texts, texts that need the other way)."""
        joined = "\n".join(texts) + "\n"
        cps = np.frombuffer(joined.encode("utf-32-le"), "<u4")
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        ends = np.cumsum(sizes)
        odd = (cps >= _PLAIN) | (cps == 0x130)
        # an apostrophe before a letter may be a clitic, "<|" an added token
        odd[:-1] |= ((cps[:-1] == 0x27) & (cps[1:] > 0x40)) | ((cps[:-1] == 0x3C) & (cps[1:] == 0x7C))
        hard = np.logical_or.reduceat(odd, ends - sizes)
        if hard.any():
            cps = np.where(np.repeat(hard, sizes), np.uint32(0x20), cps)
        kind = _KIND[cps]
        edge = np.empty(len(cps), bool)
        edge[0] = True
        edge[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        bounds = np.flatnonzero(edge)
        real = kind[bounds] != _SPACE
        starts, stops = bounds[real], np.append(bounds[1:], len(cps))[real]
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64), hard
        hashes = np.add.reduceat(_VALUES[cps] * powers(_BASE, len(cps)), starts) * powers(_INVERSE, len(cps))[starts]
        codes, distinct = pd.factorize(hashes)
        first = np.empty(len(distinct), np.int64)
        first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
        keys = distinct.tolist()
        if len(self.by_hash) > self.MEMORY:
            self.by_hash.clear()
        missing = [k for k, h in enumerate(keys) if h not in self.by_hash]
        if missing:
            low = _LOWER[cps]
            lowered = np.frombuffer(low.astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)
            upto = np.concatenate([[0], np.cumsum(1 + (low > 0x7F).astype(np.int64) + (low > 0x7FF))])
            some = first[missing]
            self.by_hash.update(zip((keys[k] for k in missing), self.encode_words(lowered, upto[starts[some]], upto[stops[some]]), strict=True))
        parts = [self.by_hash[h] for h in keys]
        size = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        flat = np.frombuffer(b"".join(parts), "<u4")
        begin = np.cumsum(size) - size
        count = size[codes]
        upto = np.cumsum(count)
        ids = flat[np.repeat(begin[codes] - (upto - count), count) + np.arange(upto[-1])]
        words_before = np.searchsorted(starts, np.concatenate([[0], ends]))
        return ids, np.concatenate([[0], upto])[words_before], hard

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text."""
        texts = [t or "" for t in texts]
        if not texts:
            return []
        ids, at, hard = self._in_bulk(texts)
        return [np.frombuffer(self._by_pieces(t), "<u4") if h else ids[at[i] : at[i + 1]] for i, (t, h) in enumerate(zip(texts, hard.tolist(), strict=True))]

    def decode(self, ids: np.ndarray) -> str:
        """The tokens joined by one space, special ones too (the file has no decoder)."""
        return " ".join([self.tokens[i] for i in ids.tolist()])


_encoders: dict[int, Encoder] = {}


def encoder(spec: str) -> Encoder:
    """One encoder a worker process and tokenizer file."""
    key = hash(spec)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(spec)
    return _encoders[key]


def read_spec(path: str) -> str:
    with open(path, encoding="utf-8") as fh:
        return fh.read()


def encoded(spec: str, texts: pa.Array) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, ids of each text) for blocks of a column's rows."""
    enc = encoder(spec)
    texts = texts.to_pylist()
    for lo, hi in blocks(np.array([len(t or "") for t in texts], np.int64)):
        yield lo, enc.encode(texts[lo:hi])


def encode_docs(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", decoded: bool = False) -> DataFrame:
    """Per document: doc_id, ids, and on demand the decoded text."""
    spec = ship(docs.sparkSession).sparkContext.broadcast(read_spec(path))  # under 2 MB, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, ids in encoded(spec.value, batch.column(1)):
                cols = [batch.column(0).slice(lo, len(ids)), pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))]
                if decoded:
                    enc = encoder(spec.value)
                    cols.append(pa.array([enc.decode(x) for x in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "ids", "decoded"][: len(cols)])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>" + ", decoded string" * decoded)


def digest_docs(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, n_tokens, and the SHA-256 of the ids (decimal,
    joined by one space) and of the text decoded from them."""
    spec = ship(docs.sparkSession).sparkContext.broadcast(read_spec(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, ids in encoded(spec.value, batch.column(1)):
                enc = encoder(spec.value)
                shown = [hashlib.sha256(" ".join(map(str, x.tolist())).encode()).hexdigest() for x in ids]
                back = [hashlib.sha256(enc.decode(x).encode()).hexdigest() for x in ids]
                cols = [batch.column(0).slice(lo, len(ids)), pa.array(list(map(len, ids)), pa.int64()), pa.array(shown), pa.array(back)]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
