"""Personal data: candidate spans judged by boosted trees, redacted above calibrated thresholds.

The base patterns (e-mail, IPv4, card, phone) always count. Beside them
high-recall generators propose further, overlapping spans of the same four
kinds (spelled-out or spaced addresses, other separators, numbers without a
plus sign). Boosted trees score each proposal by its format and its context.

Training needs no hand labels: in a bounded sample of documents each base span
is written anew in forms that the base patterns miss (positive), and with
broken check digits, parts or lengths (negative). A proposal that the text has
of itself is negative only if it cannot be what it is proposed as (check digit,
octets, host, number of digits); one that has the form of a rewritten span may
be personal data and gets no label, so what is found does not fall with the
amount of it that a corpus hides. The sample is drawn by hashes: of the document, and of the proposal
within it, so neither the order of the table nor a document with very many
spans decides what it holds. All documents that the model was not fitted on
calibrate, per kind, the lowest threshold whose proposals include at most
``FALSE_SHARE`` negatives (upper confidence bound): their proposals are counted
by kind, score and label where they lie. A kind without such a threshold adds
nothing. Accepted spans never overlap base spans or one another (best first).

All scans are linear in the text: addresses grow outwards from each "@", and
numbers are only looked for where a run of digits begins.

Defined results: null text has no spans and stays null when redacted; empty
tables give no rows; repeated rows are treated alike; of overlapping proposals the
higher score wins, then the one proposed first; a text of any length is read
whole, by one task; other columns, whatever their names, pass through untouched.
"""

from __future__ import annotations

import bisect
import hashlib
import heapq
import itertools
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revkit.llm import boosting
from revkit.llm.common import materialize, ship

KINDS = ("email", "ip", "card", "phone")
#: Documents of the training sample and proposals that the model is fitted on
#: (both expected), and most proposals of one document among them.
SAMPLE_DOCS, SAMPLE_SPANS, DOC_SPANS = 6000, 40_000, 64
#: Places of the documents' hash, bins of the scores (a power of two, so that their edges are exact), and proposals scored at once.
PLACES, BINS, CHUNK = 1 << 30, 1 << 12, 4096
#: Most negatives, as a share of what a threshold accepts, with this many standard errors.
FALSE_SHARE, ERRORS = 0.02, 1.645

Span = tuple[int, int, int]  # kind, start, end (code points, end exclusive)

# The base patterns.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGITS = re.compile(r"[0-9]+")

# The generators' wider patterns, tried where a run of digits begins or around an address sign.
_WIDE_IP = re.compile(r"([0-9]{1,3}) ?[.,:_-] ?([0-9]{1,3}) ?[.,:_-] ?([0-9]{1,3}) ?[.,:_-] ?([0-9]{1,3})(?![0-9])")
_WIDE_CARD = re.compile(r"[0-9](?:[ ./_-]{0,2}[0-9]){11,18}(?![0-9])")
_WIDE_PHONE = re.compile(r"(?:00)?[0-9]{1,4}[ ()./-]{1,3}(?:[0-9]{2,5}[ ()./-]{1,3}){1,4}[0-9]{2,5}(?![0-9])|00[0-9]{8,13}(?![0-9])")
_SIGN = re.compile(r" ?(?:\(at\)|\[at\]|\{at\}|<at>| at |@) ?", re.IGNORECASE)
_SPELLED = re.compile(r"[A-Za-z0-9-]{1,63}(?: ?(?:\(dot\)|\[dot\]|\{dot\}| dot |\.) ?[A-Za-z0-9-]{1,63}){1,4}", re.IGNORECASE)
#: Words that speak for a kind when near.
_CUES = (
    re.compile(r"mail|contact|write|address|reach", re.IGNORECASE),
    re.compile(r"\bip\b|host|server|addr|ping|network", re.IGNORECASE),
    re.compile(r"card|visa|credit|debit|payment|account", re.IGNORECASE),
    re.compile(r"phone|call|tel|fax|mobile|dial", re.IGNORECASE),
)
_CONTEXT = 32


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i & 1:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def _only_digits(s: str) -> str:
    return "".join(_DIGITS.findall(s))


def base_spans(text: str) -> list[Span]:
    """The base patterns' matches, leftmost and non-overlapping per kind, by kind and start."""
    out: list[Span] = []
    end, at = 0, text.find("@")
    while at >= 0:
        if m := _DOMAIN.match(text, at + 1):
            lo = at
            while lo > end and text[lo - 1] in _LOCAL:
                lo -= 1
            if lo < at:
                out.append((0, lo, m.end()))
                end = m.end()
        at = text.find("@", max(at + 1, end))
    runs = [m.start() for m in _DIGITS.finditer(text)]
    end = 0
    for i in runs:
        if i >= end and (m := _IP.match(text, i)):
            end = m.end()
            if all(map(_octet, m.groups())):
                out.append((1, i, end))
    end = 0
    for i in runs:
        if i >= end and (m := _CARD.match(text, i)):
            end = m.end()
            digits = _only_digits(m[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((2, i, end))
    if runs and "+" in text:
        out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_only_digits(m[0])) <= 15]
    return out


def proposals(text: str) -> list[Span]:
    """High-recall candidates of all kinds; they may overlap."""
    out: list[Span] = []
    if "@" in text or "at" in text or "AT" in text:
        for m in _SIGN.finditer(text):
            lo = m.start()
            floor = max(0, lo - 64)
            while lo > floor and text[lo - 1] in _LOCAL:
                lo -= 1
            if lo < m.start() and (d := _SPELLED.match(text, m.end())):
                out.append((0, lo, d.end()))
    for m in _DIGITS.finditer(text):
        for kind, pattern in ((1, _WIDE_IP), (2, _WIDE_CARD), (3, _WIDE_PHONE)):
            if w := pattern.match(text, m.start()):
                lo = m.start()
                if kind == 3 and lo and text[lo - 1] in "+(":
                    lo -= 1
                out.append((kind, lo, w.end()))
    return out


N_FEATURES = 22


def features(text: str, span: Span) -> list[float]:
    kind, lo, hi = span
    body = text[lo:hi]
    before, after = text[max(0, lo - _CONTEXT) : lo], text[hi : hi + _CONTEXT]
    runs = _DIGITS.findall(body)
    digits = "".join(runs)
    seps = [c for c in body if not c.isalnum()]
    near = lambda c: 0 if not c else 1 if c.isspace() else 2 if c.isalpha() else 3 if c.isdigit() else 4
    dots = [p for p in re.split(r"[^A-Za-z0-9-]+", body) if p]
    return [
        kind,
        hi - lo,
        len(digits),
        len(runs),
        max(map(len, runs), default=0),
        min(map(len, runs), default=0),
        luhn(digits) if 13 <= len(digits) <= 19 else -1,
        sum(len(r) < 4 and int(r) <= 255 for r in runs if len(r) < 10),
        len(seps),
        len(set(seps)),
        "@" in body,
        body.count("."),
        sum(c in "()[]" for c in body),
        body[:2] == "00" or body[:1] in "+(",
        near(before[-1:]),
        near(after[:1]),
        near(after[1:2]),
        sum(c.isdigit() for c in before),
        sum(c.isdigit() for c in after),
        len(dots[-1]) if kind == 0 and dots else 0,
        bool(_CUES[kind].search(before)),
        " at " in body.lower() or "at)" in body.lower() or "at]" in body.lower(),
    ]


#: Suffixes of host names (all country codes, and common generic ones).
_SUFFIXES = frozenset(
    """
    ac ad ae af ag ai al am ao aq ar as at au aw ax az ba bb bd be bf bg bh bi bj bm bn bo br bs bt bw by bz ca cc cd cf cg ch ci ck cl cm cn co cr cu cv cw cx cy cz
    de dj dk dm do dz ec ee eg er es et eu fi fj fk fm fo fr ga gd ge gf gg gh gi gl gm gn gp gq gr gs gt gu gw gy hk hm hn hr ht hu id ie il im in io iq ir is it je jm jo jp
    ke kg kh ki km kn kp kr kw ky kz la lb lc li lk lr ls lt lu lv ly ma mc md me mg mh mk ml mm mn mo mp mq mr ms mt mu mv mw mx my mz na nc ne nf ng ni nl no np nr nu nz
    om pa pe pf pg ph pk pl pm pn pr ps pt pw py qa re ro rs ru rw sa sb sc sd se sg sh si sk sl sm sn so sr ss st su sv sx sy sz tc td tf tg th tj tk tl tm tn to tr tt tv tw tz
    ua ug uk us uy uz va vc ve vg vi vn vu wf ws ye yt za zm zw
    com org net edu gov mil int arpa info biz name pro aero asia cat coop jobs mobi museum post tel travel example test invalid local
    agency app art bank blog center church city cloud club company design dev digital eco email expert family finance foundation fun global group health help host
    institute land law legal life link live love ltd media network news ngo online page press school science shop site social software solutions space store studio
    support systems team tech today tools top university vip web website wiki work works world xyz zone
    """.split()
)
#: Labels of a host: joined by a point without spaces, or by a spelled or spaced one.
_JOINT = re.compile(r" ?(?:\(dot\)|\[dot\]|\{dot\}| dot ) ?| \. |\.(?! )", re.IGNORECASE)
_DATE = re.compile(r"(?:19|20)[0-9]{2}[ ./-](?:0?[1-9]|1[0-2])[ ./-](?:0?[1-9]|[12][0-9]|3[01])(?![0-9])|(?:0?[1-9]|[12][0-9]|3[01])[ ./-](?:0?[1-9]|[12][0-9]|3[01])[ ./-](?:19|20)[0-9]{2}(?![0-9])")


def plausible(kind: int, body: str) -> bool:
    """The proposal has the form of a rewritten span: it may be what it is proposed as."""
    digits = _only_digits(body)
    if kind == 0:
        sign = _SIGN.search(body)
        labels = _JOINT.split(body[sign.end() :]) if sign else []
        # more words may follow a host: some label after the first is a suffix, and all before are whole labels
        return any(x.lower() in _SUFFIXES and all(re.fullmatch("[A-Za-z0-9-]+", y) for y in labels[:i]) for i, x in enumerate(labels) if i)
    if kind == 1:
        between = re.findall("[^0-9]+", body)
        return all(map(_octet, _DIGITS.findall(body))) and len(set(between)) == 1 and ":" not in body and len(between[0]) != 2
    if kind == 2:
        return 13 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15 and not _DATE.match(body.lstrip("+("))


def _variants(kind: int, body: str, rng: np.random.Generator) -> list[tuple[str, int]]:
    """Other ways to write a base span (label 1), and broken ones (label 0)."""
    digits = _only_digits(body)
    if kind == 0:
        name, _, host = body.partition("@")
        spelled = [f"{name} at {host}", f"{name}(at){host}", f"{name} [at] {host.replace('.', ' [dot] ')}", f"{name} @ {host}"]
        return [(spelled[rng.integers(4)], 1), (f"{name} at {name}. {host[:3]}", 0), (f"meet at {host[:3]}.", 0)]
    if kind == 1:
        parts = re.findall("[0-9]+", body)
        big = [str(300 + int(rng.integers(600))), *parts[1:]]
        return [("-".join(parts), 1), (" . ".join(parts), 1), (".".join(big), 0), (":".join(f"{int(p) % 60:02d}" for p in parts), 0)]
    if kind == 2:
        groups = [digits[i : i + 4] for i in range(0, len(digits), 4)]
        broken = digits[:-1] + str((int(digits[-1]) + 1 + int(rng.integers(8))) % 10)
        shown = [broken[i : i + 4] for i in range(0, len(broken), 4)]
        return [(".".join(groups), 1), ("  ".join(groups), 1), ("/".join(groups), 1), (broken, 0), (".".join(shown), 0), ("  ".join(shown), 0), (digits[:12], 0)]
    groups = re.findall("[0-9]+", body)
    return [("00" + " ".join(groups), 1), ("(" + groups[0] + ") " + "-".join(groups[1:]), 1), ("00" + "".join(groups), 1), ("/".join(g[:2] for g in groups), 0), (" ".join(groups[:2]), 0), (".".join(groups[:3]), 0)]


def examples(text: str, seed: int) -> Iterator[tuple[int, list[float]]]:
    """(label, features) of the training proposals of one document."""
    rng = np.random.default_rng(seed)
    base = base_spans(text)
    for kind, lo, hi in base:
        for body, label in _variants(kind, text[lo:hi], rng):
            changed = text[max(0, lo - 80) : lo] + body + text[hi : hi + 80]
            at = min(lo, 80)
            for span in proposals(changed):
                if span[1] < at + len(body) and span[2] > at:
                    # a positive must be the whole span, in its own kind
                    whole = span[0] == kind and span[1] <= at and span[2] >= at + len(body)
                    # what reaches into the text around is no longer the constructed form alone
                    inside = span[1] >= at and span[2] <= at + len(body)
                    if label and whole or inside or not plausible(span[0], changed[span[1] : span[2]]):
                        yield int(label and whole), features(changed, span)
    taken = _Taken(base)
    yield from ((0, features(text, s)) for s in proposals(text) if taken.free(s) and not plausible(s[0], text[s[1] : s[2]]))


def _draw(place: int, i: int) -> int:
    """The place of a document's i-th proposal in the order by which proposals are drawn."""
    return int.from_bytes(hashlib.blake2b(f"{place}:{i}".encode(), digest_size=4).digest(), "big") >> 2


class _Taken:
    """Spans that may not be overlapped, as disjoint intervals in order."""

    def __init__(self, spans: list[Span]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for lo, hi in sorted((lo, hi) for _, lo, hi in spans):
            if self.ends and lo < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], hi)
            else:
                self.starts.append(lo)
                self.ends.append(hi)

    def free(self, span: Span) -> bool:
        i = bisect.bisect_left(self.starts, span[2])
        return not i or self.ends[i - 1] <= span[1]

    def add(self, span: Span) -> None:
        """``span`` must be free."""
        i = bisect.bisect_left(self.starts, span[1])
        self.starts.insert(i, span[1])
        self.ends.insert(i, span[2])


@dataclass
class Detector:
    model: boosting.Boosted | None
    thresholds: list[float]  # by kind; over 1: adds nothing

    def spans(self, texts: list[str | None]) -> list[tuple[list[Span], list[Span]]]:
        """Per text: the base spans, and those that the model adds, by kind and start."""
        texts = [t or "" for t in texts]
        base = [base_spans(t) for t in texts]
        added: list[list[Span]] = [[] for _ in texts]
        if self.model is None:
            return list(zip(base, added, strict=True))
        found = [(i, s) for i, t in enumerate(texts) for s in self._open(t, base[i])]
        if found:
            score = self.model.score(np.array([features(texts[i], s) for i, s in found], float))
            order = np.argsort(-score, kind="stable")
            taken = {i: _Taken(base[i]) for i, _ in found}
            for k in order.tolist():
                i, s = found[k]
                if score[k] >= self.thresholds[s[0]] and taken[i].free(s):
                    taken[i].add(s)
                    added[i].append(s)
        return [(b, sorted(a)) for b, a in zip(base, added, strict=True)]

    def _open(self, text: str, base: list[Span]) -> list[Span]:
        got = proposals(text)
        if got:
            taken = _Taken(base)
            got = [s for s in got if taken.free(s)]
        return got


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sample_docs: int = SAMPLE_DOCS, sample_spans: int = SAMPLE_SPANS) -> Detector:
    """Fit on a sample of about ``sample_docs`` of the documents with an address
    sign or two digits in a row, drawn by a hash of id and text (two thirds of
    them), and of about ``sample_spans`` of their proposals, drawn by a hash of
    document and proposal; calibrate on all the other documents, those without such
    signs too."""
    none = Detector(None, [2.0] * len(KINDS))
    likely = F.coalesce(F.col("text").rlike("@|[0-9][0-9]"), F.lit(False))
    docs = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    total = docs.where(likely).count()
    docs = docs.select(F.pmod(F.xxhash64("id", "text"), F.lit(PLACES)).alias("place"), "text")
    place = F.col("place")
    fitted = likely & (place < int(PLACES * min(1.0, sample_docs / max(total, 1)))) & (F.shiftright(place, 3) % 3 != 0)
    ship(docs.sparkSession)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = heapq.nsmallest(DOC_SPANS, ((_draw(p, i), i, y, x) for i, (y, x) in enumerate(examples(t or "", p))), key=lambda r: r[:2])
                columns = [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int32()), pa.array([[float(v) for v in r[3]] for r in rows], pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, ["draw", "label", "x"])

    drawn = materialize(docs.where(fitted).mapInArrow(draw, "draw long, label int, x array<double>"), "examples")
    cut = int(PLACES * min(1.0, sample_spans / max(drawn.count(), 1)))
    rows = sorted((r["draw"], r["label"], tuple(r["x"])) for r in drawn.where(F.col("draw") < cut).collect())
    if len({r[1] for r in rows}) < 2:
        return none
    model = boosting.fit(np.array([r[2] for r in rows]), np.array([r[1] for r in rows], float))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = (e for p, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for e in examples(t or "", p))
            cells: Counter[tuple[int, int, int]] = Counter()
            for part in itertools.batched(found, CHUNK):
                x = np.array([f for _, f in part], float)
                cells.update(zip(x[:, 0].astype(int).tolist(), _bin(model.score(x)).tolist(), [y for y, _ in part], strict=True))
            columns = [pa.array([c[i] for c in cells], pa.int32()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(list(cells.values()), pa.int64())], ["kind", "bin", "label", "n"])

    held = docs.where(~fitted).mapInArrow(tally, "kind int, bin int, label int, n long")
    # at most kinds * (bins + 1) * 2 rows
    counts = np.zeros((len(KINDS), BINS + 1, 2), np.int64)
    for r in held.groupBy("kind", "bin", "label").agg(F.sum("n").alias("n")).collect():
        counts[r["kind"], r["bin"], r["label"]] = r["n"]
    return Detector(model, [_lowest(c) for c in counts])


def _bin(score: np.ndarray) -> np.ndarray:
    return np.floor(score * BINS).astype(int)


def _lowest(counts: np.ndarray) -> float:
    """The lowest score from which on the accepted share of negatives is surely
    small; ``counts`` has the (negatives, positives) of each bin of scores."""
    total = counts[::-1].cumsum(0)
    n = np.maximum(total.sum(1), 1)
    share = (total[:, 0] + ERRORS**2 / 2) / (n + ERRORS**2)  # Wilson's upper bound
    upper = share + ERRORS * np.sqrt(share * (1 - share) / (n + ERRORS**2))
    good = np.flatnonzero((upper <= FALSE_SHARE) & (counts[::-1].sum(1) > 0))
    return (BINS - int(good[-1])) / BINS if len(good) else 2.0


def _threshold(score: np.ndarray, y: np.ndarray) -> float:
    """``_lowest`` of given scores and labels."""
    counts = np.zeros((BINS + 1, 2), np.int64)
    np.add.at(counts, (_bin(score), y.astype(int)), 1)
    return _lowest(counts)


def shown(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{lo}:{hi}" for k, lo, hi in spans)


def detect(docs: DataFrame, detector: Detector, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, the base spans counted by kind, their digest, and all spans."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = detector.spans(batch.column(1).to_pylist())
            counts = [pa.array([sum(s[0] == k for s in base) for base, _ in got], pa.int64()) for k in range(len(KINDS))]
            digest = [hashlib.sha256(shown(base).encode()).hexdigest() for base, _ in got]
            spans = [shown(sorted(base + added)) for base, added in got]
            added = [len(a) for _, a in got]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *counts, pa.array(digest, pa.string()), pa.array(spans, pa.string()), pa.array(added, pa.int64())],
                ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"],
            )

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each span, or run of overlapping spans, replaced by its kind."""
    out, at = [], 0
    for lo, hi, kind in sorted((lo, hi, k) for k, lo, hi in spans):
        if lo >= at:
            out += [text[at:lo], f"[{KINDS[kind].upper()}]"]
        at = max(at, hi)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, detector: Detector, text: str = "text") -> DataFrame:
    """``docs`` with the spans of its text column replaced; all rows and columns stay."""
    ship(docs.sparkSession)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            new = [t if t is None else redacted(t, base + added) for t, (base, added) in zip(texts, detector.spans(texts), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if i == at else batch.column(i) for i in range(batch.num_columns)], schema=batch.schema.set(at, pa.field(text, pa.string())))

    return docs.mapInArrow(run, docs.schema)
