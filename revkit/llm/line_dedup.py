"""Line dedup by site-relative frequency.

Per host, the pages that contain a line are divided by the host's pages; a line
above the ratio (on enough pages) is boilerplate and goes from the host's
pages. Lines are counted as 64-bit hashes with map-side combine, so neither a
host nor a line with a third of all rows reaches one task; the lines to drop
come back to the pages as hashes only, by a join that adaptive execution can
split, and each page is filtered on its own in one pass.

``lines_of`` turns HTML into lines, each character read once by each pattern (very
long pages and unclosed tags too): comments, scripts and styles go, block
tags end a line, other tags go, and blank lines are left out. Tag names count
in any case of letters.

Defined results: null html has no lines and an empty text; a page whose url has
no host keeps all its lines; every row counts as a page, repeated rows too, and
equal rows get equal results; a line on exactly the share stays; a page of any
length is read in one pass, by one task; an empty table gives no rows; other
columns, whatever their names, are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revkit.llm.common import materialize, ship

#: A line on more than this share of a host's pages is boilerplate, if it is on MIN_PAGES at least.
RATIO, MIN_PAGES = 0.3, 3

#: Tags that end a line.
BLOCK_TAGS = "address|article|aside|blockquote|br|div|dd|dl|dt|footer|form|h1|h2|h3|h4|h5|h6|header|hr|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul"
DROPPED = r"(?s)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"
BREAKS = rf"\n|</?(?:{BLOCK_TAGS})\b[^>]*>"
TAGS = r"<[^>]*>"
#: Before a pattern (in SQL too): names of tags in upper, lower or mixed case (A-Z).
ANY_CASE = "(?i)"
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)"


def host_of(url: Column) -> Column:
    """Lower-case host name, null if there is none."""
    host = F.lower(F.regexp_extract(url, HOST, 1))
    return F.when(host != "", host)


_OPENING = re.compile(r"<!--|<script\b|<style\b", re.I | re.A)
_CLOSING = {"<!": re.compile("-->"), "<sc": re.compile(r"</script\s*>", re.I | re.A), "<st": re.compile(r"</style\s*>", re.I | re.A)}
_BREAKS, _TAGS = re.compile(BREAKS, re.I | re.A), re.compile(TAGS)
_BLANK = " \t\n\x0b\x0c\r"


def without_dropped(html: str) -> str:
    """``html`` without what ``DROPPED`` matches, in one pass: an opening without an
    end stays, and so do all later ones of its kind."""
    out, at, found, dead = [], 0, _OPENING.search(html), set()
    while found:
        kind = found[0][:2] if found[0][1] == "!" else found[0][:3].lower()
        end = None if kind in dead else _CLOSING[kind].search(html, found.end())
        if end:
            out.append(html[at : found.start()])
            at = end.end()
        else:
            dead.add(kind)
        found = _OPENING.search(html, end.end() if end else found.start() + 1)
    return "".join(out) + html[at:] if at else html


def _untagged(line: str) -> str:
    last = line.rfind(">") + 1  # no tag ends behind it
    return _TAGS.sub("", line[:last]) + line[last:] if last else line


def lines_of(html: str | None) -> list[str]:
    """The lines of a page: each pattern reads every character once."""
    text = without_dropped(html or "")
    last = text.rfind(">") + 1
    lines = _BREAKS.split(text[:last])
    rest = text[last:].split("\n")
    lines[-1] += rest[0]
    trimmed = (_untagged(x).strip(_BLANK) for x in lines + rest[1:])
    return [x for x in trimmed if x]


def _page_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lines = pa.array([lines_of(t) for t in batch.column(2).to_pylist()], pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lines], ["page_id", "host", "lines"])


def hashes(lines: Column) -> Column:
    return F.transform(lines, lambda s: F.xxhash64(s))


def boilerplate(pages: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, line) of ``pages`` (host, marks: line hashes) over the ratio."""
    totals = pages.where("host IS NOT NULL").groupBy("host").agg(F.count("*").alias("pages"))
    seen = pages.where("host IS NOT NULL").select("host", F.explode(F.array_distinct("marks")).alias("line"))
    counts = seen.groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    return counts.join(totals, "host").where(F.col("n") > ratio * F.col("pages")).select("host", "line")


def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        page, host, lines, marks, drop = (batch.column(i) for i in range(5))
        total, gone, texts = [], [], []
        for own, hashed, bad in zip(lines.to_pylist(), marks.to_pylist(), drop.to_pylist(), strict=True):
            bad = frozenset(bad or ())
            kept = [s for s, h in zip(own, hashed, strict=True) if h not in bad]
            total.append(len(own))
            gone.append(len(own) - len(kept))
            texts.append("\n".join(kept))
        yield pa.RecordBatch.from_arrays([page, host, pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(texts, pa.string())], ["page_id", "host", "n_lines", "n_dropped", "text"])


def dedup_lines(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """Per page: page_id, host, n_lines, n_dropped, and the text of the lines kept."""
    ship(pages.sparkSession)
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), host_of(F.col(url)).alias("host"), F.col(html).alias("html"))
    rows = rows.mapInArrow(_page_lines, "page_id long, host string, lines array<string>")
    rows = materialize(rows.withColumn("marks", hashes(F.col("lines"))), "lines")
    bad = materialize(boilerplate(rows.select("host", "marks"), ratio, min_pages), "boilerplate")
    # what a page drops depends on its host and lines alone: that pair is the key
    key = F.xxhash64("host", "marks")
    held = rows.select(key.alias("key"), "host", F.explode(F.array_distinct("marks")).alias("line")).join(bad, ["host", "line"], "left_semi")
    drops = materialize(held.distinct().groupBy("host", "key").agg(F.collect_list("line").alias("drop")), "drops")
    out = rows.withColumn("key", key).join(drops, ["host", "key"], "left")
    return out.select("page_id", "host", "lines", "marks", "drop").mapInArrow(_strip, "page_id long, host string, n_lines long, n_dropped long, text string")
