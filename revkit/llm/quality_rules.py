"""Quality rules (native) with risk-controlled thresholds.

``metrics`` counts per document (words, symbols, repeated lines, repeated
8-word windows, capitals, marks). Each rule is a ratio with a fixed grid of
cutoffs, from lenient to strict. On the labelled holdout every cutoff is tested
per stratum: with n good documents of which k would be rejected, the exact
binomial tail P(Bin(n, alpha / rules) <= k) must not exceed the error budget
``delta`` divided by all strata and rules (Bonferroni). Cutoffs of one rule are
tested in the fixed order lenient -> strict and testing stops at the first that
fails, which needs no further correction. So with probability 1 - delta, in no
stratum are more than ``alpha`` of the good documents rejected by the rules.

Defined results: null or empty text has no words and fails the base rule; null
or unlisted languages form the stratum "other"; a stratum with too few labels
certifies no cutoff and keeps what passes the base rule; repeated label rows
count once, as good only if all say so; window equality is by 64-bit hashes of
the words; repeated rows are judged alike; a ratio equal to a cutoff passes; a text
of any length is counted whole, in one row; an empty table gives no rows; other
columns, whatever their names, pass through ``keep_good``.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revkit.llm.common import WS, materialize, with_new

WINDOW = 8
STRATA = ("en", "de", "fr", "es")
OTHER = "other"
#: Share of good documents that may be rejected per stratum, and the chance of exceeding it.
ALPHA, DELTA = 0.02, 0.05

#: rule -> (numerator, denominator, cutoffs lenient -> strict); rejected when numerator / denominator > cutoff.
GRID = tuple(x / 100 for x in (95, 80, 60, 50, 40, 30, 25, 20, 15, 12, 10, 8, 6, 5, 4, 3, 2))
RULES = {
    "symbols": ("n_symbols", "word_chars", GRID),
    "dup_lines": ("n_dup_lines", "n_lines", GRID),
    "repeats": ("n_repeat_words", "n_words", GRID),
    "capitals": ("n_upper", "word_chars", GRID),
    "marks": ("n_marks", "word_chars", GRID),
}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, whatever rule of the
    optimizer moves or repeats the expression."""
    return F.get(F.transform(F.array(value), body), 0)


def _kept_chars(text: Column, chars: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{chars}]+", "")).cast("long")


def _words(text: Column) -> Column:
    """The words of a text, in order (white space at either end leaves an empty part)."""

    def inner(p: Column) -> Column:
        head = F.when(F.get(p, 0) == "", 1).otherwise(0)
        tail = F.when((F.size(p) > 1) & (F.get(p, F.size(p) - 1) == ""), 1).otherwise(0)
        return F.slice(p, head + 1, F.size(p) - head - tail)

    return let(F.split(text, f"[{WS}]+", -1), inner)


def _repeated(words: Column) -> Column:
    """How many words lie in a window of ``WINDOW`` words that occurs twice or more."""

    def places(windows: Column) -> Column:
        ranked = F.sort_array(F.transform(windows, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def again(r: Column) -> Column:
            same = lambda x, j: F.coalesce(F.get(r, j)["h"] == x["h"], F.lit(False))
            return F.filter(r, lambda x, j: same(x, j + 1) | F.when(j > 0, same(x, j - 1)).otherwise(False))

        return F.sort_array(F.transform(let(ranked, again), lambda x: x["i"]))

    def covered(at: Column) -> Column:
        step = F.transform(at, lambda v, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - v, F.lit(WINDOW))))
        return F.aggregate(step, F.lit(0), lambda a, x: a + x)

    def count(h: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(WINDOW)]))
        # only rows with a repeated window sort theirs, to find where the repeats are
        found = lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), 0).otherwise(let(places(w), covered))
        return F.when(F.size(h) < WINDOW, 0).otherwise(let(windows, found))

    return let(F.transform(words, lambda w: F.xxhash64(w)), count).cast("long")


def metrics(text: Column) -> Column:
    """The counts of one text as a struct (row-local, nothing is shuffled)."""

    def counts(b: Column) -> Column:
        lines = F.filter(F.split(b, "\n", -1), lambda s: s.rlike(f"[^{WS}]"))
        line_counts = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")))
        word_counts = let(
            _words(b),
            lambda w: F.struct(F.size(w).cast("long").alias("n"), F.length(F.array_join(w, "")).cast("long").alias("chars"), _repeated(w).alias("rep")),
        )
        both = F.struct(word_counts.alias("w"), line_counts.alias("l"))
        return let(
            both,
            lambda v: F.struct(
                v["w"]["n"].alias("n_words"),
                v["w"]["chars"].alias("word_chars"),
                _kept_chars(b, "#*$%&|<>").alias("n_symbols"),
                v["l"]["dup"].alias("n_dup_lines"),
                v["w"]["rep"].alias("n_repeat_words"),
                v["l"]["n"].alias("n_lines"),
                _kept_chars(b, "A-Z").alias("n_upper"),
                _kept_chars(b, "!?").alias("n_marks"),
            ),
        )

    return let(F.coalesce(text, F.lit("")), counts)


def base_failed(m: Column) -> Column:
    return (m["n_words"] < 20) | (100 * m["n_repeat_words"] > 30 * m["n_words"])


def stratum(lang: Column) -> Column:
    return F.when(lang.isin(*STRATA), lang).otherwise(F.lit(OTHER))


def first_exceeded(rule: str, m: Column) -> Column:
    """Index of the first cutoff of the rule's grid that the document exceeds
    (the grid's length if none; cutoffs fall, so it exceeds all later ones)."""
    top, bottom, grid = RULES[rule]
    return F.size(F.filter(F.array(*[F.lit(float(x)) for x in grid]), lambda x: (m[bottom] <= 0) | (m[top] <= x * m[bottom])))


def exceeds(rule: str, cutoff: float, m: Column) -> Column:
    """The rule's ratio is over the cutoff (no denominator: never)."""
    top, bottom, _ = RULES[rule]
    return (m[bottom] > 0) & (m[top] > F.lit(cutoff) * m[bottom])


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), summed term by term in logarithms."""
    ratio = math.log(p) - math.log1p(-p)
    first = n * F.lit(math.log1p(-p))
    start = F.struct(first.alias("term"), F.exp(first).alias("total"))

    def add(acc: Column, i: Column) -> Column:
        term = acc["term"] + F.log((n - i + 1).cast("double")) - F.log(i.cast("double")) + F.lit(ratio)
        return F.struct(term.alias("term"), (acc["total"] + F.exp(term)).alias("total"))

    steps = F.when(k < 1, F.array().cast("array<bigint>")).otherwise(F.sequence(F.lit(1).cast("long"), k))
    return F.aggregate(steps, start, add, lambda acc: acc["total"])


def counted(docs: DataFrame, text: str = "text", lang: str = "lang") -> tuple[DataFrame, str, str]:
    """``docs`` with the counts and the stratum, written once to the shared
    folder: they are read twice, to choose the cutoffs and to apply them."""
    df, n = with_new(docs, counts=metrics(F.col(text)), stratum=stratum(F.col(lang)))
    return materialize(df, "counts"), n["counts"], n["stratum"]


def holdout_counts(counted: DataFrame, labels: DataFrame, doc_id: str, counts: str, part: str) -> DataFrame:
    """Per stratum, rule and cutoff (step): n good labelled documents that pass
    the base rule, and k of them that the cutoff rejects."""
    good = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1").select("doc_id")
    m = F.col(counts)
    firsts = F.array(*[F.struct(F.lit(rule).alias("rule"), first_exceeded(rule, m).alias("first")) for rule in RULES])
    held = counted.where(~base_failed(m)).select(F.col(doc_id).alias("doc_id"), F.col(part).alias("stratum"), firsts.alias("firsts"))
    tally = held.join(good, "doc_id").select("stratum", F.explode("firsts").alias("f")).groupBy("stratum", "f.rule", "f.first").count()
    # at most (strata + 1) * rules * (cutoffs + 1) rows from here on
    by_rule = tally.groupBy("stratum", "rule").agg(F.sum("count").alias("n"), F.collect_list(F.struct("first", "count")).alias("hits"))
    steps = F.explode(F.sequence(F.lit(0), F.lit(len(GRID) - 1))).alias("step")
    over = F.aggregate("hits", F.lit(0).cast("long"), lambda a, x: a + F.when(x["first"] <= F.col("step"), x["count"]).otherwise(0))
    return by_rule.select("stratum", "rule", "n", "hits", steps).select("stratum", "rule", "n", "step", over.alias("k"))


def certified(cells: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Per stratum and rule the strictest step that passes together with all more lenient ones."""
    share, level = alpha / len(RULES), delta / (len(RULES) * (len(STRATA) + 1))
    limit = F.ceil(F.col("n") * share).cast("long")  # beyond the mean the tail is over any level
    tail = F.when(F.col("k") > limit, F.lit(1.0)).otherwise(binomial_tail(F.col("k"), F.col("n"), share))
    w = Window.partitionBy("stratum", "rule").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    passing = cells.withColumn("worst", F.max(tail).over(w)).where(F.col("worst") <= level)
    return passing.groupBy("stratum", "rule").agg(F.max("step").alias("step"))


def cutoffs(counted: DataFrame, labels: DataFrame, doc_id: str, counts: str, part: str) -> dict[tuple[str, str], float]:
    """The certified cutoffs: at most (strata + 1) * rules values."""
    rows = certified(holdout_counts(counted, labels, doc_id, counts, part)).collect()
    return {(r["stratum"], r["rule"]): float(RULES[r["rule"]][2][r["step"]]) for r in rows}


def rejected(found: dict[tuple[str, str], float], part: Column, m: Column) -> Column:
    """Some certified cutoff of the row's stratum is exceeded."""
    out = F.lit(False)
    for (name, rule), x in sorted(found.items()):
        out = out | ((part == name) & exceeds(rule, x, m))
    return out


def judge(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Per document: doc_id, the counts, ``base_failed`` and ``kept``."""
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    df, n = with_new(slim, counts=metrics(F.col("text")), stratum=stratum(F.col("lang")))
    rows = materialize(df.drop("text", "lang"), "counts")
    m, part = F.col(n["counts"]), F.col(n["stratum"])
    found = cutoffs(rows, labels, "doc_id", n["counts"], n["stratum"])
    failed = base_failed(m)
    return rows.select("doc_id", f"{n['counts']}.*", failed.alias("base_failed"), (~failed & ~rejected(found, part, m)).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns."""
    rows, counts, part = counted(docs, text, lang)
    m = F.col(counts)
    found = cutoffs(rows, labels, doc_id, counts, part)
    return rows.where(~base_failed(m) & ~rejected(found, F.col(part), m)).select(*docs.columns)
