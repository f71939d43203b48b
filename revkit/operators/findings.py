"""Rule registry and the single-explode findings builder.

A rule turns one file row into an array of finding structs
``(line INT, col INT, msg STRING, key STRING)`` using column expressions only.
All rules of a run are concatenated into one array per file and exploded
once, so ``content`` is scanned once and never shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from revkit.functions import text as T

FINDING = StructType(
    [
        StructField("line", IntegerType()),
        StructField("col", IntegerType()),
        StructField("msg", StringType()),
        StructField("key", StringType()),
    ]
)
TAGGED = StructType(
    [
        StructField("rule_id", StringType()),
        StructField("rule_seq", IntegerType()),
        StructField("occ", IntegerType()),
        StructField("line", IntegerType()),
        StructField("col", IntegerType()),
        StructField("msg", StringType()),
        StructField("key", StringType()),
    ]
)


@dataclass
class Ctx:
    """Columns a rule may use. ``lines`` is the in-row array of lines."""

    path: Column
    content: Column
    lang: Column
    lines: Column
    extra: dict[str, Column] = field(default_factory=dict)
    #: the prep columns of rules whose names another rule took first
    own: dict[Rule, dict[str, str]] = field(default_factory=dict)

    def of(self, rule: Rule) -> Ctx:
        """What this rule sees: under each of its prep names its own column."""
        mine = {name: F.col(column) for name, column in self.own.get(rule, {}).items()}
        return replace(self, extra=self.extra | mine) if mine else self


@dataclass(frozen=True)
class Rule:
    rule_id: str
    build: Callable[[Ctx], Column]
    langs: tuple[str, ...] = ()  # empty = every language
    # per-file columns computed once in a projection before the rules run
    # (an expensive array used by several expressions is not re-evaluated);
    # a name is the rule's own: rules that share one share the column only if
    # they share the function
    prep: tuple[tuple[str, Callable[[Ctx], Column]], ...] = ()


def empty() -> Column:
    return F.array().cast(ArrayType(FINDING))


def finding(line: Column | int, msg: Column, col: Column | int = 0, key: Column | None = None) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(
        lit(line).cast("int").alias("line"),
        lit(col).cast("int").alias("col"),
        msg.cast("string").alias("msg"),
        (key if key is not None else F.lit(None)).cast("string").alias("key"),
    )


def one_if(pred: Column, line: Column | int, msg: Column, key: Column | None = None) -> Column:
    """File-level rule: at most one finding."""
    return F.when(pred, F.array(finding(line, msg, key=key))).otherwise(empty())


def per_line(ctx: Ctx, pred: Callable[[Column, Column], Column], msg: Callable[[Column, Column], Column],
             col: Callable[[Column, Column], Column] | None = None) -> Column:
    """Line rule over the in-row lines array; ``i`` is the 0-based index."""
    hits = F.transform(
        ctx.lines,
        lambda l, i: F.when(pred(l, i), finding(i + 1, msg(l, i + 1), col(l, i) if col else 0)),
    )
    return F.filter(hits, lambda x: x.isNotNull())


def per_match(content: Column, go_pattern: str, msg: Callable[[Column, list[Column]], Column],
              groups: Sequence[int] = (), keep: Callable[[Column, list[Column]], Column] | None = None) -> Column:
    """Content-level rule: one finding per regex match (OCC + C4).

    ``msg(line, [group texts])`` renders; groups come from regexp_extract_all
    in match order, zipped with the match lines. One search up to the first match
    spares a file without any the passes that locate and cut out matches.
    """
    arrays = [T.match_lines(content, go_pattern)] + [T.extract_all(content, go_pattern, g) for g in groups]
    names = ["ln"] + [f"g{g}" for g in groups]
    zipped = F.arrays_zip(*[a.alias(n) for a, n in zip(arrays, names)])
    out = F.transform(
        zipped,
        lambda z: F.when(
            keep(z["ln"], [z[f"g{g}"] for g in groups]) if keep else F.lit(True),
            finding(z["ln"], msg(z["ln"], [z[f"g{g}"] for g in groups])),
        ),
    )
    found = F.filter(out, lambda x: x.isNotNull()) if keep else out
    return F.when(~T.rlike(content, go_pattern), empty()).otherwise(found)


def regex_rule(rule_id: str, go_pattern: str, message: str, langs: tuple[str, ...] = (), scope: str = "content") -> Rule:
    """Q1: a user rule from one RE2 pattern; every match becomes
    '{path}:{line}: {message}'. ``scope='line'`` matches line by line (one
    finding per matching line), ``'content'`` the whole text (every match)."""
    from revkit.functions.text import rlike

    def loc(ctx: Ctx, line: Column) -> Column:
        return F.concat(ctx.path, F.lit(":"), line.cast("string"), F.lit(": " + message))

    if scope == "line":
        return Rule(rule_id, lambda c: per_line(c, lambda l, i: rlike(l, go_pattern), lambda l, n: loc(c, n)), langs)
    return Rule(rule_id, lambda c: per_match(c.content, go_pattern, lambda ln, g: loc(c, ln)), langs)


def _tag(rule: Rule, seq: int, arr: Column) -> Column:
    return F.transform(
        arr,
        lambda x, k: F.struct(
            F.lit(rule.rule_id).alias("rule_id"),
            F.lit(seq).alias("rule_seq"),
            (k + 1).alias("occ"),
            x["line"].alias("line"),
            x["col"].alias("col"),
            x["msg"].alias("msg"),
            x["key"].alias("key"),
        ),
    )


# Built rule expressions, reused across queries of one process. A rule's
# expression reads only fixed column names (path, content, lang, _lines and
# its prep columns), so the same unresolved Column serves every plan. The key
# holds the building function itself: rules that share an id stay apart.
_BUILT: dict[tuple, Column] = {}


def _built(kind: str, fn: Callable, langs: tuple[str, ...], make: Callable[[], Column], columns: dict[str, str] | None = None) -> Column:
    """``columns``: the columns that stand for the rule's prep names, where they differ."""
    from pyspark import SparkContext

    sc = SparkContext._active_spark_context
    k = (sc, kind, fn, langs, tuple(sorted((columns or {}).items())))
    if k not in _BUILT:
        _BUILT[k] = make()
    return _BUILT[k]


def rule_array(ctx: Ctx, rules: Sequence[Rule], seq_base: int = 0) -> Column:
    """All findings of the rules for one file, in rule order then match order."""
    parts = []
    for k, r in enumerate(rules):
        arr = _tag(r, seq_base + k + 1, _built("rule", r.build, r.langs, lambda r=r: r.build(ctx.of(r)), ctx.own.get(r)))
        if r.langs:
            arr = F.when(ctx.lang.isin(*r.langs), arr).otherwise(F.array().cast(ArrayType(TAGGED)))
        parts.append(arr)
    if not parts:
        return F.array().cast(ArrayType(TAGGED))
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def context(files: DataFrame, path_col: str = "path") -> Ctx:
    return Ctx(path=F.col(path_col), content=F.col("content"), lang=F.col("lang"), lines=T.lines(F.col("content")))


def prepare(files: DataFrame, rules: Sequence[Rule]) -> tuple[DataFrame, Ctx]:
    """Add the lines array and each rule's prep columns, in declaration order.

    Every prep column gets its own projection, so a later prep (or a rule)
    reads an earlier one as a plain column: the optimizer keeps an expensive
    column that is read several times as one computed value per row."""
    files = files.select("*", T.lines(F.col("content")).alias("_lines"))
    ctx = context(files)
    ctx.lines = F.col("_lines")
    taken: dict[str, Callable] = {}  # column -> the function that fills it
    for r in rules:
        for name, fn in r.prep:
            column, k = name, 1
            while taken.get(column, fn) is not fn:  # another rule's column of that name
                column, k = f"{name}__{k}", k + 1
            if column != name:
                ctx.own.setdefault(r, {})[name] = column
            if column in taken:
                continue

            def make(fn=fn, r=r):
                expr = fn(ctx.of(r))
                return F.when(ctx.lang.isin(*r.langs), expr) if r.langs else expr

            expr = _built("prep", fn, r.langs, make, ctx.own.get(r))
            files = files.select("*", expr.alias(column))
            ctx.extra.setdefault(name, F.col(name))
            taken[column] = fn
    return files, ctx


def explode_findings(files: DataFrame, arr: Column, keep: Sequence[str] = ("repo", "path", "lang")) -> DataFrame:
    """One explode: (keep..., rule_id, rule_seq, occ, line, col, msg, key)."""
    return files.select(*keep, F.explode(arr).alias("f")).select(*keep, "f.*")


def batch_rule(files: DataFrame, rule_id: str, find: Callable[[pd.DataFrame], pd.DataFrame], keep: Sequence[str] = ("repo", "path", "lang")) -> DataFrame:
    """Q1/Q4: a user's analyzer over Arrow batches of files, for what column
    expressions do not say. ``find`` gets (*keep, content) of a batch and returns
    (*keep, line, col, msg); the result has the columns of ``run_rules``, so the
    two are unioned (O1). Files are read where they are: nothing is shuffled."""
    schema = ", ".join([*(f"`{c}` {files.schema[c].dataType.simpleString()}" for c in keep), "line int, col int, msg string, occ int"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = find(batch)
            yield found.assign(occ=found.groupby(list(keep), dropna=False).cumcount() + 1)[[*keep, "line", "col", "msg", "occ"]]

    found = files.select(*keep, "content").mapInPandas(run, schema)
    return found.select(*keep, F.lit(rule_id).alias("rule_id"), F.lit(0).alias("rule_seq"), "occ", "line", "col", "msg", F.lit(None).cast("string").alias("key"))


def run_rules(files: DataFrame, rules: Sequence[Rule], keep: Sequence[str] = ("repo", "path", "lang")) -> DataFrame:
    files, ctx = prepare(files, rules)
    return explode_findings(files, rule_array(ctx, rules), keep)
