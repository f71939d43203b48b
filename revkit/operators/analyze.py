"""Analyse a files table into findings and per-file recommendations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revkit.functions.paths import language
from revkit.operators import aspects as D
from revkit.operators.findings import Rule, explode_findings, prepare, rule_array
from revkit.operators.metrics import UNREAD
from revkit.functions.scoring import DEFAULT_ASPECTS

LANGS = ("go", "php", "python", "java")


def with_language(files: DataFrame) -> DataFrame:
    """B1/B2: add ``lang`` and keep known languages only."""
    out = files if "lang" in files.columns else files.withColumn("lang", language(F.col("path")))
    return out.where(F.col("lang") != "unknown")


def language_rules(langs: Sequence[str] = LANGS) -> list[Rule]:
    from revkit.operators import common, golang, java, php, python

    out: list[Rule] = []
    if "java" in langs:
        out += [Rule(r.rule_id, r.build, ("java",)) for r in common.rules()] + java.rules()
    if "php" in langs:
        out += php.rules()
    if "python" in langs:
        out += python.rules()
    if "go" in langs:
        out += golang.rules()
    return out


def sibling_test_findings(files: DataFrame, seqs: Sequence[int], known: DataFrame | None = None) -> DataFrame:
    """D3 + M1: 'Create unit tests for {f}' for files whose lower-cased path
    lacks 'test' and whose sibling test file is not in the same repository.

    Reads (repo, path, lang) only; the left anti join runs on small key rows,
    never on file content or on the other findings. ``known`` is the key set
    to look siblings up in (default: ``files`` itself; a static snapshot for
    a stream)."""
    known = (known if known is not None else files).select(F.col("repo").alias("sib_repo"), F.col("path").alias("sib"))
    cand = (
        files.select("repo", "path", "lang")
        .where(~F.contains(F.lower(F.col("path")), F.lit("test")))
        .withColumn("tp", D.test_path(F.col("path")))
    )
    cond = (F.col("repo") == F.col("sib_repo")) & (F.col("tp") == F.col("sib")) & (F.col("tp") != F.col("path"))
    kept = cand.join(known, cond, "left_anti")
    return kept.select(
        "repo", "path", "lang", F.lit("D3").alias("rule_id"), F.explode(F.array(*[F.lit(s) for s in seqs])).alias("rule_seq"),
        F.lit(1).alias("occ"), F.lit(0).alias("line"), F.lit(0).alias("col"),
        F.concat(F.lit("Create unit tests for "), F.col("path")).alias("msg"), F.lit(None).cast("string").alias("key"),
    )


def analyze(files: DataFrame, aspects: Sequence[str] = DEFAULT_ASPECTS, langs: Sequence[str] = LANGS,
            with_aspects: bool = True) -> DataFrame:
    """Findings for every file: aspect bundles first, then language rules.

    Columns: repo, path, lang, rule_id, rule_seq, occ, line, col, msg, key. A
    file whose ``error`` (if there is such a column) is not null yields that one
    row, under the rule id ``K9``.
    """
    files = with_language(files)
    rules = (D.bundle(aspects) if with_aspects else []) + language_rules(langs)
    prepped, ctx = prepare(files, rules)
    found = explode_findings(prepped, found_or_error(files, rule_array(ctx, rules)))
    d3 = [k + 1 for k, r in enumerate(rules) if r.rule_id == "D3"]
    if d3:
        found = found.unionByName(sibling_test_findings(readable(files), d3, known=files))
    return found


def readable(files: DataFrame) -> DataFrame:
    return files.where("error IS NULL") if "error" in files.columns else files


def found_or_error(files: DataFrame, arr: Column) -> Column:
    """K9: the rules' findings, or the error of a file that could not be read."""
    if "error" not in files.columns:
        return arr
    row = F.struct(
        F.lit(UNREAD).alias("rule_id"), F.lit(0).alias("rule_seq"), F.lit(1).alias("occ"), F.lit(0).alias("line"), F.lit(0).alias("col"),
        F.col("error").alias("msg"), F.lit(None).cast("string").alias("key"),
    )
    return F.when(F.col("error").isNotNull(), F.array(row)).otherwise(arr)
