"""Registered query of the typed findings."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

from revkit.operators import php as G
from revkit.operators import python as H
from revkit.operators import typed as T
from revkit.plans import file_queries as FQ
from revkit.plans.queries import ORACLE, register
from revkit.plans.sqlkit import LANG_SQL, q
from revkit.session import ensure_checkpoint_dir, written
from revkit.sources.files import derived_files


def _typed_sql() -> str:
    plain = "'' AS code, 'unrated' AS severity, CAST(line AS INT) AS line, 0 AS col, recommendation AS message, '' AS snippet"
    own = "CASE " + " ".join(
        f"WHEN rule_id = '{bundle}' AND contains(recommendation, {q(part)}) THEN '{rule}'"
        for bundle, part, rule in (("F5", "Empty catch block suppresses", "F6"), ("F8", "more long string literals", "F9"), ("F10", "Wildcard import", "F11"), ("F15", "Manual closing of", "F16"))
    ) + " ELSE rule_id END"
    rules = "CASE code " + " ".join(f"WHEN '{c}' THEN '{r}'" for c, (r, _) in H.CODES.items()) + " END"
    seq = "CASE type " + " ".join(f"WHEN '{t}' THEN 'G{k}'" for k, t in enumerate(G.TYPES, start=1)) + " END"
    place = r"'^[^\n]*?:[0-9]+:([0-9]+) \[(?:error|warning|info)\] PYL'"
    python = rf"""{rules} AS rule_id, code, regexp_extract(recommendation, '\[(error|warning|info)\] PYL', 1) AS severity, CAST(line AS INT) AS line,
  coalesce(TRY_CAST(regexp_extract(recommendation, {place}, 1) AS INT), 0) AS col, regexp_extract(recommendation, '(?s)\] PYL[0-9]{{3}}: (.*)', 1) AS message, '' AS snippet"""
    parts = [f"SELECT repo, path, {own} AS rule_id, {plain} FROM ({sql}) s{i}" for i, sql in enumerate((FQ.ASPECTS_SQL, FQ.COMMON_SQL, FQ.JAVA_SQL))]
    parts += [f"SELECT repo, path, {seq} AS rule_id, type AS code, severity, line, col, description AS message, snippet FROM ({FQ.PHP_ISSUES_SQL}) p"]
    parts += [f"SELECT repo, path, {python} FROM ({sql}) h{i}" for i, sql in enumerate((FQ.PYTHON_SQL, ORACLE["python_stateful_findings"]))]
    parts += [f"SELECT repo, path, code AS rule_id, {plain} FROM ({sql}) g{i}" for i, sql in enumerate((FQ.GO_SQL, ORACLE["go_block_findings"]))]
    return f"SELECT *, {LANG_SQL} AS lang FROM (" + "\nUNION ALL\n".join(parts) + ") t"


@register("findings", _typed_sql())
def q_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every finding of every file with its rule, code, severity, place,
    message and snippet, from the findings table; its batch is written twice."""
    path = os.path.join(ensure_checkpoint_dir(spark), "findings", uuid.uuid4().hex)
    found = written(T.typed_findings(derived_files(spark, sf_dir)), "typed-findings")  # the rules run once for both
    for _ in range(2):
        T.write_findings(found, path, 0)
    return T.read_findings(spark, path).select("repo", "path", "lang", *T.TYPED)
