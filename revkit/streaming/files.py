"""Findings for source files that land continuously.

Rules are row-local column expressions, so the batch rule array runs
unchanged on a stream. The sibling-test check (D3) needs the other files of
the repository: it is resolved against a static snapshot of (repo, path)
keys with a stream-static left join, or left out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StringType, StructField, StructType

from revkit.functions.scoring import DEFAULT_ASPECTS
from revkit.operators import aspects as D
from revkit.operators.analyze import LANGS, found_or_error, language_rules, readable, sibling_test_findings, with_language
from revkit.operators.findings import explode_findings, prepare, rule_array
from revkit.sources.files import KNOWN_GLOB, decoded, listed

BINARY_SCHEMA = "path string, modificationTime timestamp, length long, content binary"
FILE_SCHEMA = StructType(
    [StructField("repo", StringType()), StructField("path", StringType()), StructField("content", StringType())]
)


def read_files(spark: SparkSession, path: str, max_files: int | None = None, max_bytes: int | None = None) -> DataFrame:
    """A micro-batch is bounded by ``max_bytes`` of files, or by their number."""
    reader = spark.readStream.schema(FILE_SCHEMA).format("parquet")
    if max_bytes:
        reader = reader.option("maxBytesPerTrigger", max_bytes)
    elif max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def stream_directory(spark: SparkSession, root: str, repo: str = "", max_files: int | None = None, max_bytes: int | None = None) -> DataFrame:
    """A1 as a stream: source files as they land below ``root``, each read once.

    Only names of known languages are listed, so the bytes of others are never
    read; what cannot be read comes with its ``error`` (K9)."""
    reader = spark.readStream.format("binaryFile").schema(BINARY_SCHEMA).option("recursiveFileLookup", "true").option("pathGlobFilter", KNOWN_GLOB)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return decoded(listed(reader.load(root), root, repo), max_bytes)


def findings_stream(files: DataFrame, aspects: Sequence[str] = DEFAULT_ASPECTS, langs: Sequence[str] = LANGS,
                    known_files: DataFrame | None = None) -> DataFrame:
    """Stateless findings per arriving file (append mode)."""
    files = with_language(files)
    rules = D.bundle(aspects) + language_rules(langs)
    prepped, ctx = prepare(files, rules)
    found = explode_findings(prepped, found_or_error(files, rule_array(ctx, rules)))
    d3 = [k + 1 for k, r in enumerate(rules) if r.rule_id == "D3"]
    if known_files is not None and d3:
        # stream-static left anti join against the snapshot of known keys
        found = found.unionByName(sibling_test_findings(readable(files), d3, known=known_files))
    return found
