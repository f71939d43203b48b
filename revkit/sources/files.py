"""Source-file tables: directory scan (A1, A2), files-as-table (A3),
location manifest (A6) and the derived test corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revkit.functions.paths import EXTENSIONS, display_path, language
from revkit.sources import tables


def files_from_table(df: DataFrame) -> DataFrame:
    """A3: any (repo, path, content) table -> files with ``lang``."""
    return df.select("repo", "path", language(F.col("path")).alias("lang"), "content")


def derived_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source-file corpus derived from ``documents`` (one file per row)."""
    return files_from_table(tables.source_files_raw(spark, sf_dir))


def _any_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" for c in word)


#: Names that ``language`` knows, for a listing (in any case of letters).
KNOWN_GLOB = "*.{" + ",".join(_any_case(e) for e in EXTENSIONS) + "}"


def listed(raw: DataFrame, root: str, repo: str = "") -> DataFrame:
    """``binaryFile`` rows -> (repo, path below ``root``, length, content)."""
    root_uri = root if root.startswith("file:") or "://" in root else "file:" + root
    return raw.select(F.lit(repo).alias("repo"), display_path(F.col("path"), root_uri.rstrip("/")).alias("path"), "length", "content")


def decoded(raw: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """K9: (repo, path, length, content BINARY) -> files (repo, path, lang, content)
    with the ``error`` of those that are too long or not UTF-8 (their content is
    empty); both kinds reach the report. ``max_bytes`` is tested on the listing's
    length, before the content."""
    text = F.col("content").cast("string")
    shown = lambda why: F.concat(F.lit("error reading file "), F.col("path"), F.lit(": "), why)
    long_ = F.col("length") > max_bytes if max_bytes is not None else F.lit(False)
    size = F.concat(F.col("length").cast("string"), F.lit(f" bytes, more than {max_bytes}"))
    error = F.when(long_, shown(size)).when(~F.coalesce(F.is_valid_utf8(text), F.lit(False)), shown(F.lit("not valid UTF-8")))
    rows = raw.select("repo", "path", language(F.col("path")).alias("lang"), F.when(~long_, text).alias("text"), error.alias("error"))
    return rows.select("repo", "path", "lang", F.when(F.col("error").isNull(), F.col("text")).otherwise(F.lit("")).alias("content"), "error")


def scan_directory(spark: SparkSession, root: str, repo: str = "", glob: str | None = None,
                   known_only: bool = True) -> DataFrame:
    """A1: every file below ``root`` as (repo, path, lang, content).

    ``binaryFile`` keeps bytes exact (no line splitting); content is decoded
    as UTF-8 with invalid bytes shown as U+FFFD. ``glob`` narrows the listing
    (A2 uses '*.[pP][hH][pP]'); by default only files of known languages are
    listed, so no other file's bytes are read."""
    out = listed(_binary(spark, root, glob or (KNOWN_GLOB if known_only else None)), root, repo)
    out = out.select("repo", "path", language(F.col("path")).alias("lang"), F.make_valid_utf8(F.col("content").cast("string")).alias("content"))
    return out.where(F.col("lang") != "unknown") if known_only else out


def scan_readable(spark: SparkSession, root: str, repo: str = "", max_bytes: int | None = None) -> DataFrame:
    """A1 + K9: the files of known languages below ``root``, with the ``error`` of
    those that cannot be read."""
    return decoded(listed(_binary(spark, root, KNOWN_GLOB), root, repo), max_bytes)


def _binary(spark: SparkSession, root: str, glob: str | None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(root)


def write_files(files: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A3 sink: parquet partitioned by language, so rule runs prune by lang."""
    files.write.mode(mode).partitionBy("lang").parquet(path)
