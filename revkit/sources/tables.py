"""Input tables: the given parquet tables and the corpora derived from them.

The raw tables hold prose, so code-shaped corpora are derived from them by SQL
that runs unchanged in Spark and DuckDB (see FIXTURES.md section 2): every
``documents`` row becomes one source file, every ``conversations`` turn one
review comment. Nothing is sampled; the corpora grow with the tables.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

_SQL_DIR = os.path.join(os.path.dirname(__file__), "sql")


def _sql(name: str) -> str:
    with open(os.path.join(_SQL_DIR, name), encoding="utf-8") as fh:
        return fh.read().strip()


SOURCE_FILES_SQL = _sql("source_files.sql")
REVIEW_COMMENTS_SQL = _sql("review_comments.sql")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def register(spark: SparkSession, sf_dir: str, names=("documents", "conversations")) -> None:
    """Expose the given tables as temp views under their own names."""
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


def _derived(spark: SparkSession, sf_dir: str, table_name: str, sql: str) -> DataFrame:
    """The SQL over the table's files as they are now."""
    table(spark, sf_dir, table_name).createOrReplaceTempView(table_name)
    return spark.sql(sql)


def source_files_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo, path, content) derived from ``documents``."""
    return _derived(spark, sf_dir, "documents", SOURCE_FILES_SQL)


def review_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(review_id, channel_id, ts, message) derived from ``conversations``."""
    return _derived(spark, sf_dir, "conversations", REVIEW_COMMENTS_SQL)
