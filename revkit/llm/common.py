"""Shared helpers of the training-data operators.

Text conventions used by every operator: a null text counts as the empty
text, a *word* is a maximal run of characters other than space and
U+0009..U+000D, and whole texts are read (no prefixes).
"""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

import revkit
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from revkit.session import ensure_checkpoint_dir

#: The white space that separates words.
WS = r"\x20\x09-\x0D"
#: Bytes of one Arrow batch between Spark and Python.
BATCH_BYTES = 16 << 20


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name under the cluster's shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/revkit-{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut and
    the rows survive the loss of any executor."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, column: str, buckets: int) -> DataFrame:
    """Write ``df`` to the shared folder as a table bucketed by ``column``: a
    join on it needs no shuffle of these rows."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    table = f"{name}_{path.rsplit('-', 1)[-1]}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY (`{column}`) INTO {buckets} BUCKETS LOCATION '{path}'")
    df.write.mode("append").insertInto(table)
    spark.catalog.refreshTable(table)
    return spark.table(table)


def ship(spark: SparkSession) -> SparkSession:
    """Give the executors' Python this package, once a context (a cluster's
    machines need no copy of it)."""
    # whole texts of any length in bounded batches
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    sc = spark.sparkContext
    if not getattr(sc, "_revkit_shipped", False):
        root = os.path.dirname(os.path.dirname(os.path.abspath(revkit.__file__)))
        base = os.path.join(tempfile.mkdtemp(prefix="revkit-ship-"), "revkit")
        sc.addPyFile(shutil.make_archive(base, "zip", root, "revkit"))
        sc._revkit_shipped = True
    return spark


def text_or_empty(col: Column | str = "text") -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def with_new(df: DataFrame, **cols: Column) -> tuple[DataFrame, dict[str, str]]:
    """Add columns under names that clash with none of ``df``'s; returns the
    frame and the name given to each."""
    taken = {c.lower() for c in df.columns}
    names = {}
    for key in cols:
        name = f"_{key}"
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        names[key] = name
    return df.withColumns({names[k]: v for k, v in cols.items()}), names
