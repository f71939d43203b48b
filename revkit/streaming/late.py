"""P5: late rows put aside and counted.

Each micro-batch is compared with the watermark that the batches before it set
(the latest event time so far less the delay) and written once, by batch and
``late``: rows behind the watermark go to a partition of their own, the others
are what the keyed streams read. Nothing is dropped. The last thing written of a
batch is its mark; a batch without one is written again over its partitions, a
batch with one is left as it is.
"""

from __future__ import annotations

import datetime as dt
import os
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

_MARK = "latest timestamp"


def _marks(spark: SparkSession, path: str, batch: int) -> DataFrame | None:
    """The mark of a batch (one row: the latest event time up to it)."""
    try:
        return spark.read.schema(_MARK).parquet(os.path.join(path, f"marks/batch={batch}"))
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e.getCondition()):
            raise
        return None


def _latest(spark: SparkSession, path: str, batch: int) -> dt.datetime | None:
    """The latest event time of the batches before this one."""
    marks = _marks(spark, path, batch - 1) if batch else None
    row = marks.first() if marks is not None else None
    return row[0] if row else None


def split_late(path: str, delay: dt.timedelta, ts: str = "ts") -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: rows under ``path``/rows by (batch, late). A row
    without an event time is on time."""

    def write(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        if _marks(spark, path, batch) is not None:
            return
        latest = _latest(spark, path, batch)
        late = F.coalesce(F.col(ts) <= F.lit(latest - delay), F.lit(False)) if latest else F.lit(False)
        split = rows.withColumns({"batch": F.lit(int(batch)).cast("long"), "late": late})
        split.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "late").parquet(os.path.join(path, "rows"))
        held = spark.read.schema(table_schema(rows.schema)).parquet(os.path.join(path, "rows"))
        mark = held.where(F.col("batch") == batch).agg(F.max(ts).alias("latest"))
        floor = F.lit(latest).cast("timestamp")
        mark.select(F.greatest("latest", floor).alias("latest")).coalesce(1).write.mode("overwrite").parquet(os.path.join(path, f"marks/batch={batch}"))

    return write


def table_schema(rows: StructType) -> StructType:
    return StructType([*rows.fields, StructField("batch", LongType()), StructField("late", BooleanType())])


def on_time(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The rows that were not late, as a stream."""
    return spark.readStream.schema(table_schema(schema)).parquet(os.path.join(path, "rows")).where("NOT late").drop("batch", "late")


def split_table(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """All rows with ``batch`` and ``late``; counts by batch come from here."""
    return spark.read.schema(table_schema(schema)).parquet(os.path.join(path, "rows"))


def late_counts(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """(batch, rows, late_rows)."""
    return split_table(spark, path, schema).groupBy("batch").agg(F.count(F.lit(1)).alias("rows"), F.count_if("late").alias("late_rows"))
