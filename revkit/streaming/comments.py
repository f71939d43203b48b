"""Review comments as a stream.

Each operator is the batch expression of the same name applied to a
streaming DataFrame; sinks take their checkpoint folder under the shared
``spark.checkpoint.dir``.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType, TimestampType

from revkit.operators import reviews
from revkit.session import ensure_checkpoint_dir

COMMENT_SCHEMA = StructType(
    [
        StructField("review_id", LongType()),
        StructField("channel_id", StringType()),
        StructField("ts", TimestampType()),
        StructField("message", StringType()),
    ]
)


def read_comments(spark: SparkSession, path: str, fmt: str = "parquet", max_files: int | None = None, max_bytes: int | None = None) -> DataFrame:
    """Comments landing as files (parquet or JSON lines) under ``path``; a
    micro-batch is bounded by ``max_bytes`` of files, or by their number."""
    reader = spark.readStream.schema(COMMENT_SCHEMA).format(fmt)
    if max_bytes:
        reader = reader.option("maxBytesPerTrigger", max_bytes)
    elif max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def score_stream(comments: DataFrame) -> DataFrame:
    """Stateless scoring of every arriving comment (append mode)."""
    return reviews.gate(reviews.score_comments(comments))


def deduplicate(comments: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """P5: drop repeated review ids that arrive within the watermark delay."""
    return comments.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["review_id"])


def request_counts(comments: DataFrame, key: str = "channel_id", ts: str = "ts", window: str = "1 minute") -> DataFrame:
    """P4 batch/stream twin: requests per key and tumbling window."""
    return comments.groupBy(F.window(ts, window).alias("w"), F.col(key)).agg(F.count(F.lit(1)).alias("requests"))


def rate_limited(comments: DataFrame, limit: int = 100, key: str = "channel_id", ts: str = "ts",
                 window: str = "1 minute", delay: str = "10 minutes") -> DataFrame:
    """Windows whose request count exceeds the limit (would answer 429).

    With a watermark the windowed counts are final once the watermark
    passes the window end, so append mode emits each window once."""
    counted = request_counts(comments.withWatermark(ts, delay), key, ts, window)
    return counted.where(F.col("requests") > limit).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), key, "requests"
    )


def checkpoint_path(spark: SparkSession, name: str) -> str:
    return os.path.join(ensure_checkpoint_dir(spark), "streams", name)


def start(df: DataFrame, name: str, path: str, sink: str = "parquet", mode: str = "append",
          trigger_once: bool = False, **options):
    """A7 for streams: write files with a checkpoint so a restarted job resumes
    exactly where it stopped (lost executors only redo their tasks)."""
    spark = df.sparkSession
    w = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint_path(spark, name)).queryName(name)
    w = w.format(sink).option("path", path)
    for k, v in options.items():
        w = w.option(k, v)
    if trigger_once:
        w = w.trigger(availableNow=True)
    return w.start()


def start_batches(df: DataFrame, name: str, write: Callable[[DataFrame, int], None]):
    """Each micro-batch of what has arrived given to ``write``, with a checkpoint."""
    w = df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint_path(df.sparkSession, name)).queryName(name)
    return w.trigger(availableNow=True).start()
