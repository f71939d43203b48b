"""L: per-channel quality history with window functions (batch twin of the
keyed streaming state in ``revkit.streaming.history``)."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from revkit.session import ensure_checkpoint_dir

DAY_SECONDS = 86400
RECENT = 10


def epoch(ts: Column, origin: str = "1970-01-01 00:00:00") -> Column:
    """24-hour history period of a timestamp (history is wiped each period)."""
    secs = F.unix_timestamp(ts) - F.unix_timestamp(F.lit(origin).cast("timestamp"))
    return F.floor(secs / F.lit(DAY_SECONDS)).cast("bigint")


def with_history(scored: DataFrame, origin: str = "1970-01-01 00:00:00") -> DataFrame:
    """L1-L3: for each review, the channel's earlier reviews in the same period.

    Adds hist_count, hist_avg (mean overall of all earlier reviews) and trend
    (last minus first of the last ten earlier reviews; 0 with fewer than 2).
    One exchange on (channel_id, period); all frames share the ordering."""
    w = Window.partitionBy("channel_id", "period").orderBy("ts", "review_id")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    recent = w.rowsBetween(-RECENT, -1)
    df = scored.withColumn("period", epoch(F.col("ts"), origin))
    n_recent = F.count("overall").over(recent)
    trend = F.when(n_recent >= 2, F.last("overall").over(recent) - F.first("overall").over(recent)).otherwise(F.lit(0.0))
    return df.select(
        "*",
        F.count("overall").over(before).alias("hist_count"),
        F.avg("overall").over(before).alias("hist_avg"),
        trend.alias("trend"),
    )


def _pct(x: Column) -> Column:
    return F.format_string("%.1f", x)


def trend_label(trend: Column) -> Column:
    """L4."""
    emoji = F.when(trend > 5, F.lit("📈")).when(trend < -5, F.lit("📉")).otherwise(F.lit("➡️"))
    text = (
        F.when(F.abs(trend) < 2, F.lit("Stable"))
        .when(trend > 0, F.concat(F.lit("Improving (+"), _pct(trend), F.lit("%)")))
        .otherwise(F.concat(F.lit("Declining ("), _pct(F.abs(trend)), F.lit("%)")))
    )
    return F.concat(emoji, F.lit(" Quality trend: "), text)


def comparison_label(overall: Column, hist_avg: Column) -> Column:
    """L5."""
    diff = F.round(overall - hist_avg, 6)  # the order of summing must not show in the first decimal
    emoji = F.when(diff > 5, F.lit("🌟")).when(diff < -5, F.lit("⚠️")).otherwise(F.lit("➡️"))
    text = (
        F.when(F.abs(diff) < 2, F.lit("On par with typical reviews"))
        .when(diff > 0, F.concat(F.lit("Above average (+"), _pct(diff), F.lit("%)")))
        .otherwise(F.concat(F.lit("Below average ("), _pct(F.abs(diff)), F.lit("%)")))
    )
    return F.concat(emoji, F.lit(" Compared to average: "), text)


def historical_section(overall: Column, hist_count: Column, hist_avg: Column, trend: Column) -> Column:
    """The 'Historical Perspective' block, '' without history."""
    body = F.concat(F.lit("\n### Historical Perspective\n"), trend_label(trend), F.lit("\n"), comparison_label(overall, hist_avg))
    return F.when(hist_count > 0, body).otherwise(F.lit(""))


#: The columns of a history record.
RECORD = "channel_id string, date timestamp, overall_quality double, comment_length long, thoroughness double, clarity double, actionability double, average double, trend double"
#: The columns of a scored review that its record is made of (no text).
RECORDED = ["review_id", "channel_id", "ts", "overall", "comment_length", "thoroughness", "clarity", "actionability"]


def history_records(scored: DataFrame, *more: str) -> DataFrame:
    """History rows as the reference's model declares them, and columns ``more``."""
    return scored.select(
        *more,
        "channel_id",
        F.col("ts").alias("date"),
        F.col("overall").alias("overall_quality"),
        F.col("comment_length"),
        "thoroughness", "clarity", "actionability",
        F.coalesce(F.col("hist_avg"), F.lit(0.0)).alias("average") if "hist_avg" in scored.columns else F.lit(0.0).alias("average"),
        F.coalesce(F.col("trend"), F.lit(0.0)).alias("trend") if "trend" in scored.columns else F.lit(0.0).alias("trend"),
    )


#: What a channel's day has seen so far: reviews, sum of their scores, the last ten.
STATE = "channel_id string, period long, n long, total double, tail array<double>"


def with_history_split(scored: DataFrame, bucket_seconds: int = 300, origin: str = "1970-01-01 00:00:00", before: DataFrame | None = None) -> DataFrame:
    """L1-L3 for hot channels: the same columns as ``with_history`` without
    putting a whole (channel, period) into one task.

    Rows are cut into time buckets inside their (channel, period). Per bucket
    a partial aggregate keeps count, sum and the last ten scores; a small
    window over buckets turns these into prefixes (rows before the bucket,
    and the last ten scores of the ten preceding non-empty buckets); rows are
    joined to their bucket's prefix and finish with a window inside the
    bucket. Sums are associated per bucket, so ``hist_avg`` may differ from
    the sequential running mean in the last bits; counts and trends are exact.
    ``before`` (``STATE``) is what earlier batches left of a channel's day."""
    return _split(_computed(scored), bucket_seconds, origin, before)[0]


def _computed(scored: DataFrame) -> DataFrame:
    """Both the buckets and the rows read the scores: they are computed once."""
    ensure_checkpoint_dir(scored.sparkSession)
    return scored.checkpoint()


def _split(scored: DataFrame, bucket_seconds: int, origin: str, before: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """The rows with their history, and (channel_id, period, n, total, last) of the batch itself."""
    key = ["channel_id", "period", "bucket"]
    df = scored.withColumn("period", epoch(F.col("ts"), origin)).withColumn(
        "bucket", F.floor((F.unix_timestamp("ts") - F.unix_timestamp(F.lit(origin).cast("timestamp"))) / F.lit(bucket_seconds)).cast("bigint")
    )
    wb = Window.partitionBy(*key).orderBy("ts", "review_id")
    inb = df.select(
        "*",
        F.count("overall").over(wb.rowsBetween(Window.unboundedPreceding, -1)).alias("in_cnt"),
        F.coalesce(F.sum("overall").over(wb.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("in_sum"),
        F.collect_list("overall").over(wb.rowsBetween(-RECENT, -1)).alias("in_tail"),
        F.row_number().over(wb.orderBy(F.col("ts").desc(), F.col("review_id").desc())).alias("rev_rank"),
    )
    per_bucket = inb.groupBy(*key).agg(
        F.count(F.lit(1)).alias("b_cnt"),
        F.sum("overall").alias("b_sum"),
        F.array_sort(F.collect_list(F.when(F.col("rev_rank") <= RECENT, F.struct("ts", "review_id", "overall")))).alias("b_last"),
    )
    wp = Window.partitionBy("channel_id", "period").orderBy("bucket")
    prefix = per_bucket.select(
        *key,
        F.coalesce(F.sum("b_cnt").over(wp.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("p_cnt"),
        F.coalesce(F.sum("b_sum").over(wp.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("p_sum"),
        F.flatten(F.collect_list(F.transform("b_last", lambda s: s["overall"])).over(wp.rowsBetween(-RECENT, -1))).alias("p_tail"),
    )
    if before is not None:
        prefix = prefix.join(before, ["channel_id", "period"], "left")
        tail = F.coalesce("tail", F.array().cast("array<double>"))
        prefix = prefix.select(
            *key, (F.col("p_cnt") + F.coalesce("n", F.lit(0))).alias("p_cnt"), (F.col("p_sum") + F.coalesce("total", F.lit(0.0))).alias("p_sum"),
            F.concat(tail, "p_tail").alias("p_tail"),
        )
    joined = inb.join(prefix, key)
    # at most RECENT scores a bucket, and a day's buckets
    own = per_bucket.groupBy("channel_id", "period").agg(F.sum("b_cnt").alias("n"), F.sum("b_sum").alias("total"), F.array_sort(F.flatten(F.collect_list("b_last"))).alias("last"))
    own = own.withColumn("last", F.transform(F.slice("last", F.greatest(F.size("last") - RECENT + 1, F.lit(1)), RECENT), lambda x: x["overall"]))
    cnt = F.col("p_cnt") + F.col("in_cnt")
    tail = F.concat(F.col("p_tail"), F.col("in_tail"))
    last10 = F.slice(tail, F.greatest(F.size(tail) - RECENT + 1, F.lit(1)), RECENT)
    trend = F.when(F.size(last10) >= 2, F.element_at(last10, -1) - F.element_at(last10, 1)).otherwise(F.lit(0.0))
    rows = joined.select(
        *scored.columns, "period",
        cnt.cast("bigint").alias("hist_count"),
        F.when(cnt > 0, (F.col("p_sum") + F.col("in_sum")) / cnt).alias("hist_avg"),
        trend.alias("trend"),
    )
    return rows, own


class HistoryTable:
    """History records that grow batch by batch.

    ``records`` has a partition per batch; ``state`` the ``STATE`` of
    every channel and day that a batch touched, after it. The files of a batch
    hold ranges of days, so their number follows the rows and not the days, and a
    reader of some days skips the other files by their statistics. A new batch
    reads the state (not the records), continues the counts, means and
    trends from there, and writes its records and states; written again, it
    replaces them. Reviews of a batch must come after those that earlier batches
    held of the same channel and day (the keyed stream takes them in any order)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _read(self, name: str, schema: str) -> DataFrame | None:
        try:
            return self.spark.read.schema(schema + ", batch long").parquet(f"{self.path}/{name}")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e.getCondition()):
                raise
            return None  # nothing is written yet

    def state(self, batch: int) -> DataFrame:
        """The latest state of every channel and day before this batch."""
        held = self._read("state", STATE)
        if held is None:
            return self.spark.createDataFrame([], STATE)
        last = F.max_by(F.struct("n", "total", "tail"), "batch").alias("s")
        return held.where(F.col("batch") < batch).groupBy("channel_id", "period").agg(last).select("channel_id", "period", "s.*")

    def append(self, scored: DataFrame, batch: int, bucket_seconds: int = 300, origin: str = "1970-01-01 00:00:00") -> None:
        scored = _computed(scored.select(*RECORDED))
        days = scored.select(epoch(F.col("ts"), origin).alias("period")).distinct()
        first, last = days.agg(F.min("period"), F.max("period")).first()
        before = self.state(batch).where(F.col("period").between(first, last)).join(days, "period", "left_semi")
        before.write.mode("overwrite").parquet(f"{self.path}/read/batch={batch}")
        before = self.spark.read.schema(STATE).parquet(f"{self.path}/read/batch={batch}")
        rows, own = _split(scored, bucket_seconds, origin, before)
        self._write(history_records(rows, "period"), "records", batch, "date")
        none = F.array().cast("array<double>")
        merged = own.join(before.withColumnsRenamed({"n": "n0", "total": "total0"}), ["channel_id", "period"], "left")
        tail = F.concat(F.coalesce("tail", none), "last")
        merged = merged.select(
            "channel_id", "period", (F.col("n") + F.coalesce("n0", F.lit(0))).alias("n"), (F.col("total") + F.coalesce("total0", F.lit(0.0))).alias("total"),
            F.slice(tail, F.greatest(F.size(tail) - RECENT + 1, F.lit(1)), RECENT).alias("tail"),
        )
        self._write(merged, "state", batch)

    def _write(self, rows: DataFrame, name: str, batch: int, *then: str) -> None:
        """Dealt by ranges of days; a day with many rows is split by channel and ``then``."""
        dealt = rows.withColumn("batch", F.lit(batch).cast("long")).repartitionByRange("period", "channel_id", *then)
        out = dealt.sortWithinPartitions("period", "channel_id", *then).write.mode("overwrite")
        out.option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{self.path}/{name}")

    def records(self) -> DataFrame:
        return self._read("records", RECORD + ", period long")
