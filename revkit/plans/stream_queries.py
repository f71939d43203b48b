"""Registered streaming queries (P). Each runs its stream to completion
(availableNow) over input derived from the given tables and returns the
sink as a batch DataFrame; the oracle is the batch twin's SQL."""

from __future__ import annotations

import datetime as dt
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from revkit.operators import reviews
from revkit.operators.history import DAY_SECONDS
from revkit.plans import agg_queries as AQ
from revkit.plans.queries import _SCORES_SQL, register
from revkit.session import ensure_checkpoint_dir
from revkit.sources import tables
from revkit.streaming import comments as P
from revkit.streaming import late
from revkit.streaming.history import OUTPUT_SCHEMA as HISTORY_SCHEMA
from revkit.streaming.history import channel_history


#: Writes by which staged comments arrive, one after the other, each a span of whole days.
ARRIVALS = 4
#: Bytes of files in one micro-batch: their number follows the size of the input,
#: not the number of files, and each has work for every core.
BATCH_BYTES = 1 << 30


def _shared(spark: SparkSession, kind: str) -> str:
    return os.path.join(ensure_checkpoint_dir(spark), kind, uuid.uuid4().hex)


def _staged_comments(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """(folder, delay): the derived comments written in order of time, span by
    span, and the longest that a row may come after a later one. Inside a span
    the files are dealt by channel and day, so they overlap in time."""
    path = _shared(spark, "inputs")
    rows = tables.review_comments(spark, sf_dir)
    day = F.floor(F.unix_timestamp("ts") / DAY_SECONDS)
    lo, hi = rows.agg(F.min(day), F.max(day)).first()
    lo, hi = lo or 0, hi or 0
    span = max(1, -(-(hi - lo + 1) // ARRIVALS))
    for k in range(ARRIVALS):
        part = rows.where((day >= lo + k * span) & (day < lo + (k + 1) * span))
        part.repartition("channel_id", day).write.mode("append").parquet(path)
    return path, f"{span + 1} days"


def _run(df: DataFrame) -> DataFrame:
    """Run the stream to the end of its input; its files are the result."""
    path = _shared(df.sparkSession, "outputs")
    q = P.start(df, "q_" + uuid.uuid4().hex, path, trigger_once=True)
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(path)


@register("stream_scores", f"WITH s AS ({_SCORES_SQL}) SELECT review_id, overall, CASE WHEN overall >= 85 THEN '🟢' WHEN overall >= 70 THEN '🟡' ELSE '🔴' END AS band FROM s")
def q_stream_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments arriving as files, scored statelessly (bytes per trigger bounded)."""
    path, _ = _staged_comments(spark, sf_dir)
    src = P.read_comments(spark, path, max_bytes=BATCH_BYTES)
    return _run(P.score_stream(src).select("review_id", "overall", "band"))


@register("stream_dedup", f"SELECT DISTINCT review_id FROM ({tables.REVIEW_COMMENTS_SQL}) rc")
def q_stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P5: the comment stream read twice (every review delivered two times),
    duplicates dropped within the watermark."""
    path, delay = _staged_comments(spark, sf_dir)
    twice = P.read_comments(spark, path, max_bytes=BATCH_BYTES).unionByName(P.read_comments(spark, path, max_bytes=BATCH_BYTES // 2))
    return _run(P.deduplicate(twice, delay).select("review_id"))


#: How late a row may come, and the derived arrivals: the days in ARRIVALS spans,
#: one after the other, but some rows one span late.
DELAY = dt.timedelta(minutes=10)
_ARRIVES = "CAST(floor(({day} - lo) / greatest(1, ceil((hi - lo + 1) / {n}.0))) AS BIGINT) + CASE WHEN review_id % 40 = 3 THEN 1 ELSE 0 END"
#: Rows that are delivered twice: at once, or a span later.
_AGAIN = "review_id % 40 IN (5, 24)"


def _arrivals_sql(day: str, twice: bool) -> str:
    """(review_id, channel_id, ts, message, k): the derived comments and the arrival each comes with."""
    first = f"SELECT c.*, {_ARRIVES.format(day=day, n=ARRIVALS)} AS k FROM c, b"
    again = f" UNION ALL SELECT review_id, channel_id, ts, message, k + CASE WHEN review_id % 40 = 24 THEN 1 ELSE 0 END FROM a0 WHERE {_AGAIN}" if twice else ""
    return f"""WITH c AS ({tables.REVIEW_COMMENTS_SQL}), b AS (SELECT min({day}) AS lo, max({day}) AS hi FROM c), a0 AS ({first})
SELECT review_id, channel_id, ts, message, k FROM a0{again}"""


def _late_sql(twice: bool) -> str:
    return f"""WITH a AS ({_arrivals_sql("floor(epoch(ts) / 86400)", twice)}), w AS (SELECT k, max(ts) AS latest FROM a GROUP BY k),
m AS (SELECT x.k, max(w.latest) - INTERVAL {DELAY.seconds // 60} MINUTE AS mark FROM (SELECT DISTINCT k FROM a) x LEFT JOIN w ON w.k < x.k GROUP BY x.k)
SELECT a.*, coalesce(a.ts <= m.mark, false) AS late FROM a JOIN m USING (k)"""


def _delivered(spark: SparkSession, sf_dir: str, twice: bool, keyed) -> tuple[str, str]:
    """Deliver arrival after arrival: each is one micro-batch of the late split,
    then of the keyed stream (on-time rows -> stream) behind it. Returns the
    folders of the split and of the keyed stream's output."""
    folder, split, out, name = _shared(spark, "inputs"), _shared(spark, "split"), _shared(spark, "outputs"), uuid.uuid4().hex
    tables.register(spark, sf_dir, ("conversations",))
    staged = _shared(spark, "arrivals")
    spark.sql(_arrivals_sql("floor(unix_timestamp(ts) / 86400)", twice)).write.partitionBy("k").parquet(staged)
    every = spark.read.schema(StructType([*P.COMMENT_SCHEMA.fields, StructField("k", LongType())])).parquet(staged)
    for k in range(ARRIVALS + 1):
        every.where(F.col("k") == k).drop("k").write.mode("append").parquet(folder)
        P.start_batches(P.read_comments(spark, folder), f"split_{name}", late.split_late(split, DELAY)).awaitTermination()
        P.start(keyed(late.on_time(spark, split, P.COMMENT_SCHEMA)), f"keyed_{name}", out, trigger_once=True).awaitTermination()
    return split, out


@register("stream_late", f"""WITH l AS ({_late_sql(True)})
SELECT DISTINCT review_id, 'kept' AS sink FROM l WHERE NOT late UNION ALL SELECT review_id, 'late' FROM l WHERE late""")
def q_stream_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P5: rows behind the watermark go to a table of their own, the others are
    deduplicated; with rows that come a span late and rows that come twice."""
    minutes = f"{DELAY.seconds // 60} minutes"
    split, out = _delivered(spark, sf_dir, True, lambda rows: P.deduplicate(rows, minutes).select("review_id"))
    put_aside = late.split_table(spark, split, P.COMMENT_SCHEMA).where("late").select("review_id", F.lit("late").alias("sink"))
    return spark.read.schema("review_id long").parquet(out).select("review_id", F.lit("kept").alias("sink")).unionByName(put_aside)


_HIST_SQL = f"""WITH kept AS (SELECT * FROM ({_late_sql(False)}) l WHERE NOT late), h AS ({AQ._history_sql("SELECT review_id, ts FROM kept")})
SELECT review_id, h.channel_id, period, hist_count, hist_avg, trend FROM h JOIN kept USING (review_id)
WHERE ts <= (SELECT max(ts) FROM kept) - INTERVAL {DELAY.seconds // 60} MINUTE"""


@register("stream_channel_history", _HIST_SQL)
def q_stream_channel_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyed state per channel and day (running mean, last-10 trend) over
    several arrivals, rows in order of time behind a small delay, late rows put
    aside; what the watermark has not passed is not out yet."""
    minutes = f"{DELAY.seconds // 60} minutes"

    def history(rows: DataFrame) -> DataFrame:
        # scoring costs CPU per byte of text: dealt evenly, however few and unlike the files are
        scored = reviews.score_comments(rows.repartition("review_id"))
        return channel_history(scored.select("review_id", "channel_id", "ts", "overall"), minutes)

    _, path = _delivered(spark, sf_dir, False, history)
    out = spark.read.schema(HISTORY_SCHEMA).parquet(path)
    return out.select(
        "review_id", "channel_id", "period", "hist_count", F.round("hist_avg", 6).alias("hist_avg"), F.round("trend", 6).alias("trend")
    )


RATE_SQL = """SELECT user_id, strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS requests,
  count(*) > 100 AS limited
FROM events GROUP BY user_id, date_trunc('minute', ts)"""


@register("rate_limit_windows", RATE_SQL)
def q_rate_limit_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P4 batch twin on ``events`` (user as channel): requests per 1-minute
    tumbling window and whether the 100/min limit is exceeded."""
    ev = tables.table(spark, sf_dir, "events").select("user_id", "ts")
    counted = P.request_counts(ev, key="user_id")
    return counted.select(
        "user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "requests",
        (F.col("requests") > 100).alias("limited"),
    )


STREAM_LIMIT, STREAM_WINDOW, STREAM_DELAY = 6, "1 hour", "1 hour"

STREAM_RATE_SQL = f"""WITH w AS (SELECT event_type, date_trunc('hour', ts) AS s, count(*) AS requests FROM events GROUP BY event_type, date_trunc('hour', ts))
SELECT event_type, strftime(s, '%Y-%m-%d %H:%M:%S') AS window_start, requests FROM w
WHERE requests > {STREAM_LIMIT} AND s + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR"""


@register("stream_rate_limited", STREAM_RATE_SQL)
def q_stream_rate_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P4 as a stream: the hours in which an event type goes over the limit;
    a window comes out once, when the watermark has passed its end."""
    folder = _shared(spark, "inputs")
    tables.table(spark, sf_dir, "events").select("event_type", "ts").write.parquet(folder)
    events = spark.readStream.schema("event_type string, ts timestamp").parquet(folder)
    out = _run(P.rate_limited(events, STREAM_LIMIT, "event_type", "ts", STREAM_WINDOW, STREAM_DELAY).select("event_type", "window_start", "requests"))
    return out.select("event_type", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "requests")


def _all_findings_sql(columns: str) -> str:
    from revkit.plans import file_queries as FQ
    from revkit.plans.queries import ORACLE

    # a rendered PHP issue names its line; headings stand at line 0
    php = f"SELECT repo, path, coalesce(TRY_CAST(regexp_extract(recommendation, '^[A-Z_]+ \\[L([0-9]+):C', 1) AS BIGINT), 0) AS line, recommendation FROM ({FQ.PHP_RECS_SQL}) p"
    parts = [FQ.ASPECTS_SQL, FQ.COMMON_SQL, FQ.JAVA_SQL, php, FQ.PYTHON_SQL, ORACLE["python_stateful_findings"],
             FQ.GO_SQL, ORACLE["go_block_findings"]]
    return "\nUNION ALL\n".join(f"SELECT {columns} FROM ({p}) s{i}" for i, p in enumerate(parts))


def _stream_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from revkit.sources.files import derived_files
    from revkit.streaming.files import findings_stream, read_files

    path = _shared(spark, "inputs")
    derived_files(spark, sf_dir).select("repo", "path", "content").write.parquet(path)
    stream = read_files(spark, path, max_bytes=BATCH_BYTES)
    return _run(findings_stream(stream, known_files=spark.read.parquet(path).select("repo", "path")))


@register("stream_findings", _all_findings_sql("repo, path, CAST(line AS BIGINT) AS line, recommendation"))
def q_stream_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source files landing as files; row-local rules per micro-batch,
    the sibling-test check against a static key snapshot."""
    return _stream_findings(spark, sf_dir).select("repo", "path", F.col("line").cast("bigint").alias("line"), F.col("msg").alias("recommendation"))


@register("stream_findings_text", _all_findings_sql("repo, path, recommendation"))
def q_stream_findings_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P6 checked end to end: every recommendation of every file that
    arrives on the stream equals the batch rule families' output."""
    return _stream_findings(spark, sf_dir).select("repo", "path", F.col("msg").alias("recommendation"))
