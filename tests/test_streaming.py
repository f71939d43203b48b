"""Batch/stream parity for P1 and P2/P3, and P5 deduplication."""

import os
import tempfile
import uuid

from revkit.operators import history as L
from revkit.operators import reviews
from revkit.streaming import comments as P
from revkit.streaming.history import channel_history

ROWS = [
    (1, "c1", "2024-01-01 00:00:00", "TODO: fix the `cache` because it leaks"),
    (2, "c1", "2024-01-01 01:00:00", "ok"),
    (3, "c1", "2024-01-01 02:00:00", "- add tests\n- rename variable foo, consider performance"),
    (4, "c2", "2024-01-01 03:00:00", ""),
    (5, "c1", "2024-01-02 00:30:00", "next day resets the history"),
    (6, "c1", "2024-01-02 01:30:00", "second of the day, should compare with the first"),
]


def _comments(spark):
    return spark.createDataFrame(ROWS, "review_id long, channel_id string, ts string, message string").selectExpr(
        "review_id", "channel_id", "cast(ts as timestamp) as ts", "message"
    )


def _stage(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="revkit-test-", dir="/tmp"), "in")
    _comments(spark).repartition(3).write.parquet(path)
    return path


def _run(df):
    path = os.path.join(tempfile.mkdtemp(prefix="revkit-test-", dir="/tmp"), "out")
    q = P.start(df, "t_" + uuid.uuid4().hex, path, trigger_once=True)
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def test_scores_parity(spark):
    got = {r.review_id: r.overall for r in _run(P.score_stream(P.read_comments(spark, _stage(spark), max_files=1))).collect()}
    want = {r.review_id: r.overall for r in reviews.score_comments(_comments(spark)).collect()}
    assert got == want


def _closed(spark, path):
    """A last row, a week later, that lets the watermark pass all others."""
    spark.createDataFrame([(99, "c9", "2024-01-09 00:00:00", "end")], "review_id long, channel_id string, ts string, message string").selectExpr(
        "review_id", "channel_id", "cast(ts as timestamp) as ts", "message"
    ).coalesce(1).write.mode("append").parquet(path)
    return path


def test_history_parity_and_daily_reset(spark):
    out = _run(channel_history(reviews.score_comments(P.read_comments(spark, _closed(spark, _stage(spark))))))
    got = {r.review_id: (r.hist_count, r.hist_avg, r.trend) for r in out.collect()}
    want = {r.review_id: (r.hist_count, r.hist_avg, r.trend) for r in L.with_history(reviews.score_comments(_comments(spark))).collect()}
    assert got == want
    assert got[5][0] == 0 and got[6][0] == 1  # new 24 h period starts empty


def test_dedup(spark):
    path = _stage(spark)
    twice = P.read_comments(spark, path).unionByName(P.read_comments(spark, path))
    ids = sorted(r.review_id for r in _run(P.deduplicate(twice).select("review_id")).collect())
    assert ids == [1, 2, 3, 4, 5, 6]


def _batches(spark, *groups):
    """One file, and so one micro-batch, per group of review ids, in order."""
    path = os.path.join(tempfile.mkdtemp(prefix="revkit-test-", dir="/tmp"), "in")
    for ids in groups:
        _comments(spark).where(f"review_id IN ({', '.join(map(str, ids))})").coalesce(1).write.mode("append").parquet(path)
    return path


def _history(spark, path, delay, **how):
    out = _run(channel_history(reviews.score_comments(P.read_comments(spark, path, **how)), delay))
    return {r.review_id: (r.hist_count, r.hist_avg, r.trend) for r in out.collect()}


def test_history_is_in_order_of_time_however_rows_arrive(spark):
    """The buffer holds a row back until the watermark has passed it."""
    want = {r.review_id: (r.hist_count, r.hist_avg, r.trend) for r in L.with_history(reviews.score_comments(_comments(spark))).collect()}
    path = _closed(spark, _batches(spark, [3], [1], [6, 2], [4], [5]))
    assert _history(spark, path, "3 days", max_files=1) == want


def test_history_waits_for_the_watermark(spark):
    path = _batches(spark, [1, 2], [3])
    assert set(_history(spark, path, "30 minutes", max_files=1)) == {1, 2}  # 3 is less than 30 minutes behind the latest


def test_history_late_row_does_not_stop_the_stream(spark):
    path = _closed(spark, _batches(spark, [1], [5, 6], [2], [3]))
    got = _history(spark, path, "1 hour", max_files=1)
    assert {k: v[0] for k, v in got.items()} == {1: 0, 5: 0, 6: 1}  # 2 and 3 are late


def test_late_rows_are_put_aside_and_counted(spark):
    import datetime as dt

    from revkit.streaming import late

    path, split = _batches(spark, [1, 2], [2, 3], [5], [4, 6], [6]), os.path.join(tempfile.mkdtemp(prefix="revkit-test-", dir="/tmp"), "split")
    write = late.split_late(split, dt.timedelta(minutes=10))
    P.start_batches(P.read_comments(spark, path, max_files=1), "t_" + uuid.uuid4().hex, write).awaitTermination()
    schema = P.COMMENT_SCHEMA
    rows = late.split_table(spark, split, schema)
    assert {(r.batch, r.review_id) for r in rows.where("late").collect()} == {(3, 4)}  # 2 is within ten minutes of the latest
    assert sorted(r.review_id for r in rows.collect()) == [1, 2, 2, 3, 4, 5, 6, 6]
    assert {(r.batch, r.rows, r.late_rows) for r in late.late_counts(spark, split, schema).collect()} == {(0, 2, 0), (1, 2, 0), (2, 1, 0), (3, 2, 1), (4, 1, 0)}
    # a batch that is delivered again leaves the table as it is; one whose mark is missing is written over
    write(_comments(spark).where("review_id = 3"), 3)
    assert rows.where("batch = 3").count() == 2
    kept = _run(P.deduplicate(late.on_time(spark, split, schema), "10 minutes").select("review_id"))
    assert sorted(r.review_id for r in kept.collect()) == [1, 2, 3, 5, 6]


def test_dedup_over_batches(spark):
    path = _batches(spark, [1, 2], [2, 3], [3, 4, 5], [5, 6])
    ids = sorted(r.review_id for r in _run(P.deduplicate(P.read_comments(spark, path, max_files=1), "2 days").select("review_id")).collect())
    assert ids == [1, 2, 3, 4, 5, 6]


def test_history_state_has_a_value_for_many_rows(spark):
    """writes to the state follow the channels and days, not the rows; a
    buffer that is due in part is written again and comes out later."""
    path, out = (os.path.join(tempfile.mkdtemp(prefix="revkit-test-", dir="/tmp"), x) for x in ("in", "out"))
    scored = spark.range(9000).selectExpr(
        "id AS review_id", "'c' || id % 2 AS channel_id", "timestamp_seconds(1704067200 + (id * 7919) % 9000 * 9) AS ts", "CAST(id % 97 AS DOUBLE) AS overall"
    )
    end = spark.sql("SELECT 9000L, 'c9', TIMESTAMP '2024-01-09 00:00:00', 0.0D")
    for k, rows in enumerate((scored.where("review_id < 8700"), scored.where("review_id >= 8700"), end)):
        rows.toDF(*scored.columns).coalesce(1).write.parquet(f"{path}/k={k}")
    stream = spark.readStream.schema(scored.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")
    q = P.start(channel_history(stream, "6 hours"), "t_" + uuid.uuid4().hex, out, trigger_once=True)
    q.awaitTermination()
    first = next(p for p in q.recentProgress if p["numInputRows"])
    assert first["numInputRows"] == 8700 and first["stateOperators"][0]["numRowsUpdated"] <= 20
    got = {r.review_id: (r.hist_count, r.hist_avg, r.trend) for r in spark.read.schema("review_id long, hist_count long, hist_avg double, trend double").parquet(out).collect()}
    mark = 1704067200 + max(i * 7919 % 9000 for i in range(8700)) * 9 - 6 * 3600
    seen = scored.where(f"review_id < 8700 OR ts > timestamp_seconds({mark})")
    want = {r.review_id: (r.hist_count, r.hist_avg, r.trend) for r in L.with_history(seen).collect()}
    assert got == want
