"""Keyed per-channel history in Structured Streaming.

State is kept per channel and 24 h period: the running sum and count of overall
scores with the last ten (one value), and a reorder buffer of the rows that the
watermark has not passed (a value for the rows of a frame). A call on the state is
a message to the JVM and a value is pickled by itself, so their number follows the
keys and not the rows. Rows leave the buffer in (ts, review_id) order when the
watermark passes them, however they arrived, so each row sees exactly the earlier
rows of its channel and day, like the batch window in
``revkit.operators.history``. The buffer holds what arrives within the delay and
one micro-batch (bound that by ``maxFilesPerTrigger``). A period's state is
dropped once the watermark has passed its end and its buffer is empty (history
is wiped every 24 hours). Rows behind the watermark never get here:
``revkit.streaming.late`` puts them aside and counts them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from revkit.operators.history import DAY_SECONDS, RECENT, epoch

OUTPUT_SCHEMA = "review_id long, channel_id string, period long, hist_count long, hist_avg double, trend double"
#: Keyed list and timer state needs this provider.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Rows in one value of the reorder buffer, when it is written again.
BUFFER_ROWS = 4096


class ChannelHistory(StatefulProcessor):
    """Key: (channel_id, period, end of the period in ms)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us array<long>, review_id array<long>, overall array<double>")
        self.sums = handle.getValueState("sums", "total double, n long, recent array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first, mark = None, timerValues.getCurrentWatermarkInMs()
        for frame in rows:
            frame = frame[frame["us"] // 1000 > mark]  # later rows of this channel are out already
            if not len(frame):
                continue
            self.waiting.appendValue(tuple(frame[c].tolist() for c in ("us", "review_id", "overall")))
            least = int(frame["us"].min())
            first = least if first is None else min(first, least)
        if first is not None:
            self.handle.registerTimer(first // 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        channel, period, closes = key
        mark = timerValues.getCurrentWatermarkInMs()
        due, wait = [], []
        for columns in self.waiting.get():
            for row in zip(*columns, strict=True):
                (due if row[0] // 1000 <= mark else wait).append(row)
        if wait:
            self.waiting.put([tuple(map(list, zip(*wait[k : k + BUFFER_ROWS], strict=True))) for k in range(0, len(wait), BUFFER_ROWS)])
            self.handle.registerTimer(min(wait)[0] // 1000)
        elif mark >= closes:  # nothing can come any more
            self.waiting.clear()
        elif due:
            self.waiting.clear()
            self.handle.registerTimer(int(closes))
        if due:
            yield self._advance(channel, int(period), sorted(due))
        if not wait and mark >= closes:
            self.sums.clear()

    def _advance(self, channel: str, period: int, due: list[tuple[int, int, float]]) -> pd.DataFrame:
        total, n, recent = self.sums.get() or (0.0, 0, [])
        recent = list(recent)
        out = []
        for _, review, score in due:
            out.append((review, channel, period, n, total / n if n else None, recent[-1] - recent[0] if len(recent) >= 2 else 0.0))
            total, n = total + score, n + 1
            recent = (recent + [score])[-RECENT:]
        self.sums.update((float(total), int(n), [float(x) for x in recent]))
        return pd.DataFrame(out, columns=["review_id", "channel_id", "period", "hist_count", "hist_avg", "trend"])

    def close(self) -> None:
        pass


def channel_history(scored: DataFrame, delay: str = "1 hour", origin: str = "1970-01-01 00:00:00") -> DataFrame:
    """P2/P3 on a stream of scored comments (review_id, channel_id, ts, overall);
    a row comes out when the watermark (the latest ``ts`` less ``delay``) passes it."""
    scored.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    period = epoch(F.col("ts"), origin)
    closes = (F.unix_timestamp(F.lit(origin).cast("timestamp")) + (period + 1) * DAY_SECONDS) * 1000
    rows = scored.withWatermark("ts", delay)
    rows = rows.select("review_id", "channel_id", "ts", "overall", F.unix_micros("ts").alias("us"), period.alias("period"), closes.cast("long").alias("closes"))
    return rows.groupBy("channel_id", "period", "closes").transformWithStateInPandas(ChannelHistory(), OUTPUT_SCHEMA, "Append", "EventTime")
