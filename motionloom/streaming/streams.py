"""Structured Streaming forms of the resume, latest-wins, window, gap and collapse operators.

Results go to files, never to the driver; every stream has a checkpoint and state that a watermark
or an idle time bounds.  Windows and tracks are written once the watermark has passed them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from datetime import timedelta
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.tracking import Linker


def event_stream(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """Events from Parquet files; times become instants, as watermarks need them."""
    schema = spark.read.parquet(path).schema
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def heartbeat(events: DataFrame, path: str, after: str = "1 day") -> None:
    """Add one event without a user, later than all others, which lets the watermark close what is open."""
    last = events.agg((F.max("ts") + F.expr(f"INTERVAL {after}")).alias("ts"))
    last.select(*[F.col("ts") if c == "ts" else F.lit(None).cast(kind).alias(c) for c, kind in events.dtypes]).write.mode("append").parquet(path)


def stream_fixed_windows(events: DataFrame, seconds: int = 10, late: str = "1 minute") -> DataFrame:
    """Counts and sums of tumbling windows."""
    w = F.window("ts", f"{seconds} seconds")
    return events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.unix_micros("window.start").alias("start_us"), "event_type", "n", "total")


def stream_quality_feed(events: DataFrame, late: str = "1 minute") -> DataFrame:
    """Rows, failures and mean value of every hour."""
    w = F.window("ts", "1 hour")
    return events.withWatermark("ts", late).groupBy(w).agg(F.count("*").alias("n"), F.count_if(F.col("value") < 5).alias("failures"), F.avg("value").alias("mean_value")).select(F.unix_micros("window.start").alias("start_us"), "n", "failures", "mean_value")


def stream_sessions(events: DataFrame, gap: str = "15 minutes", late: str = "1 minute") -> DataFrame:
    """Sessions of each user: they end after a gap without events."""
    w = F.session_window("ts", gap)
    return events.withWatermark("ts", late).groupBy(w, "user_id").agg(F.count("*").alias("n")).select("user_id", F.unix_micros("session_window.start").alias("start_us"), "n")


_BOX = ["x1", "y1", "x2", "y2"]
_TRACK_STATE = "made int, tracks array<int>, lasts array<int>, live array<double>, at array<long>, frames array<int>, people array<int>, boxes array<double>"


def stream_track_gap(boxes: DataFrame, late: str = "10 seconds", threshold: float = 0.3, max_gap: int = 15, idle: timedelta = timedelta(days=1)) -> DataFrame:
    """Boxes of a stream linked into tracks by their overlap; a track ends after ``max_gap`` frames without a box.

    Input: ts, video, frame, person, x1, y1, x2, y2, with times that rise with the frames of a recording.
    Output: video, frame, person, track, as ``link_tracks`` gives them for all boxes together.  The state of a
    recording is its live tracks and the boxes that the watermark has not passed: these wait, as an earlier
    frame may still come.  A timer wakes a recording for them.  One without boxes for ``idle`` is forgotten.
    """
    kinds = dict(boxes.dtypes)
    out = [f"{c} {kinds[c]}" for c in ("video", "frame", "person")]
    columns = ["video", "frame", "person", "track"]

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if group[0] is None or pd.isna(group[0]):  # a heartbeat
            return
        made, tracks, lasts, live, at, frames, people, corners = state.get if state.exists else (0, *([] for _ in range(7)))
        waiting = list(zip(at, frames, people, _fours(corners), strict=True))
        for pdf in [] if state.hasTimedOut else batches:
            waiting += list(zip(pdf["us"].tolist(), pdf["frame"].tolist(), pdf["person"].tolist(), map(tuple, pdf[_BOX].to_numpy().tolist()), strict=True))
        now = state.getCurrentWatermarkMs() * 1000
        ready = sorted(w[1:] for w in waiting if w[0] <= now)
        waiting = [w for w in waiting if w[0] > now]
        linker = Linker(threshold, max_gap, zip(tracks, lasts, _fours(live), strict=True), made)
        rows = []
        for frame, own in groupby(ready, key=lambda w: w[0]):
            own = list(own)
            rows += [(group[0], frame, person, track) for (_, person, _), track in zip(own, linker.step(frame, [_whole(b) for *_, b in own]), strict=True)]
        if state.hasTimedOut and not ready and not waiting:
            state.remove()
            return
        state.update((linker.made, [t[0] for t in linker.live], [t[1] for t in linker.live], _flat(t[2] for t in linker.live), [w[0] for w in waiting], [w[1] for w in waiting], [w[2] for w in waiting], _flat(w[3] for w in waiting)))
        wake = min(w[0] for w in waiting) // 1000 + 1 if waiting else state.getCurrentWatermarkMs() + int(idle / timedelta(milliseconds=1))
        state.setTimeoutTimestamp(wake)
        if rows:
            yield pd.DataFrame(rows, columns=columns)

    kept = boxes.withWatermark("ts", late).select("ts", F.unix_micros("ts").alias("us"), "video", "frame", "person", *_BOX)
    return kept.groupBy("video").applyInPandasWithState(step, ", ".join([*out, "track int"]), _TRACK_STATE, "append", GroupStateTimeout.EventTimeTimeout)


def _fours(flat: list[float]) -> list[tuple[float, ...]]:
    return [tuple(flat[k : k + 4]) for k in range(0, len(flat), 4)]


def _flat(boxes: Iterable[tuple[float, ...] | None]) -> list[float]:
    return [float(c) for box in boxes for c in box or (math.nan,) * 4]


def _whole(box: tuple[float, ...]) -> tuple[float, ...] | None:
    return None if any(c is None or math.isnan(c) for c in box) else box


def stream_collapse_text(events: DataFrame, key: str, text: str, late: str = "1 hour", idle: timedelta = timedelta(days=30)) -> DataFrame:
    """Rows whose text differs from the one before of their key; the last text is the state.

    A key without events for ``idle`` is forgotten; its next text then counts as new.
    """

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        pdf = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        last = state.get[0] if state.exists else None
        keep = pdf[text] != pdf[text].shift(fill_value=last)
        if len(pdf):
            state.update((pdf[text].iloc[-1],))
            state.setTimeoutTimestamp(int(max(pdf["ts"].iloc[-1].timestamp() * 1000, state.getCurrentWatermarkMs()) + idle / timedelta(milliseconds=1)))
        yield pdf.loc[keep, [key, "event_id", text]]

    kinds = dict(events.dtypes)
    out = f"{key} {kinds[key]}, event_id {kinds['event_id']}, {text} {kinds[text]}"
    return events.withWatermark("ts", late).groupBy(key).applyInPandasWithState(step, out, f"last {kinds[text]}", "append", GroupStateTimeout.EventTimeTimeout)


def stream_collapse_in_order(events: DataFrame, key: str, text: str, order: str = "event_id", late: str = "1 hour", idle: timedelta = timedelta(days=30)) -> DataFrame:
    """Rows whose text differs from the one before of their key by (ts, ``order``), however they come.

    A row is decided once the watermark has passed it, as rows between it and the one before may still
    come: over any batches the result is that over all rows together.  Equal texts are compared as SQL's
    IS DISTINCT FROM does.  The state of a key is its last text and the rows of the last ``late`` hours; a timer
    wakes the key for them.  A key without events for ``idle`` is forgotten.  Rows with neither key nor
    ``order`` are heartbeats.
    """
    kinds = dict(events.dtypes)
    columns = [key, order, text]

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        name = None if pd.isna(group[0]) else group[0]
        seen, last, at, ids, texts = state.get if state.exists else (False, None, [], [], [])
        waiting = list(zip(at, ids, texts, strict=True))
        for pdf in [] if state.hasTimedOut else batches:
            plain = [[None if pd.isna(x) else x for x in pdf[c].tolist()] for c in ("us", order, text)]
            waiting += [row for row in zip(*plain, strict=True) if name is not None or row[1] is not None]
        now = state.getCurrentWatermarkMs() * 1000
        ready = sorted((w for w in waiting if w[0] <= now), key=lambda w: (w[0], w[1] is not None, w[1]))
        waiting = [w for w in waiting if w[0] > now]
        rows = []
        for _, number, said in ready:
            if not seen or said != last:
                rows.append((name, number, said))
            seen, last = True, said
        if state.hasTimedOut and not ready and not waiting:
            state.remove()
            return
        if seen or waiting:
            state.update((seen, last, *([w[k] for w in waiting] for k in range(3))))
            state.setTimeoutTimestamp(min(w[0] for w in waiting) // 1000 + 1 if waiting else state.getCurrentWatermarkMs() + int(idle / timedelta(milliseconds=1)))
        if rows:
            yield pd.DataFrame({c: pd.Series([r[k] for r in rows], dtype=object) for k, c in enumerate(columns)})

    kept = events.withWatermark("ts", late).select("ts", F.unix_micros("ts").alias("us"), *columns)
    held = f"seen boolean, last {kinds[text]}, at array<long>, ids array<{kinds[order]}>, texts array<{kinds[text]}>"
    return kept.groupBy(key).applyInPandasWithState(step, ", ".join(f"{c} {kinds[c]}" for c in columns), held, "append", GroupStateTimeout.EventTimeTimeout)


def run_batches(df: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Run a stream over all that is there now through a foreachBatch function."""
    df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def run_to_files(df: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run a stream over all that is there now into Parquet files, and read them."""
    q: StreamingQuery = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(path)
