"""The polling loops as Structured Streaming: folder changes, the audit log, sessions, transcript windows.

Each query reads a file source, keeps its state in the checkpoint folder and
writes idempotently, so a restart neither loses nor repeats anything.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folioforge.operators.relational import snapshot_diff

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, files_per_trigger: int = 64) -> DataFrame:
    """Events from Parquet files as they arrive."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def audit_log(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Append-only log: each event once within the watermark, secrets in its properties masked."""
    from folioforge.functions.text import redact_secrets

    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"]).withColumn("props", redact_secrets(F.col("props")))


def live_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions that slide with activity and end after the gap."""
    s = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n_events"))
    return s.select("user_id", F.col("w.start").alias("started"), F.col("w.end").alias("ends"), "n_events")


def counts_by_window(events: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Events of each type in windows of event time."""
    c = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return c.select(F.col("w.start").alias("started"), "event_type", "n")


def anchored(events: DataFrame, seconds: float = 60.0, late: str = "10 minutes") -> DataFrame:
    """Windows that start at a user's first event and take those less than ``seconds`` later; emitted when the next one starts or time passes it.

    State is the open window's anchor and count; events of a batch are sorted, those earlier than the open window's anchor count to it.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        anchor, count, win = state.get if state.exists else (None, 0, -1)
        done = []
        if state.hasTimedOut:
            done.append((key[0], win, count))
            state.remove()
        else:
            times = sorted(t for b in batches for t in b.ts.astype("int64") / 1e9)
            for t in times:
                if anchor is None or t - anchor >= seconds:
                    if anchor is not None:
                        done.append((key[0], win, count))
                    anchor, count, win = t, 0, win + 1
                count += 1
            state.update((anchor, count, win))
            state.setTimeoutTimestamp(int(max(anchor + seconds, state.getCurrentWatermarkMs() / 1000 + 1) * 1000))
        yield pd.DataFrame(done, columns=["user_id", "win", "n_events"])

    return events.withWatermark("ts", late).select("user_id", "ts").groupBy("user_id").applyInPandasWithState(step, "user_id long, win long, n_events long", "anchor double, count long, win long", "append", GroupStateTimeout.EventTimeTimeout)


def run_once(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process all that is there, then stop; a second call goes on where this one ended."""
    q = stream.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def watch(spark: SparkSession, folder: str, state: str, previous: str | None = None) -> tuple[DataFrame, str]:
    """One look at a folder: changes against the snapshot before, and the path of the new one.

    File streams never tell of deletions, so each look compares listings; every
    snapshot is a table of its own and the pointer moves only after it is whole.
    """
    from folioforge.sources.files import scan

    now = scan(spark, folder, settled_seconds=0).select("path", F.sha2("content", 256).alias("sha"))
    new = f"{state}/snapshot-{0 if previous is None else int(previous.rsplit('-', 1)[-1]) + 1}"
    now.write.mode("overwrite").parquet(new)
    stored = spark.read.parquet(new)
    before = spark.read.parquet(previous) if previous else stored.limit(0)
    return snapshot_diff(before, stored), new


def backoff(seconds: float, failed: bool, least: float = 30.0, most: float = 900.0) -> float:
    """Pause until the next round of a loop: doubled after a failure, within bounds."""
    return min(most, max(least, seconds * 2)) if failed else least
