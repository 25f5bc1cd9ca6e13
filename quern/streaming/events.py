"""Streams of events: rates, tumbling counts, sessions, and upserts by batch. Each works on a batch frame alike."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from quern.operators.confidence import START, moved
from quern.operators.profile import upserted


def rates(events: DataFrame, most: int = 50, late: str = "10 minutes", step: str = "1 second") -> DataFrame:
    """(window, event_type, n, over): events in minutes that slide by `step` and whether they pass the limit; each event is in a row for each step of a minute."""
    w = F.window("ts", "60 seconds", step)
    return events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count("*").alias("n")).withColumn("over", F.col("n") > most)


def tumbling(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window, event_type, n, total): counts and sums in tumbling windows."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(session, user_id, n): runs of a user's events without a longer gap."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("session"), "user_id").agg(F.count("*").alias("n"))


def upsert_into(stream: DataFrame, path: str, key: str, checkpoint: str) -> StreamingQuery:
    """New rows of a stream in place of those with their keys, in the Parquet table at `path` (versions beside each other, newest last)."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates([key])
        out = upserted(spark.read.parquet(f"{path}/v={number - 1}"), new, key) if number else new
        out.write.mode("overwrite").parquet(f"{path}/v={number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def adjusting(feedback: DataFrame, key: str = "user_id", last: int = 10) -> DataFrame:
    """(key, silent, notify, confirm): each key's thresholds after every trigger that brought feedback (ts, confidence, was_correct) of it.

    The state of a key is its thresholds and its last records. A trigger's records go by ts, then confidence, then was_correct;
    later triggers' records follow, even if they are older. Nulls as in `confidence.thresholds`.
    """
    of = feedback.schema[key].dataType.simpleString()

    def fold(name, parts, state):
        now, xs, oks = state.get if state.exists else (START, [], [])
        now, recent = tuple(now), list(zip(xs, oks, strict=True))
        pdf = pd.concat(list(parts)).sort_values(["ts", "confidence", "was_correct"], na_position="first")
        for x, ok in zip(pdf["confidence"], pdf["was_correct"], strict=True):
            recent = [*recent, (float("nan") if x is None else float(x), ok is not None and not pd.isna(ok) and bool(ok))][-last:]
            now = moved(now, recent, last)
        state.update((list(now), [x for x, _ in recent], [ok for _, ok in recent]))
        yield pd.DataFrame({key: pd.Series([name[0]], dtype=object), "silent": [now[0]], "notify": [now[1]], "confirm": [now[2]]})

    rows = feedback.select(key, "ts", F.col("confidence").cast("double").alias("confidence"), "was_correct")
    out, kept = f"`{key}` {of}, silent double, notify double, confirm double", "now array<double>, xs array<double>, oks array<boolean>"
    return rows.groupBy(key).applyInPandasWithState(fold, out, kept, "update", GroupStateTimeout.NoTimeout)


def expiring(results: DataFrame, key: str = "task_id", seconds: int = 3600, late: str = "10 minutes") -> DataFrame:
    """(key, ts, status) of results (key, ts): "kept" with the newest ts when a key gets a newer one, "expired" when the watermark is `seconds` past it.

    A result that is too old when it comes expires at once; the state of an expired key is dropped. Rows without ts are left out.
    """
    of = results.schema[key].dataType.simpleString()

    def keep(name, parts, state):
        old = state.get[0] if state.exists else None
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({key: pd.Series([name[0]], dtype=object), "ts": pd.to_datetime([old], unit="us"), "status": ["expired"]})
            return
        new = max(int(pdf["at"].max()) for pdf in parts)
        at = new if old is None else max(old, new)
        until = at // 1000 + 1000 * seconds
        dead = until <= state.getCurrentWatermarkMs()
        if dead and state.exists:
            state.remove()
        elif not dead:
            state.update((at,))
            state.setTimeoutTimestamp(until)
        if dead or old is None or new > old:
            yield pd.DataFrame({key: pd.Series([name[0]], dtype=object), "ts": pd.to_datetime([at], unit="us"), "status": ["expired" if dead else "kept"]})

    rows = results.where("ts IS NOT NULL").withWatermark("ts", late).select(key, "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return rows.groupBy(key).applyInPandasWithState(keep, f"`{key}` {of}, ts timestamp, status string", "at bigint", "append", GroupStateTimeout.EventTimeTimeout)
