"""Spending limits by request, hour and day, kept as state of a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

HOUR, DAY = 3_600_000, 86_400_000
SPANS = {"hour": HOUR, "day": DAY}
#: The state store that timers and maps of state need.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "ts timestamp, cost double, hour_spent double, day_spent double, verdict string"


def judged(at: int, cost: float, spans: dict[tuple[str, int], float], limits: tuple[float, float, float]) -> tuple[str, float, float]:
    """(verdict, spent in the hour, in the day) of a request at `at` milliseconds; spans: what is spent by ("hour" or "day", its start).

    Refused are requests over the limit of one ("request"), and those that would take the hour ("hour") or the day ("day") over theirs; they spend nothing.
    """
    hour, day = ("hour", at // HOUR * HOUR), ("day", at // DAY * DAY)
    a, b = spans.get(hour, 0.0), spans.get(day, 0.0)
    verdict = "request" if cost > limits[0] else "hour" if a + cost > limits[1] else "day" if b + cost > limits[2] else "ok"
    if verdict == "ok":
        a, b = a + cost, b + cost
        spans[hour], spans[day] = a, b
    return verdict, a, b


def _frame(key: str, of: list, at: list[int], cost: list[float], out: list[tuple[str, float, float]]) -> pd.DataFrame:
    columns = {"ts": pd.to_datetime(pd.Series(at, dtype="int64"), unit="ms"), "cost": pd.Series(cost, dtype=float), "hour_spent": pd.Series([a for _, a, _ in out], dtype=float), "day_spent": pd.Series([b for _, _, b in out], dtype=float), "verdict": pd.Series([v for v, _, _ in out], dtype=object)}
    return pd.DataFrame({key: pd.Series(of, dtype=object)} | columns)


class Spending(StatefulProcessor):
    """Sums of a key's hours and days; a timer at the end of each drops it once the watermark has passed."""

    def __init__(self, key: str, limits: tuple[float, float, float]) -> None:
        self.key, self.limits = key, limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.spent = handle.getMapState("spent", "span string, start bigint", "total double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values(["at", "cost"], kind="stable")
        before = {(k[0], int(k[1])): float(v[0]) for k, v in self.spent.iterator()}
        spans, at, cost = dict(before), pdf["at"].astype(int).tolist(), pdf["cost"].astype(float).tolist()
        out = [judged(a, c, spans, self.limits) for a, c in zip(at, cost, strict=True)]
        for span, total in spans.items():
            if before.get(span) != total:
                self.spent.updateValue(span, (total,))
            if span not in before:
                self.handle.registerTimer(span[1] + SPANS[span[0]])
        yield _frame(self.key, [key[0]] * len(out), at, cost, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        for name, size in SPANS.items():
            span = (name, expiredTimerInfo.getExpiryTimeInMs() - size)
            if self.spent.containsKey(span):
                self.spent.removeKey(span)
        yield _frame(self.key, [], [], [], [])

    def close(self) -> None:
        pass


def limited(events: DataFrame, key: str = "user_id", cost: str = "value", request: float = 0.5, hour: float = 2.0, day: float = 10.0, late: str = "10 minutes") -> DataFrame:
    """(key, ts, cost, hour_spent, day_spent, verdict) of each request (key, ts, cost) of a stream: whether it is within the limits of one request, of its hour and of its day.

    Verdicts: see `judged`. A trigger's requests of a key go by ts, then cost; later triggers' follow, even if they are older. Hours and days
    are of UTC. Requests later than the watermark are left out, as are those without ts or key; a null or negative cost counts 0. Set
    spark.sql.streaming.stateStore.providerClass to STORE first.
    """
    of = events.schema[key].dataType.simpleString()
    spent = F.greatest(F.coalesce(F.col(cost).cast("double"), F.lit(0.0)), F.lit(0.0))
    rows = events.where(F.col("ts").isNotNull() & F.col(key).isNotNull()).withWatermark("ts", late).select(key, "ts", F.unix_millis(F.col("ts").cast("timestamp")).alias("at"), spent.alias("cost"))
    return rows.groupBy(key).transformWithStateInPandas(Spending(key, (request, hour, day)), f"`{key}` {of}, {OUT}", "Append", "EventTime")


def spent(requests: DataFrame, key: str = "user_id", cost: str = "value", request: float = 0.5, hour: float = 2.0, day: float = 10.0) -> DataFrame:
    """The same verdicts over a table: each key's requests in order of ts, then cost. A key's days are apart, so they are dealt to different tasks; a day streams by."""
    of = requests.schema[key].dataType.simpleString()
    value = F.greatest(F.coalesce(F.col(cost).cast("double"), F.lit(0.0)), F.lit(0.0))
    at = F.unix_millis(F.col("ts").cast("timestamp"))
    rows = requests.where(F.col("ts").isNotNull() & F.col(key).isNotNull()).select(key, at.alias("at"), F.floor(at / DAY).alias("day"), value.alias("cost"))
    limits = (request, hour, day)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, spans = None, {}
        for pdf in batches:
            of, at, cost, out = pdf[key].tolist(), pdf["at"].tolist(), pdf["cost"].tolist(), []
            for k, a, c in zip(of, at, cost, strict=True):
                if (k, a // DAY) != now:
                    now, spans = (k, a // DAY), {}
                out.append(judged(a, c, spans, limits))
            yield _frame(key, of, at, cost, out)

    return rows.repartition(key, "day").sortWithinPartitions(key, "day", "at", "cost").mapInPandas(run, f"`{key}` {of}, {OUT}")
