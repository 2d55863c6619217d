"""Stateful operators of streams as processors with named state: list, value and map state, timers that forget.

Each processor keeps what a key needs and no more, and drops it when the watermark passes the time at which it can no
longer matter; `state_rows` reads the state back from a checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Forgetting(StatefulProcessor):
    """One timer a key, moved on with each batch."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open(handle)

    def wake(self, millis: int) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(millis)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.forget()
        return iter(())

    def close(self) -> None:
        pass


class Limiter(_Forgetting):
    """Sliding window: below `limit` hits in the `seconds` before, a hit is allowed; denied hits count.

    The list keeps the hits that a row within `late` seconds may still look back on.
    """

    OUT = "user_id long, event_id long, allowed boolean"

    def __init__(self, limit: int, seconds: int, late: int):
        self.limit, self.window, self.late = limit, seconds * 10**6, late * 10**6

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.hits = handle.getListState("hits", "at long")

    def forget(self) -> None:
        self.hits.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows), ignore_index=True)
        at = new["ts"].to_numpy(np.int64)
        hits = np.sort(np.concatenate([np.array([h[0] for h in self.hits.get()], np.int64), at]))
        before = np.searchsorted(hits, at, "left") - np.searchsorted(hits, at - self.window, "left")
        last = int(hits[-1])
        self.hits.put([(int(h),) for h in hits[hits >= last - self.window - self.late]])
        self.wake((last + self.window + self.late) // 1000 + 1)
        yield pd.DataFrame({"user_id": key[0], "event_id": new["event_id"], "allowed": before < self.limit})


def _round(x: float) -> float:
    """Two places, as Spark's round has them."""
    return float(Decimal(repr(x)).quantize(Decimal("0.01"), ROUND_HALF_UP))


class Yields(StatefulProcessor):
    """Per source and run: moving average 0.7 old + 0.3 new (old 1 if none), the last four counts, and whether three in a row were nothing.

    Value state: the last run and the average; list state: the counts. A run that came already changes nothing.
    """

    OUT = "source string, run long, ema double, history string, disabled boolean"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ema = handle.getValueState("ema", "run long, ema double")
        self.history = handle.getListState("history", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last, ema = self.ema.get() if self.ema.exists() else (None, 1.0)
        history, out = [h[0] for h in self.history.get()], []
        for r in pd.concat(list(rows), ignore_index=True).sort_values("run").itertuples():
            if last is not None and r.run <= last:
                continue
            last, ema, history = int(r.run), _round(0.7 * ema + 0.3 * r.n), [*history, int(r.n)][-4:]
            out.append((key[0], last, ema, ",".join(map(str, history)), len(history) >= 3 and not any(history[-3:])))
        if out:
            self.ema.update((last, ema))
            self.history.put([(n,) for n in history])
        yield pd.DataFrame(out, columns=["source", "run", "ema", "history", "disabled"])

    def close(self) -> None:
        pass


class Expansions(_Forgetting):
    """Companies that post in a period after one without a posting, and posted in one of the three before that.

    Map state: postings by period, of the last five. Input rows are counts of closed periods (company, start in seconds, n).
    """

    OUT = "company string, start long, n long"

    def __init__(self, period: int):
        self.period = period

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.counts = handle.getMapState("counts", "start long", "n long")

    def forget(self) -> None:
        self.counts.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = {k[0]: v[0] for k, v in self.counts.iterator()}
        out = []
        for r in pd.concat(list(rows), ignore_index=True).sort_values("start").itertuples():
            start, n = int(r.start), int(r.n)
            held[start] = held.get(start, 0) + n
            self.counts.updateValue((start,), (held[start],))
            back = lambda k, start=start: held.get(start - k * self.period, 0)
            if n and not back(1) and any(back(k) for k in (2, 3, 4)):
                out.append((key[0], start, n))
        newest = max(held)
        for start in [s for s in held if s < newest - 4 * self.period]:
            self.counts.removeKey((start,))
        self.wake((newest + 5 * self.period) * 1000)
        yield pd.DataFrame(out, columns=["company", "start", "n"])


def _stated(df: DataFrame, key: str, processor: StatefulProcessor, mode: str) -> DataFrame:
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return df.groupBy(key).transformWithStateInPandas(processor, processor.OUT, "Append", mode)


def limited(events: DataFrame, limit: int, seconds: int, late: int = 3600) -> DataFrame:
    """events: user_id, event_id, ts (microseconds). A hit is judged on the hits known when it arrives.

    Hits over `late` seconds behind the newest event are dropped by the watermark. A user without hits for the window
    and that time is forgotten, so state holds only users of late.
    """
    due = F.timestamp_micros(F.col("ts") + late * 10**6)  # the first watermark is the epoch, before which no hit may be due
    return _stated(events.withColumn("at", due).withWatermark("at", f"{late} seconds"), "user_id", Limiter(limit, seconds, late), "EventTime")


def yields(counts: DataFrame) -> DataFrame:
    """counts: source, run, n. State grows with the sources, not with the runs."""
    return _stated(counts.select("source", F.col("run").cast("long").alias("run"), F.col("n").cast("long").alias("n")), "source", Yields(), "None")


def expansions(counts: DataFrame, period: int = 7 * 86400) -> DataFrame:
    """counts: company, start (seconds, of a period), n; periods arrive in order, or up to one late. Companies silent for five periods are forgotten."""
    timed = counts.select("company", F.col("start").cast("long").alias("start"), F.col("n").cast("long").alias("n")).withColumn("at", F.timestamp_seconds("start"))
    return _stated(timed.withWatermark("at", f"{period} seconds"), "company", Expansions(period), "EventTime")


def state_rows(spark: SparkSession, checkpoint: str, name: str) -> DataFrame:
    """The rows that a processor's state holds after the last batch, as the checkpoint has them."""
    return spark.read.format("statestore").option("stateVarName", name).load(checkpoint)
