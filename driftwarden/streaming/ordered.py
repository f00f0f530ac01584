"""EWMA per user over hours that arrive in any order: a state processor with event-time timers."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from .. import fixed_values as fv

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def keyed_state(spark: SparkSession):
    """Queries started inside keep their state in RocksDB, which state processors need and which holds it outside the heap."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


class OrderedEwma(StatefulProcessor):
    """Holds a user's hours until the watermark has passed them, then folds them in order of time.

    State per user: the last value with its hour, and the list of hours that wait.  A timer per waiting hour
    folds all hours that the watermark has passed; one more timer, `idle_us` after the last folded hour, drops the user's state
    if no hour has come since, so that the next one begins anew.  All times are in microseconds.
    """

    def __init__(self, key: str, key_type: str, value: str, lam: float, idle_us: int):
        self.key, self.key_type, self.value, self.lam, self.idle_us = key, key_type, value, lam, idle_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "state double, folded long")
        self.waiting = handle.getListState("waiting", "hour long, x double")

    def _rows(self, key, hours, x, prev, new, dev) -> pd.DataFrame:
        out = pd.DataFrame({self.key: [key[0]] * len(hours), "us": hours, self.value: x})
        for name, values in (("ewma_previous", prev), ("ewma_new", new), ("ewma_deviation", dev)):
            out[name] = pd.Series(values, dtype=float)
        return out

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        folded = self.last.get()[1] if self.last.exists() else None
        for pdf in rows:
            late = (pdf["us"] <= folded) if folded is not None else pd.Series(False, index=pdf.index)
            keep = pdf[~late]
            self.waiting.appendList([(int(h), float(x)) for h, x in zip(keep["us"], keep[self.value])])
            for hour in set(keep["us"].tolist()):
                self.handle.registerTimer(int(hour) // 1000)
            if late.any():          # behind an hour that is folded already: returned, not folded
                lost, none = pdf[late], [None] * int(late.sum())
                yield self._rows(key, lost["us"].tolist(), lost[self.value].astype(float).tolist(), none, none, none)

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()) * 1000
        held = sorted(tuple(r) for r in self.waiting.get()) if self.waiting.exists() else []
        ready, later = [r for r in held if r[0] <= passed], [r for r in held if r[0] > passed]
        state, folded = self.last.get() if self.last.exists() else (None, None)
        if not ready:
            if not later and folded is not None and passed >= folded + self.idle_us:
                self.last.clear()
            return
        prev, new, dev = [], [], []
        for _, x in ready:
            start = x if state is None else state
            prev.append(start)
            dev.append(0.0 if state is None else (x - start) / max(start, fv.EWMA_STATE_FLOOR))
            state = x if state is None else self.lam * x + (1.0 - self.lam) * start
            new.append(state)
        self.last.update((state, ready[-1][0]))
        if later:
            self.waiting.put(later)
        else:
            self.waiting.clear()
        self.handle.registerTimer((ready[-1][0] + self.idle_us) // 1000)
        yield self._rows(key, [h for h, _ in ready], [x for _, x in ready], prev, new, dev)


def ordered_ewma(sessions: DataFrame, value: str, lam: float = fv.EWMA_LAMBDA, key: str = "user_id", time: str = "hour",
                 delay: str = "1 day", idle_days: float = 90.0) -> DataFrame:
    """EWMA per user, equal to the batch scan whatever order the hours arrive in, as long as none is more than `delay` behind.

    An hour is returned once the watermark has passed it; rows behind the watermark are dropped by Spark and counted in the
    progress of the query.  A user without an hour for `idle_days` begins anew.  Start the query inside `keyed_state`.
    """
    kinds = dict(sessions.dtypes)
    rows = (sessions.withWatermark(time, delay).filter(F.col(key).isNotNull() & F.col(value).isNotNull())
            .select(key, time, F.unix_micros(time).alias("us"), F.col(value).cast("double").alias(value)))
    processor = OrderedEwma(key, kinds[key], value, lam, int(idle_days * 86_400_000_000))
    out = rows.groupBy(key).transformWithStateInPandas(
        statefulProcessor=processor, outputMode="Append", timeMode="EventTime",
        outputStructType=f"{key} {kinds[key]}, us long, {value} double, ewma_previous double, ewma_new double, ewma_deviation double")
    return out.select(key, F.timestamp_micros("us").alias(time), value, "ewma_previous", "ewma_new", "ewma_deviation")
