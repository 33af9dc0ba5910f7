"""Barrier labels of a stream of bars, sent as soon as they are known."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def timers(spark: SparkSession):
    """Queries begun inside keep their state in RocksDB, which timers and list states need."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


def _frame(key, rows: list[tuple[int, int, int]]) -> pd.DataFrame:
    begun, label, t1 = zip(*rows) if rows else ((), (), ())
    kinds = {"ticker": ([key[0]] * len(rows), object), "datetime": (begun, "int64"), "label": (label, "int32"), "t1": (t1, "int64")}
    return pd.DataFrame({c: pd.Series(v, dtype=kind) for c, (v, kind) in kinds.items()})


class _Barriers(StatefulProcessor):
    """Per ticker: bars that the watermark has not passed yet, and bars that have no label yet.

    Bars may come in any order within the watermark's delay. A timer at the first waiting bar's time fires once the watermark
    has passed it; then all passed bars are taken in order of time, and each decides or ages the open ones. An open bar is gone
    after ``horizon`` bars, so the state is bounded by the delay and the horizon.
    """

    def __init__(self, multiple: float, horizon: int):
        self.multiple, self.horizon = multiple, horizon

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, price double, stop double")
        self.open = handle.getListState("open", "at long, stop double, target double, ahead int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        held = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        before, times = min((r[0] for r in held), default=None), {r[0] for r in held}
        for frame in rows:
            for at, price, stop in zip(frame["at"].tolist(), frame["price"].tolist(), frame["stop"].tolist()):
                if at > passed and at not in times:  # what comes later than the watermark, or again, is left out
                    held.append((int(at), float(price), float(stop)))
                    times.add(at)
        if held:
            self.waiting.put(held)
            first = min(r[0] for r in held)
            if before is None or first < before:
                self.handle.registerTimer(first)
        yield _frame(key, [])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        held = sorted(tuple(r) for r in self.waiting.get()) if self.waiting.exists() else []
        open_ = [tuple(r) for r in self.open.get()] if self.open.exists() else []
        out, rest = [], [r for r in held if r[0] > passed]
        for at, price, stop in held[: len(held) - len(rest)]:
            open_.append((at, stop, price + self.multiple * (price - stop), -1))
            left = []
            for begun, low, high, ahead in open_:
                if price <= low or price >= high:  # never for a stop that is missing
                    out.append((begun, 0 if price <= low else 2, at))
                elif ahead + 1 == self.horizon:
                    out.append((begun, 1, at))
                else:
                    left.append((begun, low, high, ahead + 1))
            open_ = left
        for state, rows in ((self.waiting, rest), (self.open, open_)):
            if rows:
                state.put(rows)
            else:
                state.clear()
        if rest:
            self.handle.registerTimer(rest[0][0])
        yield _frame(key, out)

    def close(self) -> None:
        pass


def triple_barrier(bars: DataFrame, price: str = "close", stop: str = "sl", multiple: float = 2.0, horizon: int = 10, delay: str = "1 hour") -> DataFrame:
    """(ticker, datetime, label, t1) of a stream of bars, as ``functions.labels.triple_barrier`` gives them in batch.

    A label is sent when the watermark, ``delay`` behind the last time seen, has passed the bar that decides it; what is undecided
    waits. Bars without a price are left out; times are kept to the millisecond. Start the query inside ``timers``.
    """
    at = F.expr("unix_millis(datetime)")
    bounded = bars.withWatermark("datetime", delay).filter(F.col(price).isNotNull() & ~F.isnan(price))
    rows = bounded.select("ticker", "datetime", at.alias("at"), F.col(price).cast("double").alias("price"), F.coalesce(F.col(stop).cast("double"), F.lit(float("nan"))).alias("stop"))
    out = rows.groupBy("ticker").transformWithStateInPandas(_Barriers(multiple, horizon), "ticker string, datetime long, label int, t1 long", "Append", "EventTime")
    return out.select("ticker", F.timestamp_millis("datetime").alias("datetime"), "label", F.timestamp_millis("t1").alias("t1"))
