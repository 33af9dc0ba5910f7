"""Bars and ticks as streams: file sources, watermarks, a checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.bars import from_ticks


def read(spark: SparkSession, path: str, files_a_trigger: int = 64) -> DataFrame:
    """New Parquet files below ``path`` as a stream; times without a zone count as UTC instants."""
    kind = spark.read.parquet(path).schema
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", files_a_trigger).parquet(path)
    return stream.withColumns({f.name: F.col(f.name).cast("timestamp") for f in kind if f.dataType.typeName() == "timestamp_ntz"})


def unique_bars(stream: DataFrame, delay: str = "7 days", keys: tuple[str, ...] = ("ticker", "datetime")) -> DataFrame:
    """Each key once; state is kept no longer than the watermark."""
    return stream.withWatermark(keys[-1], delay).dropDuplicatesWithinWatermark(list(keys))


def hourly(ticks: DataFrame, ticker: str, at: str, price: str, order: list[str], delay: str = "1 hour") -> DataFrame:
    """Hour bars of a tick stream; in append mode an hour appears once the watermark has passed its end."""
    late = ticks.withWatermark(at, delay)
    bars = from_ticks(late, ticker, F.window(at, "1 hour"), price, order)
    return bars.select("ticker", F.col("datetime.start").alias("datetime"), "open", "high", "low", "close", "volume")


def run_once(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Takes all there is, appends it to Parquet, remembers how far it came; call again for what is new."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start()
    query.awaitTermination()
    return query


def position_state(signals: DataFrame, cash: float = 10_000.0, commission: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """(ticker, datetime, units, cash) after each signal of a stream, one account a ticker, kept in the state store.

    Fills are the broker's with ``trade_on_close`` and without an end; a trigger's rows of a ticker are taken in order of time.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    fee, rate = commission

    def step(key, frames, state):
        import pandas as pd

        units, money = state.get if state.exists else (0, cash)
        out = []
        if parts := list(frames):  # one trigger's rows of a ticker, which come in any order
            for row in pd.concat(parts).sort_values("datetime").itertuples():
                able = int(max(0.0, money - fee) // (row.close * (1 + rate))) if row.close > 0 else 0
                if row.signal > 0 and not units and able:
                    units = able
                    money -= units * row.close + (fee + rate * units * row.close)
                elif row.signal < 0 and units:
                    money, units = money + (units * row.close - (fee + rate * units * row.close)), 0
                out.append((key[0], row.datetime, units, money))
            state.update((units, money))
        yield pd.DataFrame(out, columns=["ticker", "datetime", "units", "cash"])

    return signals.select("ticker", "datetime", "close", "signal").groupBy("ticker").applyInPandasWithState(
        step, "ticker string, datetime timestamp, units long, cash double", "units long, cash double", "append", GroupStateTimeout.NoTimeout
    )
