"""Bars from ticks and bars from bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def from_ticks(ticks: DataFrame, ticker: str, at, price: str, order: list[str]) -> DataFrame:
    """OHLC of ``price`` by ticker and time ``at``; first and last by ``order``, volume counts ticks. One partial aggregate."""
    by = F.struct(*order)
    return ticks.groupBy(F.col(ticker).alias("ticker"), at.alias("datetime")).agg(
        F.min_by(price, by).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, by).alias("close"), F.count("*").alias("volume")
    )


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as ticks: the priority is the ticker, the date the bar."""
    return from_ticks(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_orderpriority", F.col("o_orderdate"), "o_totalprice", ["o_orderkey"])


def hourly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as ticks: the type is the ticker, the hour the bar."""
    return from_ticks(spark.read.parquet(f"{sf_dir}/events.parquet"), "event_type", F.date_trunc("hour", "ts").cast("timestamp_ntz"), "value", ["ts", "event_id"])


def merge_last_hour(bars: DataFrame) -> DataFrame:
    """Folds each day's last bar into the one before it (open stays); days of one bar stay as they are."""
    w = Window.partitionBy("ticker", F.to_date("datetime")).orderBy("datetime")
    back = Window.partitionBy("ticker", F.to_date("datetime")).orderBy(F.desc("datetime"))
    rank, size = F.row_number().over(back), F.count("*").over(Window.partitionBy("ticker", F.to_date("datetime")))
    ahead = {c: F.lead(c).over(w) for c in ("high", "low", "close", "volume")}
    marked = bars.select("*", rank.alias("_rank"), size.alias("_size"), *(v.alias(f"_{c}") for c, v in ahead.items()))
    takes = F.col("_rank") == 2
    return marked.filter("_rank > 1 or _size = 1").select(
        "ticker", "datetime", "open",
        F.when(takes, F.greatest("high", "_high")).otherwise(F.col("high")).alias("high"),
        F.when(takes, F.least("low", "_low")).otherwise(F.col("low")).alias("low"),
        F.when(takes, F.col("_close")).otherwise(F.col("close")).alias("close"),
        F.when(takes, F.col("volume") + F.col("_volume")).otherwise(F.col("volume")).alias("volume"),
    )


def session_hours(bars: DataFrame, start: str, end: str, zone: str = "UTC") -> DataFrame:
    """Bars whose local time of day lies between start and end, both included."""
    local = F.date_format(F.from_utc_timestamp("datetime", zone), "HH:mm")
    return bars.filter(local.between(start, end))


def candles(bars: DataFrame) -> DataFrame:
    """What a candlestick chart draws: the rule, the body, and whether it rose."""
    return bars.select("ticker", "datetime", "low", "high", F.least("open", "close").alias("body_low"), F.greatest("open", "close").alias("body_high"), (F.col("open") <= F.col("close")).alias("is_up"))
