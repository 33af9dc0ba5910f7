"""Many assets on one grid."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def union_assets(frames: dict[str, DataFrame], key: str = "ticker") -> DataFrame:
    """All frames under each other, with their name as a column; rows with a null are dropped."""
    parts = [df.withColumn(key, F.lit(name)) for name, df in frames.items()]
    return reduce(lambda a, b: a.unionByName(b), parts).na.drop("any")


def align(rows: DataFrame, columns: list[str] | None = None, key: str = "ticker", time: str = "datetime") -> DataFrame:
    """Every time with every asset; gaps take the asset's last value, what has none yet is dropped.

    The grid is the product of two distinct lists, made by exploding the (short) list of assets on each time. ``columns``
    limits what is carried forward; by default everything is.
    """
    names = [c for c in rows.columns if c not in (key, time)]
    carried = names if columns is None else columns
    assets = rows.select(key).distinct().agg(F.collect_set(key).alias("_assets"))  # one row: the assets, not their bars
    grid = rows.select(time).distinct().join(F.broadcast(assets)).select(time, F.explode("_assets").alias(key))
    w = Window.partitionBy(key).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    full = grid.join(rows, [time, key], "left")
    return full.select(time, key, *(F.last(c, ignorenulls=True).over(w).alias(c) if c in carried else F.col(c) for c in names)).na.drop("any")


def cutoff_split(rows: DataFrame, cutoff, time: str = "datetime", t1: str | None = None) -> DataFrame:
    """rows with ``role``: train before the cutoff, test from it on; with ``t1``, training labels that reach it are purged."""
    role = F.when(F.col(time) >= F.lit(cutoff), "test").otherwise("train")
    if t1:
        role = F.when((role == "train") & (F.col(t1) >= F.lit(cutoff)), "purged").otherwise(role)
    return rows.withColumn("role", role)


def returns_long(bars: DataFrame, column: str = "close") -> DataFrame:
    """(datetime, ticker, ret) of the bars that have one before them."""
    w = Window.partitionBy("ticker").orderBy("datetime")
    return bars.select("datetime", "ticker", (F.try_divide(F.col(column), F.lag(column).over(w)) - 1).alias("ret")).filter("ret is not null")


def returns_matrix(returns: DataFrame, tickers: list[str]) -> DataFrame:
    """One column an asset, only times that all of them have."""
    return returns.groupBy("datetime").pivot("ticker", tickers).agg(F.first("ret")).na.drop("any")
