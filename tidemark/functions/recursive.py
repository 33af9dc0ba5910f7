"""Indicators that look back on their own last value, as scans; and callables: one pass over a ticker's bars."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..plans.ranges import positions
from .scan import scanned


def by_ticker(bars: DataFrame, outputs: list[str], fn: Callable[[pd.DataFrame], tuple]) -> DataFrame:
    """bars with double columns that ``fn`` makes of a ticker's bars in order of time; NaN becomes null.

    Filters on the ticker belong before this call: Spark does not move them below it.
    """
    kind = StructType([*bars.schema.fields, *(StructField(c, DoubleType()) for c in outputs)])

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("datetime", kind="stable")
        for name, values in zip(outputs, fn(frame)):
            values = np.asarray(values, dtype=float)
            frame[name] = pd.array(np.where(np.isfinite(values), values, 0), dtype="Float64")
            frame.loc[~np.isfinite(values), name] = pd.NA
        return frame

    return bars.groupBy("ticker").applyInPandas(run, kind)


def _finite(column: str) -> Column:
    return F.col(column).isNotNull() & ~F.isnan(column) & (F.abs(column) < F.lit(float("inf")))


def ema(bars: DataFrame, column: str = "close", n: int = 120, name: str = "ema") -> DataFrame:
    """Exponential mean with weight 2 / (n + 1), begun by the mean of the first n values; null before, and from the first
    value on that is missing. The first n terms are weighted so that they add up to that mean."""
    if n < 1:
        raise ValueError("n must be at least 1")
    k = 2 / (n + 1)
    placed = positions(bars.withColumn("_x", F.col(column).cast("double")))
    seed = F.col("_x") / n / F.pow(F.lit(1 - k), (n - 1) - F.col("_pos")) if n > 1 else F.col("_x")
    out = scanned(placed, {"_mean": F.when(F.col("_pos") < n, seed).otherwise(F.col("_x") * k)}, 1 - k, _finite("_x"))
    return out.withColumn(name, F.when(F.col("_pos") >= n - 1, F.col("_mean"))).select(*(c for c in bars.columns if c != name), name)


def rsi(bars: DataFrame, column: str = "close", n: int = 14, name: str = "rsi") -> DataFrame:
    """100 times the share of gains in all moves (0 without moves), both smoothed by 1 / n and begun by the mean of the first n
    moves; null before, and from the first value on that is missing."""
    if n < 1:
        raise ValueError("n must be at least 1")
    ratio, place = 1 - 1 / n, F.col("_pos")
    placed = positions(bars.withColumn("_x", F.col(column).cast("double")), ["_x"])
    move = F.col("_x") - F.col("_previous__x")
    weight = F.when(place <= n, 1 / F.pow(F.lit(ratio), n - place)).otherwise(1.0) / n if n > 1 else F.lit(1.0)
    side = lambda m: F.when(place > 0, F.greatest(m, F.lit(0.0)) * weight).otherwise(0.0)
    out = scanned(placed, {"_up": side(move), "_down": side(-move)}, ratio, _finite("_x"))
    share = F.when(F.col("_up") + F.col("_down") > 0, 100 * F.col("_up") / (F.col("_up") + F.col("_down"))).when(F.col("_up").isNotNull(), 0.0)
    return out.withColumn(name, F.when(place >= n, share)).select(*(c for c in bars.columns if c != name), name)


def pipe_indicator(bars: DataFrame, indicator: Callable, inputs, outputs, **settings) -> DataFrame:
    """Adds what ``indicator`` computes from the named inputs.

    ``inputs`` is a dict (argument -> column) or a list of columns. If the indicator returns Columns for column names it
    stays in the JVM; otherwise it gets arrays, ticker by ticker. One result counts as a tuple of one; names or values
    that are None are left out, and the shorter of the two lists decides; since a plan's columns are fixed before arrays
    are seen, a named output that a callable leaves out is a column of nulls.
    """
    if not isinstance(inputs, (dict, list, tuple)):
        raise ValueError("inputs must be a dict or a list of columns")
    outputs = [outputs] if isinstance(outputs, str) else list(outputs)
    call = lambda get: indicator(**{k: get(c) for k, c in inputs.items()}, **settings) if isinstance(inputs, dict) else indicator(*map(get, inputs), **settings)
    as_tuple = lambda got: got if isinstance(got, tuple) else (got,)
    if getattr(indicator, "native", False):
        made = as_tuple(call(lambda c: c))
        return bars.withColumns({n: v for n, v in zip(outputs, made) if n is not None and isinstance(v, Column)})

    names = [n for n in outputs if n is not None]

    def run(frame: pd.DataFrame) -> tuple:
        made = as_tuple(call(lambda c: frame[c].to_numpy(float)))
        by = {n: v for n, v in zip(outputs, made) if n is not None and v is not None}
        return tuple(by.get(n, np.full(len(frame), np.nan)) for n in names)

    return by_ticker(bars, names, run)


def native(fn: Callable) -> Callable:
    """Marks an indicator that takes column names and returns Columns."""
    fn.native = True
    return fn
