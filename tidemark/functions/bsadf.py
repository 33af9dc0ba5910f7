"""Backward supremum of augmented Dickey-Fuller statistics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .windows import by_time

MODELS = ("linear", "quadratic", "sm_poly_1", "sm_poly_2", "sm_exp", "sm_power")


def adf_design(bars: DataFrame, column: str = "close", lags: int | list[int] = 1, add_const: bool = False) -> DataFrame:
    """(ticker, datetime, dy, y_lagged, dy_lag_k..., [const], trend) of the rows where all of them exist, by lags in one window."""
    w = by_time()
    lags = list(range(1, lags + 1)) if isinstance(lags, int) else list(lags)
    out = bars.select("ticker", "datetime", F.lag(column).over(w).alias("y_lagged"), (F.col(column) - F.lag(column).over(w)).alias("dy"))
    out = out.select("*", *(F.lag("dy", k).over(w).alias(f"dy_lag_{k}") for k in lags)).na.drop()
    if add_const:
        out = out.withColumn("const", F.lit(1.0))
    return out.withColumn("trend", F.row_number().over(Window.partitionBy("ticker").orderBy("datetime")) - 1)


def regressors(bars: DataFrame, column: str, model: str, lags: list[int], add_const: bool) -> DataFrame:
    """(ticker, datetime, t, z): the rows of the regression, numbered from 0, with the tested regressor first and the target last."""
    if model not in MODELS:
        raise ValueError(f"unknown model {model}")
    w, most = by_time(), max(lags)
    y = F.col("y")
    rows = bars.select("ticker", "datetime", F.col(column).cast("double").alias("y")).filter(y.isNotNull() & ~F.isnan("y"))
    rows = rows.select("*", (F.row_number().over(w) - 1 - (most + 1)).cast("double").alias("t"), F.lag("y").over(w).alias("before"), (y - F.lag("y").over(w)).alias("dy"))
    rows = rows.select("*", *(F.lag("dy", k).over(w).alias(f"dy_{k}") for k in lags)).filter("t >= 0")
    one, t, log = F.lit(1.0), F.col("t"), lambda c: F.coalesce(F.ln(c), F.lit(float("nan")))
    if model in ("linear", "quadratic"):
        z = [F.col("before"), *(F.col(f"dy_{k}") for k in lags), *([one] if add_const else []), t, *([t * t] if model == "quadratic" else []), F.col("dy")]
    else:
        level = y if model == "sm_poly_1" else log(y)
        z = {"sm_exp": [t, one], "sm_power": [log(F.greatest(t, one)), one]}.get(model, [t * t, one, t]) + [level]
    return rows.select("ticker", "datetime", F.col("t").cast("long").alias("t"), F.array(*z).alias("z"))


def _sweep(m: np.ndarray, n: np.ndarray, phi: float, absolute: bool) -> np.ndarray:
    """t-statistics of the first coefficient from stacked moments (regressors and target in one matrix), over n rows each.

    All other regressors are eliminated one by one, in all windows at once; what is left are the moments of the first and the
    target without them. A window whose regressors depend on one another gives NaN.
    """
    k, first = m.shape[1] - 1, np.einsum("sii->si", m).copy()
    bad = np.zeros(len(m), bool)
    for p in range(1, k):
        pivot = m[:, p, p]
        bad |= ~(pivot > 1e-13 * first[:, p])
        m = m - m[:, :, p, None] * (m[:, None, p, :] / pivot[:, None, None])
    s, r, q = m[:, 0, 0], m[:, 0, k], m[:, k, k]
    bad |= ~(s > 1e-14 * first[:, 0])
    sd = np.sqrt((q - r * r / s) / np.maximum(n - k, 1) / s)
    stat = np.where((sd > 1e-8) & ~bad, r / s / sd, np.nan)
    stat = np.abs(stat) if absolute else stat
    return stat / n**phi if phi > 0 else stat


def tile(starts: tuple[np.ndarray, np.ndarray], ends: tuple[np.ndarray, np.ndarray] | None, middle: np.ndarray | None, min_length: int, phi: float, absolute: bool) -> np.ndarray:
    """For each end the largest statistic over windows of at least ``min_length`` rows that begin at one of the starts; NaN if
    one of them cannot be solved, -inf if there is none.

    Both are (numbers, rows of regressors and target) of a block; ``middle`` has the moments of the blocks between. Without
    ``ends`` the block's own rows are the ends.
    """
    t, z = starts
    products = z[:, :, None] * z[:, None, :]
    if ends is None:
        upto = np.concatenate([np.zeros((1, *products.shape[1:])), np.cumsum(products, axis=0)])
    else:
        rest = np.cumsum(products[::-1], axis=0)[::-1] + middle
        upto = np.cumsum(ends[1][:, :, None] * ends[1][:, None, :], axis=0)
    out = np.full(len(t if ends is None else ends[0]), -np.inf)
    with np.errstate(all="ignore"):
        for i, end in enumerate(t if ends is None else ends[0]):
            n = end - t + 1
            some = np.flatnonzero(n >= min_length)
            if len(some):
                m = upto[i + 1] - upto[some] if ends is None else rest[some] + upto[i]
                out[i] = _sweep(m, n[some], phi, absolute).max()
    return out


def statistics(x: np.ndarray, y: np.ndarray, min_length: int, phi: float, absolute: bool, ends: range) -> np.ndarray:
    """``tile`` over all starts and the ends asked for, of one short series."""
    got = tile((np.arange(len(y)), np.column_stack([x, y])), None, None, min_length, phi, absolute)[list(ends)]
    return np.where(np.isneginf(got), np.nan, got)


def bsadf(bars: DataFrame, column: str = "close", model: str = "linear", lags: int | list[int] = 1, min_length: int | None = 20, add_const: bool = False, phi: float = 0.0, block: int = 512) -> DataFrame:
    """(ticker, datetime, bsadf) without the first ``min_length`` regression rows.

    The triangle of all (start, end) pairs of a series is cut into tiles of ``block`` starts and ``block`` ends. A tile's task
    gets the rows of its two blocks, and one row of moments: those of all blocks between, added up beforehand, from one
    row a block. No task holds a series, and no moment is the difference of two sums over a series.
    """
    if not min_length:
        raise ValueError("min_length is needed")
    lags = list(range(1, lags + 1)) if isinstance(lags, int) else list(lags)
    rows = regressors(bars, column, model, lags, add_const).withColumn("b", F.expr(f"t div {block}"))
    width = {"linear": 2 + len(lags) + add_const, "quadratic": 3 + len(lags) + add_const, "sm_exp": 2, "sm_power": 2}.get(model, 3) + 1
    pairs = [(i, j) for i in range(width) for j in range(i, width)]
    sums = rows.groupBy("ticker", "b").agg(*(F.sum(F.col("z")[i] * F.col("z")[j]).alias(f"m{k}") for k, (i, j) in enumerate(pairs)))
    last = sums.groupBy("ticker").agg(F.max("b").alias("last"))
    near = (F.col("e") - F.col("s") + 1) * block >= min_length
    # moments strictly between two blocks, from a running sum for each first block
    later = sums.join(sums.select("ticker", F.col("b").alias("s")), "ticker").filter("b > s").withColumnRenamed("b", "e")
    run = Window.partitionBy("ticker", "s").orderBy("e").rowsBetween(Window.unboundedPreceding, -1)
    between = F.array(*(F.coalesce(F.sum(f"m{k}").over(run), F.lit(0.0)) for k in range(len(pairs))))
    kind = bars.schema["datetime"].dataType
    middle = later.select("ticker", "s", "e", F.lit(1).alias("side"), F.lit(None).cast(kind).alias("datetime"), F.lit(0).cast("long").alias("t"), between.alias("z"))
    whole = rows.join(last, "ticker")
    first = whole.select("ticker", F.col("b").alias("s"), F.explode(F.sequence("b", "last")).alias("e"), F.lit(0).alias("side"), "datetime", "t", "z")
    second = whole.filter("b > 0").select("ticker", F.explode(F.sequence(F.lit(0).cast("long"), F.col("b") - 1)).alias("s"), F.col("b").alias("e"), F.lit(2).alias("side"), "datetime", "t", "z")
    dealt = first.union(middle).union(second).filter(near)
    absolute, upper = model.startswith("sm"), tuple(np.array(pairs).T)

    def run_tile(key, table):
        table = table.sort_by([("side", "ascending"), ("t", "ascending")])
        side, t = table.column("side").to_numpy(), table.column("t").to_numpy()
        z = table.column("z").combine_chunks()
        flat, offsets = z.values.to_numpy(zero_copy_only=False), z.offsets.to_numpy()
        part = lambda k: (t[side == k], flat[offsets[:-1][side == k][0] : offsets[1:][side == k][-1]].reshape(-1, width))
        if key[1].as_py() == key[2].as_py():
            got, own = tile(part(0), None, None, min_length, phi, absolute), side == 0
        else:
            m = np.zeros((width, width))
            (at,) = np.flatnonzero(side == 1)
            m[upper] = m[upper[::-1]] = flat[offsets[at] : offsets[at + 1]]
            got, own = tile(part(0), part(2), m, min_length, phi, absolute), side == 2
        keep = ~np.isneginf(got)
        rest = table.select(["ticker", "datetime", "t"]).filter(pa.array(own)).filter(pa.array(keep))
        return rest.append_column("stat", pa.array(got[keep], pa.float64()))

    kinds = T.StructType([bars.schema["ticker"], T.StructField("datetime", kind), T.StructField("t", T.LongType()), T.StructField("stat", T.DoubleType())])
    found = dealt.groupBy("ticker", "s", "e").applyInArrow(run_tile, kinds)
    best = F.max("stat")  # NaN is above all numbers
    out = found.groupBy("ticker", "datetime").agg(F.when(~F.isnan(best), best).alias("bsadf"), F.max("t").alias("t"))
    return out.filter(F.col("t") >= min_length).select("ticker", "datetime", "bsadf")
