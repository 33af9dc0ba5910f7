"""Native indicators: Columns over one window, so that a chain of them costs one exchange and one sort."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..plans.ranges import Step, in_pieces


def by_time(*keys: str):
    """The canonical window: a ticker's bars in order of time."""
    return Window.partitionBy(*(keys or ("ticker",))).orderBy("datetime")


def full(value: Column, over: str | Column, n: int, w) -> Column:
    """``value`` (an aggregate) over the last n rows, null unless all n are there."""
    frame = w.rowsBetween(1 - n, 0)
    over = F.col(over) if isinstance(over, str) else over
    return F.when(F.count(over).over(frame) == n, value.over(frame))


def sma(column: str, n: int, w=None) -> Column:
    return full(F.avg(column), column, n, w or by_time())


def rolling_std(column: str, n: int, w=None) -> Column:
    return full(F.stddev_samp(column), column, n, w or by_time())


def pct_change(column: str, w=None) -> Column:
    return F.try_divide(F.col(column), F.lag(column).over(w or by_time())) - 1


def next_up(column: str, w=None) -> Column:
    """1 if the next value is higher, 0 if not, null on the last row."""
    return (F.lead(column).over(w or by_time()) > F.col(column)).cast("int")


def crossover(a: Column, b: Column, w=None) -> Column:
    """a was below b one row ago and is above it now."""
    w = w or by_time()
    return F.coalesce((F.lag(a).over(w) < F.lag(b).over(w)) & (a > b), F.lit(False))


def ichimoku(high: str = "high", low: str = "low", close: str | None = None, tenkan: int = 9, kijun: int = 26, senkou_b: int = 52, displacement: int = 26, w=None) -> dict[str, Column]:
    """Conversion line, base line, both spans and both spans shifted on; the lagging line only if ``close`` is given."""
    w = w or by_time()
    middle = lambda n: F.when((F.count(high).over(w.rowsBetween(1 - n, 0)) == n) & (F.count(low).over(w.rowsBetween(1 - n, 0)) == n), (F.max(high).over(w.rowsBetween(1 - n, 0)) + F.min(low).over(w.rowsBetween(1 - n, 0))) / 2)
    a, b = (middle(tenkan) + middle(kijun)) / 2, middle(senkou_b)
    back = F.lead(close, displacement).over(w) if close else F.lit(None).cast("double")
    return {"tenkan": middle(tenkan), "kijun": middle(kijun), "span_a": a, "span_b": b, "senkou_a": a, "senkou_b": b, "chikou": back}


def with_ichimoku(bars: DataFrame, displacement: int = 26, **settings) -> DataFrame:
    """The seven lines as columns; the shifted spans are lags of the unshifted ones."""
    w = by_time()
    lines = ichimoku(displacement=displacement, w=w, **settings)
    out = bars.select("*", *(lines[c].alias(c) for c in ("tenkan", "kijun", "span_b", "chikou")))
    out = out.withColumn("span_a", (F.col("tenkan") + F.col("kijun")) / 2)
    return out.withColumns({f"senkou_{k}": F.lag(f"span_{k}", displacement).over(w) for k in "ab"})


def rogers_satchell(n: int = 30, w=None) -> Column:
    """Root of the mean of ln(h/c) ln(h/o) + ln(l/c) ln(l/o) over n bars; prices that are not positive give null."""
    ln = lambda a, b: F.ln(F.try_divide(F.col(a), F.col(b)))
    term = ln("high", "close") * ln("high", "open") + ln("low", "close") * ln("low", "open")
    return F.sqrt(full(F.sum(term), term, n, w or by_time()) / n)


def _block(n: int) -> int:
    """Rows of the blocks that windows of n rows are read from: the first of 16, 128, 1024, ... that holds one."""
    size = 16
    while size < n:
        size *= 8
    return size


def _with_moments(rows: DataFrame, column: str, size: int) -> DataFrame:
    """rows (with ``_index`` from 0) with the moments of their block of ``size`` rows as ``_m``.

    ``b`` numbers the block, ``j`` the row in it; ``o`` is the block's first value, from which all values of the block are
    measured; n, y, jy and yy are sums up to the row, tn, ty, tjy and tyy the block's, and u the row's own value.
    """
    rows = rows.withColumn("_b", F.expr(f"_index div {size}"))
    w = Window.partitionBy("ticker", "_b").orderBy("_index")
    whole, run = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), w.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"_o": F.first(column, ignorenulls=True).over(whole), "_j": (F.col("_index") - F.col("_b") * size).cast("double")})
    rows = rows.withColumns({"_u": F.coalesce(F.col(column) - F.col("_o"), F.lit(0.0)), "_k": F.col(column).isNotNull().cast("int")})
    u, j = F.col("_u"), F.col("_j")
    parts = {"n": F.sum("_k"), "y": F.sum(u), "jy": F.sum(u * j), "yy": F.sum(u * u)}
    sums = [v.over(run).alias(k) for k, v in parts.items()] + [v.over(whole).alias(f"t{k}") for k, v in parts.items()]
    return rows.withColumn("_m", F.struct(F.col("_b").alias("b"), j.alias("j"), F.col("_o").alias("o"), u.alias("u"), F.col("_k").alias("k"), *sums)).drop("_o", "_j", "_u", "_k")


def _trend_t(s: Column, e: Column, n: int, size: int) -> Column:
    """t-statistic of the slope over n rows, from the moments of its first row and of its last, in the same block or the next.

    What lies in the next block is moved to the first block's origin by exact shifts of its moments; places count from the
    window's first row. So no sum is larger than what two blocks hold, however long the series is.
    """
    same = e["b"] == s["b"]
    own = {"n": s["k"], "y": s["u"], "jy": s["u"] * s["j"], "yy": s["u"] * s["u"]}
    # the first block's rows from s on, and the next block's up to e
    a = {c: F.when(same, e[c]).otherwise(s[f"t{c}"]) - s[c] + v for c, v in own.items()}
    c = {k: F.when(same, 0.0).otherwise(e[k]) for k in own}
    shift, m = F.when(same, 0.0).otherwise(e["o"] - s["o"]), F.when(same, 0.0).otherwise(e["j"] + 1)
    sy = a["y"] + c["y"] + shift * m
    siy = a["jy"] - s["j"] * a["y"] + c["jy"] + (size - s["j"]) * c["y"] + shift * m * (2 * n - 1 - m) / 2
    syy = a["yy"] + c["yy"] + 2 * shift * c["y"] + m * shift * shift
    sxx = n * (n * n - 1) / 12
    sxy = siy - (n - 1) / 2 * sy
    rest = syy - sy * sy / n - sxy * sxy / sxx
    error = F.when(rest > 1e-13 * syy, F.sqrt(rest / (n - 2) / sxx))  # what rounding leaves of a perfect fit is no variance
    return F.when(a["n"] + c["n"] == n, sxy / sxx / error)


def trend_scan(bars: DataFrame, column: str = "close", windows: list[int] | int = [5, 10, 20, 40, 80, 120], name: str = "trend_t") -> DataFrame:  # noqa: B006
    """bars with ``trend_t``: of all windows shorter than the series the t-statistic of largest size of the slope of the next
    n values on their index, the first window on ties; null where n rows or all variance are missing.

    Moments are running sums within blocks of rows, each with an origin of its own, two blocks to a window at most; one
    exchange and, for each size of blocks, one sort within partitions, whatever the windows are.
    """
    windows = [windows] if isinstance(windows, int) else list(windows)
    whole = Window.partitionBy("ticker")
    out = bars.select("*", (F.row_number().over(by_time()) - 1).cast("long").alias("_index"), F.count("*").over(whole).alias("_n"))
    for size in sorted({_block(n) for n in windows}):
        out, mine = _with_moments(out, column, size), sorted({n for n in windows if _block(n) == size})
        ahead = Window.partitionBy("ticker").orderBy("_b", "_index")
        out = out.select("*", *(F.lead("_m", n - 1).over(ahead).alias(f"_e{n}") for n in mine))
        t = {f"_t{n}": F.when(F.col("_n") > n, _trend_t(F.col("_m"), F.col(f"_e{n}"), n, size)) for n in mine}
        out = out.withColumns(t).drop("_m", "_b", *(f"_e{n}" for n in mine))
    best = F.col(f"_t{windows[0]}")
    for n in windows[1:]:
        t = F.col(f"_t{n}")
        best = F.when(best.isNull() | (F.abs(t) > F.abs(best)), t).otherwise(best)
    return out.withColumn(name, best).drop("_index", "_n", *(f"_t{n}" for n in windows))


def ffd_weights(d: float, threshold: float = 1e-5) -> list[float]:
    """1, -d, ... until the next weight is smaller than the threshold."""
    if threshold <= 0 and d != int(d):
        raise ValueError("a threshold above 0 is needed unless d is whole")
    out, k = [1.0], 1
    while True:
        nxt = -out[-1] * (d - k + 1) / k
        if abs(nxt) < threshold or nxt == 0:
            return out
        out.append(nxt)
        k += 1


def convolved(x: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Sums of kernel[j] * x[i - len(kernel) + 1 + j] for each i with that many values, NaN where fewer or one is not finite.

    Overlap-save: blocks of four times the kernel's length, each by one Fourier transform of its own.
    """
    n, out, fine = len(kernel), np.full(len(x), np.nan), np.isfinite(x)
    if len(x) < n:
        return out
    size = 1 << max(10, (4 * n - 1).bit_length())
    own = np.fft.rfft(kernel[::-1], size)
    values = np.where(fine, x, 0.0)
    for s in range(0, len(x) - n + 1, size - n + 1):
        part = values[s : s + size]
        out[s + n - 1 : s + len(part)] = np.fft.irfft(np.fft.rfft(part, size) * own, size)[n - 1 : len(part)]
    bad = np.concatenate([[0], np.cumsum(~fine)])
    out[n - 1 :][bad[n:] > bad[:-n]] = np.nan
    return out


def frac_diff(bars: DataFrame, column: str = "close", d: float = 0.4, threshold: float = 1e-5, canonical: bool = False, name: str = "frac_diff", size: int = 65_536) -> DataFrame:
    """Fractional difference of fixed width: sum of weights times the last L values, null on the first L - 1 rows and where
    one of the values is missing.

    By default the first weight meets the oldest value; ``canonical`` has it meet the newest. Series are cut into pieces
    of ``size`` rows (eight times L, if that is more) that overlap by L - 1; each is convolved by itself, so that one path
    serves any threshold and any length.
    """
    weights = ffd_weights(d, threshold)
    kernel = np.array(weights[::-1] if canonical else weights)  # kernel[j] meets the value L - 1 - j rows ago

    def convolve(piece: pa.Table) -> pa.Table:
        piece = piece.sort_by("datetime")
        got = convolved(piece.column(column).cast(pa.float64()).to_numpy(), kernel)
        return piece.append_column(name, pa.array(got, mask=np.isnan(got)))

    def run(rows: DataFrame) -> DataFrame:
        return rows.groupBy("ticker").applyInArrow(convolve, StructType([*rows.schema.fields, StructField(name, DoubleType())]))

    return in_pieces(bars, Step(run, lookback=len(kernel) - 1), max(size, 8 * len(kernel))).select(*bars.columns, name)
