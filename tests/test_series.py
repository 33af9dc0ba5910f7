"""Long series: anchored moments, scans in blocks, convolution in pieces."""

import contextlib
import io

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import recursive, scan, windows
from tidemark.plans.ranges import positions
from tidemark.sources import bars as B

from .test_market import DAY, frame, values, walk


def slopes(y: np.ndarray, n: int) -> np.ndarray:
    """t-statistics by direct regression on values less each window's mean."""
    v = np.lib.stride_tricks.sliding_window_view(y, n).astype(float)
    v, i = v - v.mean(1)[:, None], np.arange(n) - (n - 1) / 2
    sxx = (i * i).sum()
    b = v @ i / sxx
    rest = ((v - b[:, None] * i) ** 2).sum(1)
    return b / np.sqrt(rest / (n - 2) / sxx)


def long_frame(spark, x, ticker="A"):
    rows = spark.range(len(x)).select(F.lit(ticker).alias("ticker"), F.timestamp_seconds(F.lit(1_600_000_000) + F.col("id") * 60).alias("datetime"), "id")
    values_ = spark.createDataFrame(__import__("pandas").DataFrame({"id": np.arange(len(x)), "close": x}))
    return rows.join(values_, "id").drop("id")


def test_trend_scan_keeps_its_digits_on_a_long_series(spark):
    x = 1e4 + np.cumsum(np.random.default_rng(0).normal(size=1_000_000))
    got = windows.trend_scan(long_frame(spark, x), "close", [5]).orderBy("datetime").select("trend_t").toPandas()["trend_t"].to_numpy()
    want = slopes(x, 5)
    assert np.isnan(got[-4:]).all() and np.isfinite(got[:-4]).all()
    assert (np.abs(got[:-4] - want) / np.maximum(1e-3, np.abs(want))).max() < 1e-6


def test_trend_scan_over_blocks_of_several_sizes(spark):
    x = 50 + np.cumsum(np.random.default_rng(1).normal(size=700))
    x[300:] += 1e3  # a jump inside a block
    for n in (3, 16, 17, 128, 129, 500):
        got = values(windows.trend_scan(frame(spark, x.tolist()), "close", n), "trend_t")
        assert got[: 700 - n + 1] == pytest.approx(slopes(x, n).tolist(), rel=1e-6) and got[700 - n + 1 :] == [None] * (n - 1)
    both = values(windows.trend_scan(frame(spark, x.tolist()), "close", [20, 3, 200]), "trend_t")
    t = [np.concatenate([slopes(x, n), np.zeros(n - 1)]) for n in (20, 3, 200)]
    want = np.array(t)[np.argmax(np.abs(t), axis=0), np.arange(700)]
    assert both[:698] == pytest.approx(want[:698].tolist(), rel=1e-6) and both[698:] == [None, None]


def test_trend_scan_with_gaps_and_no_variance(spark):
    x = [1.0, 2.0, 4.0, None, 5.0, 6.0, 6.5] + [3.0] * 20 + [float(i) for i in range(20)] + [None] * 40 + walk(10)
    got = values(windows.trend_scan(frame(spark, x), "close", 3), "trend_t")
    for i in range(len(x) - 2):
        part = x[i : i + 3]
        if None in part or abs(part[0] - 2 * part[1] + part[2]) < 1e-12:
            assert got[i] is None
        else:
            assert got[i] == pytest.approx(slopes(np.array(part), 3)[0], rel=1e-6)
    assert windows.trend_scan(frame(spark, []), "close", 3).count() == 0


def folded(x, n):
    out = [None] * (n - 1) + [float(np.mean(x[:n]))]
    for v in x[n:]:
        out.append(out[-1] + (v - out[-1]) * 2 / (n + 1))
    return out


@pytest.mark.parametrize("n", [1, 2, 7, 30])
def test_ema_is_the_recursion_over_many_blocks(spark, n):
    x = walk(900)
    assert scan.block_rows(1 - 2 / (n + 1)) < 300
    assert values(recursive.ema(frame(spark, x), "close", n), "ema") == pytest.approx(folded(x, n))


def folded_rsi(x, n):
    move = np.diff(x)
    up, down = np.maximum(move, 0), np.maximum(-move, 0)
    a, b, out = up[:n].mean(), down[:n].mean(), [None] * n
    for i in range(n, len(x)):
        if i > n:
            a, b = a + (up[i - 1] - a) / n, b + (down[i - 1] - b) / n
        out.append(100 * a / (a + b) if a + b > 0 else 0.0)
    return out


@pytest.mark.parametrize("n", [1, 3, 14])
def test_rsi_is_the_recursion_over_many_blocks(spark, n):
    x = walk(800)
    assert values(recursive.rsi(frame(spark, x), "close", n), "rsi") == pytest.approx(folded_rsi(np.array(x), n), abs=1e-7)


def test_what_is_missing_stays_missing(spark):
    x = walk(400)
    x[250] = None
    got = values(recursive.ema(frame(spark, x), "close", 3), "ema")
    assert got[249] is not None and set(got[250:]) == {None}
    x[250] = float("nan")
    assert set(values(recursive.rsi(frame(spark, x), "close", 3), "rsi")[250:]) == {None}
    assert values(recursive.ema(frame(spark, walk(4)), "close", 5), "ema") == [None] * 4
    assert recursive.rsi(frame(spark, []), "close", 5).count() == 0


def test_scans_stay_in_the_jvm_and_deal_a_series_to_blocks(spark, sf):
    bars = B.daily_bars(spark, sf)
    for df in (recursive.ema(bars, "close", 5), recursive.rsi(bars, "close", 5)):
        with contextlib.redirect_stdout(io.StringIO()) as plan:
            df.explain("formatted")
        assert "Python" not in plan.getvalue() and "Pandas" not in plan.getvalue() and "Arrow" not in plan.getvalue()
        assert "_block" in plan.getvalue()


def test_a_large_start_fades(spark):
    x = np.concatenate([[1e12], np.random.default_rng(2).normal(size=600)])
    got = values(recursive.ema(frame(spark, x.tolist()), "close", 5), "ema")
    assert got[-300:] == pytest.approx(folded(x, 5)[-300:], rel=1e-9)


def test_positions(spark):
    df = frame(spark, walk(100)).unionByName(frame(spark, walk(40)).withColumn("ticker", F.lit("B")))
    for t, n in (("A", 100), ("B", 40)):
        rows = positions(df, ["close"]).filter(F.col("ticker") == t).orderBy("datetime").collect()
        assert [r["_pos"] for r in rows] == list(range(n))
        assert [r["_previous_close"] for r in rows] == [None] + [r.close for r in rows[:-1]]


@pytest.mark.parametrize("canonical", [False, True])
def test_frac_diff_at_any_threshold(spark, canonical):
    x = walk(4000)
    for threshold, size in ((1e-2, 100), (1e-5, 65_536), (1e-5, 1)):
        w = windows.ffd_weights(0.4, threshold)
        kernel = np.array(w[::-1] if canonical else w)
        got = values(windows.frac_diff(frame(spark, x), "close", 0.4, threshold, canonical, size=size), "frac_diff")
        assert got[: len(w) - 1] == [None] * (len(w) - 1)
        assert np.allclose(np.array(got[len(w) - 1 :], float), np.convolve(x, kernel[::-1], "valid"), atol=1e-8)
    assert len(windows.ffd_weights(0.4, 1e-5)) == 1458


def test_frac_diff_leaves_out_windows_with_gaps(spark):
    x = walk(200)
    x[90] = None
    n = len(windows.ffd_weights(0.4, 1e-2))
    got = values(windows.frac_diff(frame(spark, x), "close", 0.4, 1e-2), "frac_diff")
    assert [v is None for v in got] == [i < n - 1 or 90 <= i < 90 + n for i in range(200)]
    assert windows.frac_diff(frame(spark, []), "close").count() == 0 and DAY
