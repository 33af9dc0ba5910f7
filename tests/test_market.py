"""Hand-computed cases and brute force for the market operators."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from tidemark import queries as market
from tidemark import schema
from tidemark.functions import bsadf, labels, recursive, windows
from tidemark.operators import backtest, learning, panel, portfolio, splits
from tidemark.plans.ranges import Step, in_pieces, query
from tidemark.sources import bars as B
from tidemark.sources import store, universe, vendor
from tidemark.streaming import ingest

DAY = datetime(2023, 1, 2)


def frame(spark, closes, ticker="A", step=timedelta(days=1), **columns):
    rows = [{"ticker": ticker, "datetime": DAY + i * step, "open": c, "high": None if c is None else c * 1.01, "low": None if c is None else c * 0.99, "close": c, "volume": 100.0} | {k: v[i] for k, v in columns.items()} for i, c in enumerate(closes)]
    kinds = "ticker string, datetime timestamp, open double, high double, low double, close double, volume double" + "".join(f", {k} double" for k in columns)
    return spark.createDataFrame([tuple(r[c.split()[0]] for c in kinds.split(", ")) for r in rows], kinds)


def values(df, column):
    return [r[column] for r in df.orderBy("ticker", "datetime").collect()]


def walk(n, seed=42):
    return (100 * np.cumprod(1 + np.random.default_rng(seed).normal(0, 0.01, n))).tolist()


def test_last_bar_is_merged(spark):
    rows = [("A", datetime(2023, 1, 1, 15), 1.0, 100.0, 90.0, 95.0, 1000.0), ("A", datetime(2023, 1, 1, 16), 2.0, 102.0, 95.0, 98.0, 500.0), ("A", datetime(2023, 1, 2, 15), 3.0, 9.0, 8.0, 8.5, 7.0)]
    got = B.merge_last_hour(spark.createDataFrame(rows, schema.BARS)).orderBy("datetime").collect()
    assert [tuple(r)[2:] for r in got] == [(1.0, 102.0, 90.0, 98.0, 1500.0), (3.0, 9.0, 8.0, 8.5, 7.0)]


def test_store(spark, tmp_path):
    market = store.MarketStore(spark, f"file://{tmp_path}")
    days = pd.date_range("2023-01-01", periods=5)
    calls = []

    def fetch(ticker, start, stop, interval):
        calls.append((start, interval))
        n = 2 if len(calls) == 1 else 4
        return spark.createDataFrame(pd.DataFrame({"Date": days[:n], "Open": range(10, 10 + n), "High": range(15, 15 + n), "Low": range(9, 9 + n), "Close": range(12, 12 + n), "Volume": 1000}))

    assert market.get_data("TEST.AX").count() == 0
    market.add_ticker("TEST.AX", fetch, interval="1d")
    market.add_ticker("TEST.AX", fetch)
    assert calls[1][1] == "1d" and calls[1][0] is not None
    got = market.get_data("TEST.AX").collect()
    assert len(got) == 4 and got[0].Open == 10.0 and [r.Close for r in got] == [12.0, 13.0, 14.0, 15.0]
    assert [r.ticker for r in market.tickers().collect()] == ["TEST.AX"]
    assert "PartitionFilters: [isnotnull(ticker" in market.prices(["TEST.AX"])._jdf.queryExecution().toString()
    with pytest.raises(ValueError):
        schema.normalise(spark.createDataFrame([(1,)], "Open int"), "X")


def test_vendor_source(spark):
    spark.dataSource.register(vendor.VendorSource)
    reader = vendor.VendorReader({"tickers": "A,B", "years": "2023"})
    assert [(p.ticker, p.start, p.stop) for p in reader.partitions()][3:5] == [("A", "2023-10-01", "2024-01-01"), ("B", "2023-01-01", "2023-04-01")]


def test_universe(spark):
    got = {r.index_name: r["count"] for r in universe.members(spark).groupBy("index_name").count().collect()}
    assert got == {"asx20": 20, "asx50": 50, "asx100": 100, "asx200": 207}
    bars = frame(spark, [1.0, 2.0])
    assert universe.chosen(bars, "all").count() == universe.chosen(bars, ["A", "B"]).count() == 2
    assert [r.ticker for r in universe.absent(bars, ["A", "B"]).collect()] == ["B"]


def test_windows_against_pandas(spark):
    x = walk(120)
    x[50] = None
    df = frame(spark, x)
    got = df.select("*", windows.sma("close", 10).alias("s"), windows.rolling_std("close", 5).alias("d"), windows.rogers_satchell(30).alias("v"))
    s = pd.Series(x, dtype=float)
    for name, want in (("s", s.rolling(10).mean()), ("d", s.rolling(5).std())):
        assert np.allclose([np.nan if v is None else v for v in values(got, name)], want, equal_nan=True)
    v = values(got, "v")
    assert v[:29] == [None] * 29 and v[29] is not None and v[60] is None and v[85] is not None  # one gap spoils 30 rows, not all


def test_ichimoku_shift(spark):
    df = windows.with_ichimoku(frame(spark, walk(100)))
    a, s = values(df, "span_a"), values(df, "senkou_a")
    assert s[26:] == a[:-26] and s[:26] == [None] * 26 and values(df, "chikou") == [None] * 100


def test_weights(spark):
    assert len(windows.ffd_weights(0.4, 1e-3)) == 55
    with pytest.raises(ValueError):
        windows.ffd_weights(0.4, 0)


def test_trend_scan(spark):
    x = walk(60)
    got = values(windows.trend_scan(frame(spark, x), "close", [5, 10, 60]), "trend_t")

    def t(y):
        i = np.arange(len(y))
        b, a = np.polyfit(i, y, 1)
        r = y - a - b * i
        return b / np.sqrt((r @ r) / (len(y) - 2) / ((i - i.mean()) ** 2).sum())

    for k in range(60):
        all_t = [t(np.array(x[k : k + w])) for w in (5, 10) if k + w <= 60]  # a window as long as the series is left out
        assert (got[k] is None) == (not all_t)
        if all_t:
            assert got[k] == pytest.approx(max(all_t, key=abs), rel=1e-6)


def barrier_brute(p, sl, m, h):
    out = []
    for i in range(len(p)):
        ahead = p[i : i + h + 1]
        hit = next(((j, 0 if v <= sl[i] else 2) for j, v in enumerate(ahead) if sl[i] is not None and (v <= sl[i] or v >= p[i] + m * (p[i] - sl[i]))), None)
        out.append((hit[1], i + hit[0]) if hit else (1, i + h) if i + h < len(p) else (None, None))
    return out


def test_triple_barrier(spark):
    p = walk(80, 1)
    sl = [v * 0.98 for v in p]
    sl[5], sl[6], sl[7] = None, p[6], p[7] + 1
    df = labels.triple_barrier(frame(spark, p, sl=sl), "close", "sl", 3.0, 10)
    got = [(r.label, None if r.t1 is None else (r.t1 - DAY).days) for r in df.orderBy("datetime").collect()]
    assert got == barrier_brute(p, sl, 3.0, 10)
    assert got[5][0] == 1 and got[6][0] == 0 and got[7][0] == 0
    assert values(labels.triple_barrier(frame(spark, p, sl=[float("nan")] * 80), "close", "sl", 3.0, 10), "label")[:70] == [1] * 70


def weights_brute(t0, t1):
    rows = sorted((a, b) for a, b in zip(t0, t1) if b is not None)
    starts = [a for a, _ in rows]
    n = len(rows)
    end = [sum(s <= b for s in starts) for _, b in rows]
    diff = np.zeros(n + 1)
    for s, e in enumerate(end):
        diff[s] += 1
        diff[min(e, n)] -= 1
    c = np.cumsum(diff)[:-1]
    u = np.array([1 / v if v > 0 else 0 for v in c])
    return [float(np.mean(u[s:e])) if e > s else 0.0 for s, e in enumerate(end)]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.one_of(st.none(), st.integers(-3, 12))), min_size=1, max_size=25, unique_by=lambda t: t[0]))
def test_sample_weights(spark, events):
    at = lambda d: DAY + timedelta(days=d)
    rows = [("A", at(a), None if b is None else at(a + b), -2.0) for a, b in events]
    df = spark.createDataFrame(rows, "ticker string, t0 timestamp, t1 timestamp, r double")
    got = [r.weight for r in labels.sample_weights(df).orderBy("t0").collect()]
    assert got == pytest.approx(weights_brute([a for a, _ in events], [None if b is None else a + b for a, b in events]))
    assert [r.weight for r in labels.sample_weights(df, "r").orderBy("t0").collect()] == pytest.approx([2 * g for g in got])


def bsadf_design(y, model, lags, add_const):
    """The regression written out: regressors with the tested one first, and the target."""
    y, d, most = np.array(y), np.diff(y), max(lags)
    at = np.arange(most + 1, len(y))
    t, one = np.arange(len(at), dtype=float), np.ones(len(at))
    if model in ("linear", "quadratic"):
        cols = [y[at - 1], *(d[at - 1 - k] for k in lags), *([one] if add_const else []), t, *([t**2] if model == "quadratic" else [])]
        return np.column_stack(cols), d[at - 1]
    cols = {"sm_exp": [t, one], "sm_power": [np.log(np.maximum(t, 1)), one]}.get(model, [t**2, one, t])
    return np.column_stack(cols), y[at] if model == "sm_poly_1" else np.log(y[at])


def bsadf_brute(y, model, min_length, phi=0.0, lags=(1,), add_const=False):
    x, target = bsadf_design(y, model, lags, add_const)
    out = []
    for t in range(min_length, len(target)):
        best = []
        for s in range(0, t - min_length + 2):
            a, b = x[s : t + 1], target[s : t + 1]
            coef, *_ = np.linalg.lstsq(a, b, rcond=None)
            r = b - a @ coef
            sd = np.sqrt(r @ r / (len(b) - a.shape[1]) * np.linalg.inv(a.T @ a)[0, 0])
            v = coef[0] / sd
            best.append((abs(v) if model.startswith("sm") else v) / len(b) ** phi)
        out.append(max(best))
    return out


@pytest.mark.parametrize("model", bsadf.MODELS)
def test_bsadf(spark, model):
    y = np.log(walk(45)).tolist() if model in ("linear", "quadratic", "sm_poly_1") else walk(45)
    for block, phi in ((512, 0.0), (7, 0.5), (16, 0.0)):  # one tile, and many that cross
        got = values(bsadf.bsadf(frame(spark, y), "close", model, 1, 12, phi=phi, block=block), "bsadf")
        assert got == pytest.approx(bsadf_brute(y, model, 12, phi), rel=1e-4)
    with pytest.raises(ValueError):
        bsadf.bsadf(frame(spark, y), min_length=0)


def test_bsadf_settings_and_gaps(spark):
    y = np.log(walk(60)).tolist()
    both = frame(spark, y).union(frame(spark, walk(8), "B"))  # B is too short to have a value
    got = bsadf.bsadf(both, "close", "linear", [1, 3], 15, add_const=True, block=10).orderBy("datetime").collect()
    assert [r.ticker for r in got] == ["A"] * len(got)
    assert [r.bsadf for r in got] == pytest.approx(bsadf_brute(y, "linear", 15, lags=[1, 3], add_const=True), rel=1e-4)
    gaps = [None, *y[:30], None, float("nan"), *y[30:]]
    assert values(bsadf.bsadf(frame(spark, gaps), "close", "linear", 1, 12, block=9), "bsadf") == pytest.approx(bsadf_brute(y, "linear", 12), rel=1e-4)
    flat = values(bsadf.bsadf(frame(spark, [1.0] * 40), "close", "linear", 1, 12, block=9), "bsadf")
    assert set(flat) == {None} and bsadf.bsadf(frame(spark, []), "close").count() == 0
    with pytest.raises(ValueError):
        bsadf.bsadf(frame(spark, y), model="cubic")


def test_singular_windows_spoil_only_their_end():
    x = np.column_stack([np.ones(30), np.arange(30.0), np.r_[np.ones(15), np.random.default_rng(0).normal(size=15)]])
    y = np.random.default_rng(1).normal(size=30)
    got = bsadf.statistics(x, y, 14, 0.0, False, range(13, 30))
    assert np.isnan(got[0]) and not np.isnan(got[-1])


def test_recursive_indicators(spark):
    x = walk(60)
    got = values(recursive.ema(frame(spark, x), "close", 10), "ema")
    want = [None] * 9 + [np.mean(x[:10])]
    for v in x[10:]:
        want.append(want[-1] + (v - want[-1]) * 2 / 11)
    assert got[:9] == want[:9] and got[9:] == pytest.approx(want[9:])
    assert values(recursive.rsi(frame(spark, [1.0] * 20), "close", 5), "rsi") == [None] * 5 + [0.0] * 15
    assert values(recursive.rsi(frame(spark, [float(i) for i in range(20)]), "close", 5), "rsi")[5:] == [100.0] * 15


def test_pipe_indicator(spark):
    df = frame(spark, walk(30))
    both = lambda a, b, k=1: (a * k, None, b)
    out = recursive.pipe_indicator(df, both, ["close", "open"], ["x", "y", None, "z"], k=2)
    assert set(out.columns) - set(df.columns) == {"x", "y", "z"}  # the schema is known before the callable runs
    assert values(out, "x") == pytest.approx([2 * c for c in values(df, "close")]) and set(values(out, "y") + values(out, "z")) == {None}
    single = recursive.pipe_indicator(df, lambda close: close + 1, {"close": "close"}, "x")
    assert values(single, "x") == pytest.approx([c + 1 for c in values(df, "close")])
    with pytest.raises(ValueError):
        recursive.pipe_indicator(df, both, "close", ["x"])


def test_panel(spark):
    rows = [("A", DAY, 1.0, 5), ("A", DAY + timedelta(2), None, 6), ("B", DAY + timedelta(1), 2.0, 7)]
    df = spark.createDataFrame(rows, "ticker string, datetime timestamp, close double, label int")
    got = {(r.ticker, (r.datetime - DAY).days): (r.close, r.label) for r in panel.align(df).collect()}
    assert got == {("A", 0): (1.0, 5), ("A", 1): (1.0, 5), ("A", 2): (1.0, 6), ("B", 1): (2.0, 7), ("B", 2): (2.0, 7)}
    assert {(r.ticker, (r.datetime - DAY).days) for r in panel.align(df, columns=["close"]).collect()} == {("A", 0), ("A", 2), ("B", 1)}
    both = panel.union_assets({"A": df.filter("ticker = 'A'").drop("ticker"), "B": df.filter("ticker = 'B'").drop("ticker")})
    assert both.count() == 2
    roles = panel.cutoff_split(both.withColumn("t1", F.lit(DAY + timedelta(5))), DAY + timedelta(1), t1="t1")
    assert sorted(r.role for r in roles.collect()) == ["purged", "test"]


def test_purged_folds(spark):
    rows = [(t, DAY + timedelta(i), DAY + timedelta(i + 3) if i % 4 else None) for i in range(23) for t in "AB"]
    df = spark.createDataFrame(rows, "ticker string, datetime timestamp, t1 timestamp")
    got = splits.purged_kfold(df, 5, "t1", 0.1).collect()
    for k in range(5):
        lo, hi = 4 * k, 4 * k + 3 if k < 4 else 22
        for r in (r for r in got if r.fold == k):
            i = (r.datetime - DAY).days
            end = None if r.t1 is None else (r.t1 - DAY).days
            want = "test" if lo <= i <= hi else "embargo" if hi < i <= min(hi + 2, 22) else "purged" if end is not None and i <= hi and end >= lo else "train"
            assert r.role == want
    assert all(sum(1 for r in got if r.role == "test" and r.datetime == DAY + timedelta(i)) == 2 for i in range(23))
    with pytest.raises(ValueError):
        splits.purged_kfold(df, 50)


def test_combinatorial(spark):
    df = frame(spark, walk(23)).select("ticker", "datetime")
    got = splits.combinatorial(df, 5, 2, 3, 3).collect()
    assert len(got) == 230 and {r.role for r in got} == {"train", "test"}
    tests = {s: sorted(r.position for r in got if r.split == s and r.role == "test") for s in range(10)}
    assert tests[0] == list(range(8)) and tests[9] == list(range(12, 23))
    real = splits.combinatorial(df, 5, 2, 1, 2, canonical=True).filter("split = 9").collect()
    assert sorted(r.position for r in real if r.role == "purged") == [11]


def test_walk_forward(spark):
    ranks = spark.range(50).select(F.col("id").alias("rank"))
    got = splits.walk_forward(ranks, 20, 10).collect()
    assert {r.split for r in got} == {0, 1, 2}
    assert sorted(r["rank"] for r in got if r.split == 1 and r.role == "train") == list(range(10, 30))
    assert sorted(r["rank"] for r in got if r.split == 2 and r.role == "test") == list(range(40, 50))
    assert splits.walk_forward(ranks.limit(5), 20, 10).count() == 0


def test_broker(spark):
    closes = [10.0, 11.0, 12.0, 13.0, 12.0, 11.0]
    df = frame(spark, closes, signal=[1.0, 0.0, 0.0, -1.0, 0.0, 0.0])
    row = backtest.backtest(df, backtest.Broker(cash=100.0, commission=(3.0, 0.0))).first()
    assert row.error is None and [tuple(t)[2:] for t in row.trades] == [(8, 11.0, 12.0, 8 * 1.0 - 6)]
    assert [e.equity for e in row.equity] == [100.0, 97.0, 105.0, 113.0, 102.0, 102.0]
    assert row.metrics["# Trades"] == 1 and row.metrics["Win Rate [%]"] == 100 and row.metrics["Return [%]"] == pytest.approx(2.0)
    assert row.metrics["Exposure Time [%]"] == pytest.approx(50.0)
    held = backtest.backtest(df, backtest.Broker(cash=100.0, commission=(3.0, 0.0), exit_mode="order", finalize=False)).first()
    assert held.trades == [] and held.equity[-1].equity == pytest.approx(97 - 88 + 8 * 11.0)
    at_close = backtest.backtest(df, backtest.Broker(cash=100.0, commission=0.01, trade_on_close=True)).first()
    assert at_close.trades[0].units == 9 and at_close.trades[0].exit_price == 13.0
    none = backtest.backtest(df, backtest.Broker(cash=5.0)).first()
    assert none.trades == [] and none.metrics["Equity Final [$]"] == 5.0


def test_one_failing_ticker_leaves_the_others(spark, tmp_path):
    bad = frame(spark, [1.0, 2.0], "BAD").withColumn("close", F.lit(None).cast("double"))
    both = frame(spark, walk(60)).union(bad)
    run = backtest.BatchBacktester(f"file://{tmp_path}/r")
    assert run.save() is None
    averages = {r.metric: r for r in run.run(both, backtest.sma_cross(3, 6)).collect()}
    assert averages["# Trades"].n >= 1
    assert run.save(DAY.date()) == "2023-01-02_SmaCross"
    rows = spark.read.parquet(f"file://{tmp_path}/r")
    flat = backtest.flatten_results(rows, ["# Trades", "SQN"]).collect()
    assert {r.ticker for r in flat} == {"A", "BAD"} and all("NaN" not in r.metrics for r in rows.collect())
    with pytest.raises(ValueError):
        backtest.backtest(both.drop("volume"))


def test_factory(spark):
    def mean10(column):
        return windows.sma(column, 10)

    spec = backtest.StrategyFactory([mean10], rules=[(F.col("close") > F.col("mean10"), F.col("close") < F.col("mean10"))]).create("Rule")
    got = spec.signals(frame(spark, walk(40))).collect()
    assert {r.signal for r in got} <= {-1, 0, 1} and all(r.signal == 0 for r in got if r.mean10 is None) and spec.name == "Rule"


def test_mean_variance():
    mean, cov = np.array([0.01, 0.02, 0.03]), np.diag([0.01, 0.02, 0.04])
    w = portfolio.mean_variance(mean, cov)
    assert w == pytest.approx(np.array([4, 2, 1]) / 7, abs=1e-9)
    assert portfolio.mean_variance(mean, cov, min_return=0.025) @ mean == pytest.approx(0.025, abs=1e-12)
    assert portfolio.mean_variance(mean, cov, min_return=1.0).tolist() == [0, 0, 1]
    assert portfolio.mean_variance(mean, cov, risk_aversion=1e-6).argmax() == 2 and portfolio.mean_variance(mean, cov, risk_aversion=0).argmax() == 2
    assert portfolio.mean_variance(np.array([0.1]), np.array([[0.0]]), risk_aversion=1.0).tolist() == [1.0]


def shifts_gain(mean, cov, w, pull, tolerance):
    """Whether moving weight from one asset to another lowers  w' cov w - pull x mean' w."""
    g = 2 * cov @ w - pull * mean
    return g[w > 1e-9].max() - g.min() > tolerance * (2 * np.abs(cov).max() + pull * np.abs(mean).max())


@settings(max_examples=120, deadline=None)
@given(st.integers(1, 12), st.integers(0, 1 << 30), st.sampled_from(["plain", "few times", "equal means", "copies", "wild"]))
def test_critical_line_meets_the_conditions_of_an_optimum(n, seed, kind):
    rng = np.random.default_rng(seed)
    x = rng.normal(rng.normal(0, 0.3, n), rng.uniform(0.5, 2, n), size=(4 if kind == "few times" else 60, n)) @ (np.eye(n) + rng.normal(0, 0.3, (n, n)))
    if kind == "copies":
        x[:, : n // 2] = x[:, n - n // 2 :]
    mean, cov = x.mean(0), np.atleast_2d(np.cov(x, rowvar=False))
    if kind == "equal means":
        mean = np.full(n, 0.1)
    if kind == "wild":
        mean, cov = mean * 1e6, cov * 1e-6
    corners = portfolio.critical_line(mean, cov)
    assert all(w.min() >= 0 and abs(w.sum() - 1) < 1e-9 for _, w in corners) and corners[-1][0] == 0
    for risk in (0.3, 1.0, 20.0):
        w = portfolio.on_line(corners, mean, risk_aversion=risk)
        assert not shifts_gain(mean, cov, w, 1 / risk, 1e-5)
    assert not shifts_gain(mean, cov, portfolio.on_line(corners, mean), 0.0, 1e-5)
    low, high = portfolio.on_line(corners, mean) @ mean, mean.max()
    for share in (0.25, 0.9):
        least = low + share * (high - low)
        w = portfolio.on_line(corners, mean, min_return=least)
        assert w @ mean >= least - 1e-9 * max(1.0, abs(least)) and w.min() >= -1e-12
        # any mixture with another corner that reaches the return has no less variance
        for _, v in corners:
            if v @ mean >= least:
                assert (w @ cov @ w) <= (v @ cov @ v) * (1 + 1e-7) + 1e-12


def test_moments_and_weights_from_pairs(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(0.01, 0.1, size=(60, 4)) @ (np.eye(4) + 0.2)
    rows = [(i // 60, DAY + timedelta(i % 60), f"T{k}", float(x[i % 60, k] * (1 + i // 60)), "train" if i % 60 < 40 else "test") for i in range(120) for k in range(4) if (i, k) != (5, 2)]
    split = spark.createDataFrame(rows, "split int, datetime timestamp, ticker string, ret double, role string")
    grid = [{}, {"risk_aversion": 2.0}, {"min_return": 0.02}]
    got = {(r.split, r.param, r.ticker): r.weight for r in portfolio.learned(split, grid).collect()}
    for s in (0, 1):
        past = np.delete(x[:40], 5, axis=0) if s == 0 else 2 * x[:40]  # a time without all assets is left out
        for p, g in enumerate(grid):
            want = portfolio.mean_variance(past.mean(0), np.cov(past, rowvar=False), **g)
            assert [got[s, p, f"T{k}"] for k in range(4)] == pytest.approx(want.tolist(), abs=1e-7)
    out = portfolio.fit_predict(split, [{"estimator": "mean_variance", **grid[1]}, {"estimator": "equal"}]).filter("split = 1").orderBy("param", "datetime").collect()
    assert len(out) == 40 and out[0].ret == pytest.approx(sum(2 * x[40, k] * got[1, 1, f"T{k}"] for k in range(4))) and out[20].ret == pytest.approx(2 * x[40].mean())
    checked = portfolio.optimal(split, grid).collect()
    assert len(checked) == 6 and all(r.feasible and r.optimal for r in checked)


def test_lab(spark):
    rng = np.random.default_rng(42)
    rows = [(DAY + timedelta(i), f"Asset{k}", float(v)) for i in range(200) for k, v in enumerate(rng.normal(0.005, 0.01, 3))]
    lab = portfolio.StrategyLab(spark.createDataFrame(rows, "datetime timestamp, ticker string, ret double"), {"EqualWeighted": {"estimator": "equal", "grid": [{}]}, "MeanRisk": {"estimator": "mean_variance", "grid": [{"risk_aversion": 1.0}, {"risk_aversion": 2.0}]}}, 50, 10)
    assert lab.search().count() == 3 and set(lab.best) == {"EqualWeighted", "MeanRisk"}
    journey = lab.journey()
    assert {r.strategy: r["count"] for r in journey.groupBy("strategy").count().collect()} == {"EqualWeighted": 150, "MeanRisk": 150}
    assert lab.frontier("MeanRisk", 3).groupBy("role").count().count() == 2
    assert lab.combinatorial(4, 2, 2, 2).select("split").distinct().count() == 6
    drawn = lab.randomised(3, 2, 100, 0)
    assert drawn.select("subsample").distinct().count() == 3 and drawn.groupBy("subsample", "split", "param").count().agg(F.max("count")).first()[0] == 10


def test_entropy_and_gaps(spark):
    df = spark.createDataFrame([([0.5, 0.5],), ([2.0, 0.0],), ([1.0, 1.0, 1.0],)], "p array<double>")
    assert [r[0] for r in df.select(learning.entropy(F.col("p"))).collect()] == pytest.approx([np.log(2), 0.0, np.log(3)])
    gaps = frame(spark, [None, 1.0, None, 2.0, None])
    assert values(learning.fill_gaps(gaps, "close", ["datetime", "ticker"]), "close") == [1.0, 1.0, 1.0, 2.0, 2.0]


def test_auc(spark):
    rng = np.random.default_rng(5)
    y, s = rng.integers(0, 2, 60), rng.integers(0, 12, 60) / 4
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "y int, s double")
    want = np.mean([(a > b) + (a == b) / 2 for a in s[y == 1] for b in s[y == 0]])
    assert learning.auc(df, "y", "s").first().auc == pytest.approx(want)


def samples(spark):
    rng = np.random.default_rng(3)
    rows = [(t, DAY + timedelta(i), float(a), float(b), float(a + b * 0.3 > 0), float(b > 0), 1.0 + i % 2) for i in range(120) for t in "AB" for a, b in [rng.normal(size=2)]]
    return spark.createDataFrame(rows, "ticker string, datetime timestamp, a double, b double, y double, meta double, w double")


def test_two_stages(spark):
    rows = samples(spark)
    model = learning.PrimarySecondary(LogisticRegression(maxIter=5), LogisticRegression(maxIter=5), ["a"], ["b"], n_splits=3, label="y", meta_label="meta", weight="w")
    organiser = learning.AssetOrganiser(model, rows, DAY + timedelta(100))
    with pytest.raises(ValueError):
        organiser.test()
    got = organiser.prepare().test("A").collect()
    assert len(got) == 20 and np.mean([r.final_decision == r.meta for r in got]) > 0.8
    assert all(0 <= r.primary_proba <= 1 and r.primary_entropy >= 0 for r in got)


def test_search_and_engine(spark, tmp_path):
    folds = splits.purged_kfold(samples(spark), 3)
    from pyspark.ml.feature import VectorAssembler

    build = lambda s: Pipeline(stages=[VectorAssembler(inputCols=s["cols"], outputCol="features"), LogisticRegression(labelCol="y", maxIter=5)])
    score = lambda rows, label: learning.f1(rows, label, "prediction").first().f1
    engine = learning.ModelEngine(learning.Search(build, {"cols": [["b"], ["a"]]}, score), f"file://{tmp_path}")
    model, held = engine.run(folds, samples(spark), samples(spark), "y")
    assert engine.search.best() == {"cols": ["a"]} and held > 0.85
    assert spark.read.parquet(f"file://{tmp_path}/trials").count() >= 4
    assert learning.scores(model, samples(spark), "y").first().log_loss < 0.5


def test_proposals_follow_the_better_trials():
    space = {"a": list(range(6)), "b": list(range(6))}
    search = learning.Search(None, space, None, n_trials=36, startup=8)

    def play(upto):
        for trial in range(1 + max((r[1] for r in search.rows), default=-1), upto):
            c = search.propose(trial)
            search.rows.append(("study", trial, {}, list(c), 0, -abs(c[0] - 4.0) - abs(c[1] - 1.0), "complete"))

    play(30)
    tried = [tuple(r[3]) for r in search.rows]
    assert len(set(tried)) == 30 and search.best() == {"a": 4, "b": 1}
    first, later = tried[:8], tried[8:16]
    far = lambda cs: np.mean([abs(a - 4) + abs(b - 1) for a, b in cs])
    assert far(later) < far(first)
    again = learning.Search(None, space, None, n_trials=36, startup=8)
    again.rows = search.rows[:20]  # a study taken up again goes on as it would have
    assert [again.propose(20)] == [tried[20]]
    play(36)
    assert len(search.rows) == 36 and search.propose(36) is None


def test_search_prunes_and_stops(spark):
    folds = splits.purged_kfold(samples(spark), 3)
    scores = {0: 0.9, 1: 0.8, 2: 0.7, 3: 0.6, 4: 0.5, 5: 0.1, 6: 0.95, 7: 0.2}
    build = lambda s: learning.BelowMean(inputCol="a", factor=float(s["k"]))
    search = learning.Search(build, {"k": list(range(8))}, lambda rows, label: 0.5, n_trials=8, sampler="random")
    asked = []
    search.build = lambda s: asked.append(s["k"]) or build(s)
    search.metric = lambda rows, label: scores[asked[-1]]
    states = {r.params["k"]: r.state for r in search.run(folds, "y").collect()}
    order = list(dict.fromkeys(asked))
    for i, k in enumerate(order):
        done = sorted(scores[j] for j in order[:i] if states[str(j)] == "complete")
        assert states[str(k)] == ("pruned" if len(done) >= 5 and scores[k] < np.median(done) else "complete")
    assert learning.Search(build, {"k": [1]}, search.metric).run(folds, "y", timeout=-1).count() == 0


def test_saved_model(spark, tmp_path):
    rows = samples(spark)
    model = learning.PrimarySecondary(LogisticRegression(maxIter=5), LogisticRegression(maxIter=5), ["a"], ["b"], n_splits=3, label="y", meta_label="meta").fit(rows)
    model.save(f"file://{tmp_path}/m")
    back = learning.PrimarySecondaryModel.load(f"file://{tmp_path}/m")
    key = lambda df, c: [r[c] for r in df.orderBy("ticker", "datetime").collect()]
    assert key(back.predict(rows), "prediction") == key(model.transform(rows), "final_decision")
    assert np.allclose(key(back.predict_proba(rows), "probability"), [[1 - p, p] for p in key(model.transform(rows), "secondary_proba")])


def test_many_columns(spark):
    df = frame(spark, walk(90)).withColumn("other", F.col("close") * 2)
    out = learning.FractionalDiff(inputCols=["close", "other"], threshold=1e-2).transform(df)
    assert np.allclose(np.array(values(out, "other_frac_diff")[30:]), 2 * np.array(values(out, "close_frac_diff")[30:]))
    assert {"close_trend_t", "other_trend_t"} <= set(learning.TrendScanning(inputCols=["close", "other"], windows=[5]).transform(df).columns)


def test_batch_inputs(spark, tmp_path):
    bars = frame(spark, walk(60))
    batch = backtest.BatchBacktester(f"file://{tmp_path}/r")
    assert batch.run(None, backtest.sma_cross) is None and batch.save() is None

    class Organiser:
        def test(self):
            return bars

    with pytest.raises(ValueError):
        batch.run(bars, backtest.sma_cross, organiser=Organiser())
    a = {r.metric: r.value for r in batch.run(None, backtest.sma_cross, organiser=Organiser(), n1=3, n2=8).collect()}
    b = {r.metric: r.value for r in batch.run({"A": bars.drop("ticker")}, backtest.sma_cross(3, 8)).collect()}
    assert a == b and a["# Trades"] >= 1


def test_margin():
    bars = pd.DataFrame({"datetime": pd.date_range("2024-01-01", periods=5), "open": [10.0, 10, 10, 4, 4], "close": [10.0, 10, 9, 4, 40], "signal": [1, 0, 0, 1, 0]})
    equity, held, trades = backtest.Broker(cash=100.0, commission=0.0, margin=0.5).run(bars)
    assert trades == [(1, 3, 20, 10.0, 4.0, -120.0)]  # twice the cash, gone at the fourth close
    assert equity.tolist() == [100, 100, 80, -20, -20] and held.tolist() == [0, 20, 20, 20, 0]


def test_units_beyond_64_bits_and_whole_quotients(spark):
    closes = [1.0, 1.0, 1e12, 1.0, 1.0, 1e12, 1e12]
    runs = backtest.backtest(frame(spark, closes, signal=[1.0, -1.0, 0.0, 1.0, -1.0, 0.0, 0.0]), backtest.Broker(cash=1e10, commission=0.0))
    (a, b) = runs.first().trades
    assert (a.units, a.pnl) == (1e10, pytest.approx(1e22)) and (b.units, b.pnl) == (pytest.approx(1e22), pytest.approx(1e34))
    assert [r.units for r in market._trades(runs).orderBy("entry").collect()] == [10**10, None]  # the second is no long
    bars = pd.DataFrame({"datetime": pd.date_range("2024-01-01", periods=3), "open": [0.1] * 3, "close": [0.1] * 3, "signal": [1, 0, 0]})
    assert backtest.Broker(cash=1.0, commission=0.0).run(bars)[1].tolist() == [0, 10, 10]  # as floor(1.0 / 0.1), not 1.0 // 0.1


def test_equity_of_far_days_and_beyond_doubles(spark):
    closes, step = [1.0, 1.0, 1e300, 1.0, 1.0, 1e300, 1e300], timedelta(days=40_000)
    bars = frame(spark, closes, signal=[1.0, -1.0, 0.0, 1.0, -1.0, 0.0, 0.0], step=step)
    curve = backtest.backtest(bars, backtest.Broker(cash=1e10, commission=0.0)).select(F.explode("equity").alias("e")).select("e.*")
    got = curve.select("datetime", market._digits("equity").alias("equity")).collect()
    assert [r.equity for r in got[:2]] == ["1.00000e+10", "1.00000e+10"] and {r.equity for r in got[2:]} <= {"inf", "-nan"}
    assert [r.datetime for r in got] == [DAY + i * step for i in range(7)] and got[-1].datetime.year > 2262


def test_metrics_of_a_very_large_account(spark):
    closes = [1.0, 1.0, 1e12, 1.0, 1.0, 1e12, 1e12]
    run = backtest.backtest(frame(spark, closes, signal=[1.0, -1.0, 0.0, 1.0, -1.0, 0.0, 0.0]), backtest.Broker(cash=1e10, commission=0.0)).first()
    assert run.error is None and run.metrics["# Trades"] == 2 and run.metrics["Win Rate [%]"] == 100
    assert run.metrics["Equity Final [$]"] == pytest.approx(1e34) and run.metrics["Best Trade [%]"] == pytest.approx(1e14)


def test_metrics_order_nan_as_sql_beyond_doubles(spark):
    closes, signal = [1.0, 1.0, 0.5, 1.0, 1e300, 1.0, 1.0, 1e300, 1.0, 1.0], [1.0, -1.0, 1.0, -1.0, 0.0, 1.0, -1.0, 1.0, 0.0, 0.0]
    got = backtest.backtest(frame(spark, closes, signal=signal), backtest.Broker(cash=1e10, commission=0.0)).first()
    held = [e.units for e in got.equity]
    assert got.error is None and [t.pnl for t in got.trades][:1] == [-5e9] and any(x != x for x in held)
    over, least = F.col("x") > 0, F.min("x")  # Spark's SQL orders NaN as the largest value, too
    of = lambda xs, c: spark.createDataFrame([(float(x),) for x in xs], "x double").agg(c).first()[0]
    assert got.metrics["Exposure Time [%]"] == pytest.approx(100 * of(held, F.avg(over.cast("int"))))
    assert got.metrics["Win Rate [%]"] == pytest.approx(100 * of([t.pnl for t in got.trades], F.avg(over.cast("int"))))
    assert got.metrics["Worst Trade [%]"] == pytest.approx(100 * of([t.pnl / (t.units * t.entry_price) for t in got.trades], least))
    assert "Max. Drawdown [%]" not in got.metrics and got.metrics["Max. Drawdown Duration"] > 0
    missing = frame(spark, [1.0, 1.0, None, 1.0, 1.0], signal=[1.0, -1.0, 0.0, 0.0, 0.0])  # NaN of a missing price is no largest value
    metrics = backtest.backtest(missing, backtest.Broker(cash=1e10, commission=0.0)).first().metrics
    assert metrics["Win Rate [%]"] == 0 and "Max. Drawdown Duration" not in metrics


def test_failed_requests_lose_only_their_quarter(spark, tmp_path):
    rows = frame(spark, walk(400)).drop("ticker")

    def fetch(ticker, start, stop, interval):
        if start.month == 4:
            raise OSError("down")
        return rows.filter((F.col("datetime") >= F.lit(start)) & (F.col("datetime") < F.lit(stop)))

    first = rows.agg(F.min("datetime")).first()[0]
    market = store.MarketStore(spark, f"file://{tmp_path}/q")
    failed = market.add_ticker("A", fetch, quarters={first.year: [1, 2, 3, 4]})
    assert [f[:2] for f in failed] == [(first.year, 2)]
    assert market.add_ticker("A", fetch, quarters={first.year: [1]}) == []
    kept = market.prices()
    assert kept.count() == rows.filter((F.year("datetime") == first.year) & (F.quarter("datetime") != 2)).count() == kept.select("datetime").distinct().count()


def test_transformers_in_a_pipeline(spark):
    df = frame(spark, walk(90))
    stages = [learning.FractionalDiff(threshold=1e-2), learning.TrendScanning(windows=[5, 10]), learning.BackwardSadf(minLength=15), learning.TripleBarrier(stop=90.0, multiple=2.0, horizon=5)]
    out = Pipeline(stages=stages).fit(df).transform(df)
    assert {"frac_diff", "trend_t", "bsadf", "label", "t1"} <= set(out.columns) and out.count() == 90
    with pytest.raises(ValueError):
        learning.TripleBarrier(stopCol="none").transform(df)


def test_ranges_and_pieces(spark):
    df = frame(spark, walk(200)).union(frame(spark, walk(40, 7), "B"))
    step = Step(lambda b: b.withColumn("s", windows.sma("close", 10)), lookback=9)
    whole = {(r.ticker, r.datetime): r.s for r in step.run(df).collect()}
    part = query(df, [step], ["A"], DAY + timedelta(50), DAY + timedelta(60)).collect()
    assert len(part) == 10 and all(r.s == pytest.approx(whole[r.ticker, r.datetime]) for r in part)
    ahead = Step(lambda b: windows.trend_scan(b, "close", [5, 10]), lookahead=9)
    want = {r.datetime: r.trend_t for r in ahead.run(df.filter("ticker = 'A'")).collect()}
    got = query(df, [ahead], ["A"], DAY + timedelta(20), DAY + timedelta(40)).collect()
    assert len(got) == 20 and all(r.trend_t == pytest.approx(want[r.datetime]) for r in got)
    for s, column in ((step, "s"),):
        pieces = in_pieces(df, s, size=16).collect()
        assert len(pieces) == 240 and all((r[column] is None) == (whole[r.ticker, r.datetime] is None) for r in pieces)
        assert all(r[column] == pytest.approx(whole[r.ticker, r.datetime]) for r in pieces if r[column] is not None)
    with pytest.raises(ValueError):
        in_pieces(df, Step(lambda b: b, lookback=None), 10)


def test_streams(spark, tmp_path):
    df = frame(spark, [10.0, 11.0, 12.0], signal=[1.0, 0.0, -1.0])
    df.union(df).write.parquet(f"file://{tmp_path}/in")
    stream = ingest.unique_bars(ingest.read(spark, f"file://{tmp_path}/in"))
    for _ in range(2):
        ingest.run_once(stream, f"file://{tmp_path}/out", f"file://{tmp_path}/c")
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == 3
    frame(spark, [20.0], step=timedelta(days=1)).withColumn("datetime", F.lit(DAY + timedelta(9))).withColumn("signal", F.lit(0.0)).write.mode("append").parquet(f"file://{tmp_path}/in")
    ingest.run_once(stream, f"file://{tmp_path}/out", f"file://{tmp_path}/c")
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == 4
    df.write.parquet(f"file://{tmp_path}/s")
    ingest.run_once(ingest.position_state(ingest.read(spark, f"file://{tmp_path}/s"), 100.0), f"file://{tmp_path}/p", f"file://{tmp_path}/pc")
    got = spark.read.parquet(f"file://{tmp_path}/p").orderBy("datetime").collect()
    assert [(r.units, r.cash) for r in got] == [(10, 0.0), (10, 0.0), (0, 120.0)]
