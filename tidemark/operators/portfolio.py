"""Portfolios over a long table of returns (datetime, ticker, ret)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .splits import randomised, time_ranks, walk_forward

YEAR = 252


def complete(returns: DataFrame) -> DataFrame:
    """Only the times at which every asset has a return."""
    assets = returns.select("ticker").distinct().count()
    full = returns.groupBy("datetime").agg(F.count("ret").alias("_n")).filter(F.col("_n") == assets).select("datetime")
    return returns.join(full, "datetime", "left_semi")


def equal_weight(returns: DataFrame) -> DataFrame:
    """(datetime, ret): the mean over assets."""
    return returns.groupBy("datetime").agg(F.avg("ret").alias("ret"))


def critical_line(mean: np.ndarray, cov: np.ndarray) -> list[tuple[float, np.ndarray]]:
    """Corner portfolios (pull, weights) of  least  w' cov w - pull x mean' w  over long-only weights that add up to one.

    From the best mean alone (an endless pull) down to the least variance (pull 0). Between two corners the held assets stay
    the same and weights are linear in the pull; at a corner an asset's weight, or the gradient of one that is not held,
    reaches zero. A finite number of linear systems, no iteration to a limit. Means that are equal (to 1e-9) are told
    apart by the order of assets, and 1e-10 of a matrix's trace is added to its diagonal, so that it is not singular.
    """
    n = len(mean)
    size = max(float(np.abs(mean).max()), 1e-300)
    if n > 1 and np.diff(np.sort(mean)).min() < 1e-9 * size:
        mean = mean - size * 1e-9 * np.arange(n)
    cov = cov + np.eye(n) * max(float(np.trace(cov)) / n * 1e-10, 1e-300)
    held = np.zeros(n, bool)
    held[int(np.argmax(mean))] = True
    corners, pull, last = [(np.inf, held.astype(float))], np.inf, -1
    for _ in range(50 * n + 50):
        at = np.flatnonzero(held)
        solved = np.linalg.solve(2 * cov[np.ix_(at, at)], np.column_stack([mean[at], np.ones(len(at))]))
        up, one = solved[:, 0].sum(), solved[:, 1].sum()
        fixed, slope = np.zeros(n), np.zeros(n)
        fixed[at], slope[at] = solved[:, 1] / one, solved[:, 0] - up / one * solved[:, 1]
        # gradient of an asset less that of the held ones, as a line over the pull
        rest, rise = 2 * cov @ fixed - 1 / one, 2 * cov @ slope - mean + up / one
        with np.errstate(divide="ignore", invalid="ignore"):
            zero = np.where(held, np.where(slope > 0, -fixed / slope, -np.inf), np.where(rise > 0, -rest / rise, -np.inf))
        zero[zero > pull * (1 + 1e-9)] = -np.inf
        if last >= 0 and zero[last] >= pull * (1 - 1e-9):  # what changed last is at zero now, and leaves it
            zero[last] = -np.inf
        nxt = int(np.argmax(zero))
        pull = min(pull, float(zero[nxt]))
        low = max(pull, 0.0)
        w = np.maximum(fixed + low * slope, 0.0)
        corners.append((low, w / w.sum()))
        if pull <= 0:
            break
        held[nxt], last = not held[nxt], nxt
    return corners


def _between(corners: list[tuple[float, np.ndarray]], pull: float) -> np.ndarray:
    """Weights at a pull."""
    for (high, a), (low, b) in zip(corners, corners[1:]):
        if pull >= low:
            share = 0.0 if high == low else 1.0 if pull >= high else (pull - low) / (high - low) if np.isfinite(high) else 0.0
            return b + share * (a - b)  # above the first finite corner only the best mean is held
    return corners[-1][1]


def on_line(corners: list[tuple[float, np.ndarray]], mean: np.ndarray, risk_aversion: float | None = None, min_return: float | None = None) -> np.ndarray:
    """The portfolio of one setting: without any the least variance; with ``risk_aversion`` the most of mean - risk_aversion x
    variance; with ``min_return`` the least variance among weights that reach it (the best mean, if none does)."""
    if min_return is None:
        return corners[-1][1] if risk_aversion is None else corners[0][1] if risk_aversion <= 0 else _between(corners, 1 / risk_aversion)
    reached = [float(w @ mean) for _, w in corners]
    if reached[-1] >= min_return - 1e-12 * float(np.abs(mean).max()):
        return corners[-1][1]
    if mean.max() <= min_return:
        return corners[0][1]
    k = next(k for k in range(len(corners) - 1) if reached[k] >= min_return > reached[k + 1])
    share = (min_return - reached[k + 1]) / (reached[k] - reached[k + 1])
    return corners[k + 1][1] + share * (corners[k][1] - corners[k + 1][1])


def mean_variance(mean: np.ndarray, cov: np.ndarray, risk_aversion: float | None = None, min_return: float | None = None) -> np.ndarray:
    """Long-only weights that add up to one, of one setting (``on_line``)."""
    return on_line(critical_line(mean, cov), mean, risk_aversion, min_return)


def complete_by(split: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The rows at the times that have all assets of their split."""
    names = split.groupBy(*keys).agg(F.count_distinct("ticker").alias("_all"))
    full = split.groupBy(*keys, "datetime").agg(F.count("ret").alias("_n")).join(names, list(keys)).filter("_n = _all")
    return split.join(full.select(*keys, "datetime"), [*keys, "datetime"], "left_semi")


def moments(split: DataFrame, keys: tuple[str, ...] = ("split",)) -> DataFrame:
    """(keys, a, b, n, mean_a, cov): one row for each split and pair of assets a <= b, over its training times.

    Returns meet by time, so the work is times x pairs, added up before it is exchanged; splits with fewer than two times
    have no covariances.
    """
    train = complete_by(split, keys).filter("role = 'train'")
    at = [*keys, "datetime"]
    a = train.select(*at, F.col("ticker").alias("a"), F.col("ret").alias("x"))
    b = train.select(*at, F.col("ticker").alias("b"), F.col("ret").alias("y"))
    pairs = a.join(b, at).filter("a <= b")
    return pairs.groupBy(*keys, "a", "b").agg(F.count("*").alias("n"), F.avg("x").alias("mean_a"), F.covar_samp("x", "y").alias("cov")).filter("n > 1")


def learned(split: DataFrame, grid: list[dict], keys: tuple[str, ...] = ("split",)) -> DataFrame:
    """(keys, param, ticker, weight): the mean-variance weights of each entry of the grid, all from one critical line a split.

    A group is the pairs of one split's assets, whatever the number of its times and of settings.
    """
    grid = [{k: v for k, v in g.items() if k != "estimator"} for g in grid]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["a", "b"])
        same = frame[frame["a"] == frame["b"]]
        names, mean = same["a"].to_numpy(), same["mean_a"].to_numpy(float)
        place = {t: i for i, t in enumerate(names)}
        cov, i, j = np.zeros((len(names), len(names))), frame["a"].map(place).to_numpy(), frame["b"].map(place).to_numpy()
        cov[i, j] = cov[j, i] = frame["cov"].to_numpy(float)
        corners = critical_line(mean, cov)
        w = np.concatenate([on_line(corners, mean, **g) for g in grid])
        return pd.DataFrame({**{k: frame[k].iloc[0] for k in keys}, "param": np.repeat(np.arange(len(grid), dtype=np.int32), len(names)), "ticker": np.tile(names, len(grid)), "weight": w})

    kinds = ", ".join(f"{k} {split.schema[k].dataType.simpleString()}" for k in keys)
    return moments(split, keys).groupBy(*keys).applyInPandas(run, f"{kinds}, param int, ticker {split.schema['ticker'].dataType.simpleString()}, weight double")


def split_returns(returns: DataFrame, train: int = 126, test: int = 63) -> DataFrame:
    """returns once for each split that trains or tests on their time, with ``split`` and ``role``."""
    return returns.join(walk_forward(time_ranks(returns), train, test), "datetime")


def _equal(split: DataFrame, keys: tuple[str, ...], both: bool) -> DataFrame:
    """(keys, role, datetime, ret): the mean over assets at the times that have all assets of their split."""
    names = split.groupBy(*keys).agg(F.count_distinct("ticker").alias("_all"))
    means = split.groupBy(*keys, "role", "datetime").agg(F.avg("ret").alias("ret"), F.count("ret").alias("_n"))
    full = means.join(names, list(keys)).filter("_n = _all")
    return (full if both else full.filter("role = 'test'")).select(*keys, "role", "datetime", "ret")


def gradients(split: DataFrame, grid: list[dict], keys: tuple[str, ...] = ("split",)) -> DataFrame:
    """(keys, param, ticker, weight, gradient): for each asset how fast  risk x variance - mean  grows with its weight.

    At an optimum held assets have the same gradient and no other a smaller one (``min_return``: but for a multiple of
    the means). Variances come from the moments, weights from ``learned``.
    """
    pairs = moments(split, keys)
    both = pairs.select(*keys, "a", "b", "cov").union(pairs.filter("a <> b").select(*keys, F.col("b").alias("a"), F.col("a").alias("b"), "cov"))
    means = pairs.filter("a = b").select(*keys, F.col("a").alias("ticker"), F.col("mean_a").alias("mean"))
    w = learned(split, grid, keys)
    pull = both.join(w.select(*keys, "param", F.col("ticker").alias("b"), "weight"), [*keys, "b"]).groupBy(*keys, "param", F.col("a").alias("ticker")).agg(F.sum(F.col("cov") * F.col("weight")).alias("pull"))
    risk = F.element_at(F.array(*(F.lit(float(g.get("risk_aversion") or 1.0)) for g in grid)), F.col("param") + 1)
    chase = F.element_at(F.array(*(F.lit(0.0 if g.get("risk_aversion") is None else 1.0) for g in grid)), F.col("param") + 1)
    return w.join(pull, [*keys, "param", "ticker"]).join(means, [*keys, "ticker"]).select(*keys, "param", "ticker", "weight", (2 * risk * F.col("pull") - chase * F.col("mean")).alias("gradient"), "mean")


def optimal(split: DataFrame, grid: list[dict], keys: tuple[str, ...] = ("split",), slack: float = 1e-4) -> DataFrame:
    """(keys, param, feasible, optimal): whether the weights are long-only and add up to one, and whether no shift of weight
    from one asset to another would gain (the conditions of Karush, Kuhn and Tucker), up to ``slack`` of the gradient.

    With ``min_return`` the shifts are judged by the gradient less the multiple of the means that makes the held assets
    equal, and the least return must be reached, exactly if that multiple is not zero.
    """
    each, w = Window.partitionBy(*keys, "param"), F.col("weight")
    held = w > 1e-6
    least = F.element_at(F.array(*(F.lit(None if g.get("min_return") is None else float(g["min_return"])).cast("double") for g in grid)), F.col("param") + 1)
    own = lambda c: F.when(held, F.col(c))
    out = gradients(split, grid, keys).withColumn("_least", least)
    multiple = F.try_divide(F.covar_pop(own("mean"), own("gradient")).over(each), F.var_pop(own("mean")).over(each))
    out = out.withColumn("_pull", F.when(F.col("_least").isNotNull(), F.greatest(F.lit(0.0), multiple)).otherwise(0.0))
    out = out.withColumn("_rest", F.col("gradient") - F.coalesce("_pull", F.lit(0.0)) * F.col("mean"))
    size = F.max(F.abs("gradient"))
    reach, least, pull = F.sum(w * F.col("mean")), F.first("_least"), F.coalesce(F.first("_pull"), F.lit(0.0))
    alone = (F.max("mean") <= least) & (F.max_by(w, "mean") > 1 - 1e-9)
    even = F.max(own("_rest")) - F.min("_rest") <= slack * size
    fits = least.isNull() | alone | (reach >= least - 1e-9)
    met = out.groupBy(*keys, "param").agg(
        ((F.min("weight") >= 0) & (F.abs(F.sum("weight") - 1) < 1e-9) & fits).alias("feasible"),
        F.coalesce(alone | (even & F.coalesce(pull * (reach - least) <= slack * size, F.lit(True))), even).alias("optimal"),
    )
    return met.select(*keys, "param", "feasible", "optimal")


def weights(returns: DataFrame, setting: dict) -> DataFrame:
    """(ticker, weight) of one setting learned on all returns."""
    if setting.get("estimator", "mean_variance") == "equal":
        names = returns.select("ticker").distinct()
        return names.join(names.agg((1.0 / F.count("*")).alias("weight")))
    whole = returns.select("datetime", "ticker", "ret", F.lit(0).alias("split"), F.lit("train").alias("role"))
    return learned(whole, [setting]).select("ticker", "weight")


def fit_predict(split: DataFrame, grid: list[dict], keys: tuple[str, ...] = ("split",), both: bool = False) -> DataFrame:
    """(keys, param, role, datetime, ret): for each split and each entry of the grid (``estimator`` equal or mean_variance,
    and its settings) the returns of weights learned on the split's training times.

    Equal weights are a mean; other weights come from the moments of pairs and are joined to the returns.
    """
    equal = [k for k, g in enumerate(grid) if g.get("estimator") == "equal"]
    rest = [k for k in range(len(grid)) if k not in equal]
    means = _equal(split, keys, both).withColumn("param", F.explode(F.array(*map(F.lit, equal)))) if equal else None
    if not rest:
        return means.select(*keys, "param", "role", "datetime", "ret")
    w = learned(split, [grid[k] for k in rest], keys).withColumn("param", F.element_at(F.array(*map(F.lit, rest)), F.col("param") + 1))
    shown = complete_by(split, keys).select(*keys, "role", "datetime", "ticker", "ret")
    met = (shown if both else shown.filter("role = 'test'")).join(w, [*keys, "ticker"])
    out = met.groupBy(*keys, "param", "role", "datetime").agg(F.sum(F.col("ret") * F.col("weight")).alias("ret"))
    return out if means is None else out.unionByName(means)


def measures(returns: DataFrame, keys: list[str], beta: float = 0.95) -> DataFrame:
    """Annual mean, deviation, Sharpe and Sortino ratios, largest drawdown of the summed returns, and the ratio of the mean
    to the mean of the worst (1 - beta) of returns."""
    part = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    run = part.orderBy("datetime").rowsBetween(Window.unboundedPreceding, 0)
    out = returns.select("*", F.sum("ret").over(run).alias("_cum"), F.avg("ret").over(part).alias("_mean"), F.row_number().over(part.orderBy("ret", "datetime")).alias("_rank"), F.count("*").over(part).alias("_n"))
    out = out.withColumn("_fall", F.greatest(F.max("_cum").over(run), F.lit(0.0)) - F.col("_cum"))
    tail = F.avg(F.when(F.col("_rank") <= F.ceil(F.col("_n") * (1 - beta)), F.col("ret")))
    low = F.sqrt(F.try_divide(F.sum(F.pow(F.least(F.col("ret") - F.col("_mean"), F.lit(0.0)), 2)), F.count("*") - 1))
    mean, std = F.avg("ret"), F.stddev_samp("ret")
    return out.groupBy(*keys).agg(
        (mean * YEAR).alias("annual_mean"), (std * YEAR**0.5).alias("annual_std"), (F.try_divide(mean, std) * YEAR**0.5).alias("annual_sharpe"),
        F.max("_fall").alias("max_drawdown"), (F.try_divide(mean, low) * YEAR**0.5).alias("annual_sortino"), F.try_divide(mean, -tail).alias("cvar_ratio"),
    )


def levels(points: int = 8, low: float = 0.025, high: float = 0.20) -> list[float]:
    """Evenly spaced least returns of a frontier, a year's as a day's."""
    return [float(r) for r in np.linspace(low, high, points) / YEAR]


def curves(returns: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, datetime, cumulative, drawdown): what a plot of summed returns and their falls shows."""
    run = Window.partitionBy(*keys).orderBy("datetime").rowsBetween(Window.unboundedPreceding, 0)
    out = returns.withColumn("cumulative", F.sum("ret").over(run))
    fall = F.greatest(F.max("cumulative").over(run), F.lit(0.0)) - F.col("cumulative")
    return out.select(*keys, "datetime", "cumulative", fall.alias("drawdown"))


class StrategyLab:
    """Searches, replays and stress-tests portfolio strategies: name -> {"estimator": ..., "grid": [settings]}."""

    def __init__(self, returns: DataFrame, strategies: dict[str, dict], train: int = 126, test: int = 63):
        self.returns, self.strategies, self.train, self.test = complete(returns), strategies, train, test
        self.best: dict[str, dict] = {}

    def search(self, score: str | Callable[[DataFrame, list[str]], DataFrame] = "annual_sharpe", split: DataFrame | None = None) -> DataFrame:
        """(strategy, param, score): mean score of each setting over the test windows; keeps the best of each strategy.

        ``score`` is one of the measures, or a function of returns and keys that gives (keys, score); ``split`` any table
        of returns with ``split`` and ``role``, by default walk-forward. ``refitted`` has the winners' weights.
        """
        split, rows = split_returns(self.returns, self.train, self.test) if split is None else split, None
        rate = score if callable(score) else lambda r, keys: measures(r, keys).withColumnRenamed(score, "score")
        for name, config in self.strategies.items():
            grid = [{"estimator": config["estimator"], **g} for g in (config.get("grid") or [{}])]
            got = rate(fit_predict(split, grid), ["split", "param"]).groupBy("param").agg(F.avg("score").alias("score"))
            best = got.orderBy(F.desc_nulls_last("score"), "param").first()
            self.best[name] = grid[best["param"] if best else 0]
            named = got.select(F.lit(name).alias("strategy"), "param", "score")
            rows = named if rows is None else rows.union(named)
        return rows

    def refitted(self) -> DataFrame:
        """(strategy, ticker, weight): each strategy's best setting learned on all returns."""
        parts = [weights(self.returns, setting).select(F.lit(name).alias("strategy"), "ticker", "weight") for name, setting in self.best.items()]
        return reduce(lambda a, b: a.union(b), parts)

    def population(self, *portfolios: DataFrame) -> DataFrame:
        """The journeys of all strategies, extended by further portfolios (strategy, split, datetime, ret)."""
        return reduce(lambda a, b: a.unionByName(b), portfolios, self.journey())

    def journey(self) -> DataFrame:
        """(strategy, split, datetime, ret): out-of-sample returns of each strategy's best setting."""
        names = list(self.best)
        got = fit_predict(split_returns(self.returns, self.train, self.test), [self.best[n] for n in names])
        return got.select(F.element_at(F.array(*map(F.lit, names)), F.col("param") + 1).alias("strategy"), "split", "datetime", "ret")

    def frontier(self, name: str, points: int = 8, low: float = 0.025, high: float = 0.20) -> DataFrame:
        """Measures of train and test returns for each split and each least return of the frontier; the stored setting stays."""
        grid = [{**self.best[name], "min_return": r} for r in levels(points, low, high)]
        got = fit_predict(split_returns(self.returns, self.train, self.test), grid, both=True)
        return measures(got, ["split", "param", "role"])

    def combinatorial(self, n_folds: int, n_test: int, purge: int = 10, embargo: int = 10) -> DataFrame:
        """(split, param, datetime, ret) over all choices of test blocks of times, with purge and embargo applied."""
        from .splits import combinatorial

        times = combinatorial(self.returns.select("datetime").distinct().withColumn("ticker", F.lit("")), n_folds, n_test, purge, embargo, canonical=True)
        split = self.returns.join(times.filter("role <> 'purged'").select("datetime", "split", "role"), "datetime")
        return fit_predict(split, list(self.best.values()))

    def randomised(self, n_subsamples: int = 100, subset: int = 10, window: int | None = None, seed: int = 0) -> DataFrame:
        """(subsample, split, param, datetime, ret): walk-forward on seeded sets of assets and windows of times."""
        spark = self.returns.sparkSession
        ranks = time_ranks(self.returns)
        tickers = [r[0] for r in self.returns.select("ticker").distinct().collect()]
        drawn = randomised(spark, tickers, ranks.count(), n_subsamples, subset, window, seed)
        rows = self.returns.join(ranks, "datetime").join(drawn, "ticker").filter(F.col("rank").between(F.col("first_rank"), F.col("last_rank")))
        local = rows.withColumn("local", F.col("rank") - F.col("first_rank"))
        n = F.col("last_rank") - F.col("first_rank") + 1
        last = F.floor((n - self.train) / self.test) - 1
        first = F.greatest(F.lit(0), F.floor((F.col("local") - (self.train + self.test)) / self.test) + 1)
        upto = F.least(last, F.floor(F.col("local") / self.test))
        dealt = local.filter(first <= upto).withColumn("split", F.explode(F.sequence(first.cast("int"), upto.cast("int"))))
        offset = F.col("local") - F.col("split") * self.test
        dealt = dealt.withColumn("role", F.when(offset < self.train, "train").when(offset < self.train + self.test, "test")).filter("role is not null")
        return fit_predict(dealt, list(self.best.values()), keys=("subsample", "split"))
