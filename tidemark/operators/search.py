"""Define-by-run search over ranges: a factory asks a trial for its settings, Parzen densities choose them.

``build(trial)`` gives an estimator and asks for what it needs as it goes: ``trial.suggest_float``, ``suggest_int`` (both with
``step`` and ``log``) and ``suggest_categorical``; what it asks for may depend on earlier answers. Given a ``FixedTrial`` the
same factory gives the estimator of stored settings again.

A parameter's first answers are drawn evenly. Then the trials that had it are split into the best quarter and the rest, each
gives a density (logistic kernels cut at the range's ends and one even part; counts for categories), and of CANDIDATES drawn
from the first density the one with the largest ratio to the second is taken. Draws are md5 of seed, trial, name and number,
so that a study can be replayed anywhere, in SQL too.

Trials run ``jobs`` at a time on one session, each as Spark jobs of its own. Trial t begins when trials up to t - jobs have
ended, and knows exactly those, whatever finished meanwhile: a study gives the same rows however its trials overlap,
and goes on after an interruption as it would have. Every trial is a folder of its own in the study's table.
"""

from __future__ import annotations

import hashlib
import math
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
from pyspark.ml import Estimator
from pyspark.sql import DataFrame

CANDIDATES = 24
ROWS = "study string, trial int, params map<string,string>, inner map<string,double>, origin map<string,string>, fold int, score double, state string"


def draw(*parts) -> float:
    """A number in [0, 1) from the first 32 bits of the md5 of the parts, joined by colons."""
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:8], 16) / 4294967296.0


@dataclass(frozen=True)
class Range:
    """Numbers from ``low`` to ``high``; inside, their logarithm for ``log``, and half a step more at both ends of a grid."""

    low: float
    high: float
    step: float | None = None
    log: bool = False
    whole: bool = False

    def __post_init__(self):
        if self.low > self.high or self.log and self.low <= 0 or self.step is not None and self.step <= 0:
            raise ValueError("a range needs low <= high, above 0 for log, and a step above 0")
        if self.log and self.step not in (None, 1):
            raise ValueError("log and step exclude each other")

    def ends(self) -> tuple[float, float]:
        margin = self.step / 2 if self.step else 0.0
        low, high = self.low - margin, self.high + margin
        return (math.log(low), math.log(high)) if self.log else (low, high)

    def value(self, x: float):
        x = math.exp(x) if self.log else x
        if self.step:
            most = math.floor((self.high - self.low) / self.step + 1e-9)
            x = self.low + self.step * min(most, max(0, math.floor((x - self.low) / self.step + 0.5)))
        x = min(self.high, max(self.low, x))
        return int(round(x)) if self.whole else float(x)

    def inner(self, value) -> float:
        return math.log(value) if self.log else float(value)


def scale(low: float, high: float, n: int) -> float:
    """Width of the kernels of n values."""
    return (high - low) / 8 / math.sqrt(n + 1)


def _logistic(x: float) -> float:
    return 1 / (1 + math.exp(-x)) if x > -700 else 0.0


def density(x: float, centres: list[float], low: float, high: float) -> float:
    """The mixture of one kernel a centre, each with its mass inside the range, and an even part, all weighing the same."""
    s, total = scale(low, high, len(centres)), 1 / (high - low)
    for c in centres:
        p = _logistic((x - c) / s)
        total += p * (1 - p) / s / (_logistic((high - c) / s) - _logistic((low - c) / s))
    return total / (len(centres) + 1)


def sample(centres: list[float], low: float, high: float, u: float, v: float) -> float:
    """A value of ``density``: u picks the part, v the place in it."""
    k = int(u * (len(centres) + 1))
    if k == len(centres):
        return low + v * (high - low)
    s, c = scale(low, high, len(centres)), centres[k]
    a, b = _logistic((low - c) / s), _logistic((high - c) / s)
    p = min(1 - 1e-15, max(1e-15, a + v * (b - a)))
    return min(high, max(low, c + s * math.log(p / (1 - p))))


class Trial:
    """One set of answers; ``seen`` has the inner values of earlier trials, the best first."""

    def __init__(self, number: int, seed: int, startup: int, seen: list[dict[str, float]]):
        self.number, self.seed, self.startup, self.seen = number, seed, startup, seen
        self.params, self.inner, self.origin = {}, {}, {}

    def suggest_float(self, name: str, low: float, high: float, *, step: float | None = None, log: bool = False) -> float:
        return self._number(name, Range(float(low), float(high), step, log))

    def suggest_int(self, name: str, low: int, high: int, *, step: int = 1, log: bool = False) -> int:
        return self._number(name, Range(int(low), int(high), step, log, whole=True))

    def suggest_categorical(self, name: str, choices: list):
        choices = list(choices)
        if name in self.params:
            return self.params[name]
        known = self._known(name)
        if len(known) < self.startup:
            k, origin = int(draw(self.seed, self.number, name, "start") * len(choices)), "start"
        else:
            good, bad = self._split(known)
            share = lambda some: (np.bincount(np.array(some, int), minlength=len(choices)) + 1) / (len(some) + len(choices))
            p, q = share(good), share(bad)
            drawn = [min(len(choices) - 1, int(np.searchsorted(np.cumsum(p), draw(self.seed, self.number, name, i), side="right"))) for i in range(CANDIDATES)]
            k, origin = max(drawn, key=lambda i: p[i] / q[i]), "parzen"
        return self._answer(name, choices[k], float(k), origin)

    def _number(self, name: str, range_: Range):
        if name in self.params:
            return self.params[name]
        low, high = range_.ends()
        known = self._known(name)
        if low == high:
            x, origin = low, "start"
        elif len(known) < self.startup:
            x, origin = low + draw(self.seed, self.number, name, "start") * (high - low), "start"
        else:
            good, bad = self._split(known)
            drawn = [sample(good, low, high, draw(self.seed, self.number, name, i, "part"), draw(self.seed, self.number, name, i, "place")) for i in range(CANDIDATES)]
            x, origin = max(drawn, key=lambda c: math.log(density(c, good, low, high)) - math.log(density(c, bad, low, high))), "parzen"
        value = range_.value(x)
        return self._answer(name, value, range_.inner(value), origin)

    def _known(self, name: str) -> list[float]:
        return [s[name] for s in self.seen if name in s]

    @staticmethod
    def _split(known: list[float]) -> tuple[list[float], list[float]]:
        cut = -(-len(known) // 4)
        return known[:cut], known[cut:]

    def _answer(self, name: str, value, inner: float, origin: str):
        self.params[name], self.inner[name], self.origin[name] = value, inner, origin
        return value


class FixedTrial:
    """Answers with given settings."""

    def __init__(self, params: dict):
        self.params = params

    def _given(self, name: str):
        if name not in self.params:
            raise ValueError(f"no value for {name}")
        return self.params[name]

    def suggest_float(self, name: str, low: float, high: float, **_) -> float:
        return float(self._given(name))

    def suggest_int(self, name: str, low: int, high: int, **_) -> int:
        return int(self._given(name))

    def suggest_categorical(self, name: str, choices: list):
        value = self._given(name)
        found = [c for c in choices if c == value or str(c) == str(value)]
        if not found:
            raise ValueError(f"{value} is no choice of {name}")
        return found[0]


class Study:
    """Trials of ``build``, scored fold by fold by ``metric``.

    With ``prune`` a trial ends when its running mean is worse than the median at the same fold of the finished trials that
    it knows, once WARM of them have finished. With ``path`` trials are stored and a study of the same name goes on.
    """

    WARM = 5

    def __init__(self, build: Callable[[Trial], Estimator], metric: Callable[[DataFrame, str], float], n_trials: int = 50, seed: int = 42, maximise: bool = True, startup: int = 10, jobs: int = 1, prune: bool = True, study: str = "study", path: str | None = None):
        self.build, self.metric, self.n_trials, self.seed, self.sign = build, metric, n_trials, seed, 1 if maximise else -1
        self.startup, self.jobs, self.prune, self.study, self.path = max(1, startup), jobs, prune, study, path
        self.rows: list[tuple] = []
        self.values: dict[int, dict] = {}  # of this session's trials, with their types

    def _seen(self, before: int) -> list[tuple[int, dict, list[float], str]]:
        """(trial, inner values, scores, state) of the trials below ``before``, the best first, pruned ones last."""
        found: dict[int, tuple] = {}
        for _, trial, _, inner, _, _, score, state in self.rows:
            if trial < before:
                found.setdefault(trial, (trial, inner, [], state))[2].append(score)
        return sorted(found.values(), key=lambda t: (t[3] != "complete", -self.sign * float(np.mean(t[2])), t[0]))

    def ask(self, number: int) -> Trial:
        """The trial of this number, knowing those up to ``number - jobs``."""
        return Trial(number, self.seed, self.startup, [inner for _, inner, _, _ in self._seen(number - self.jobs + 1)])

    def tell(self, trial: Trial, folds: list[int], scores: list[float], state: str = "complete") -> list[tuple]:
        shown = {k: str(v) for k, v in trial.params.items()}
        new = [(self.study, trial.number, shown, dict(trial.inner), dict(trial.origin), int(f), float(s), state) for f, s in zip(folds, scores)]
        self.rows += new
        self.values[trial.number] = dict(trial.params)
        return new

    def _one(self, number: int, folds: DataFrame, ids: list[int], label: str) -> None:
        trial, scores, state = self.ask(number), [], "complete"
        estimator = self.build(trial)
        before = [s for _, _, s, st in self._seen(number - self.jobs + 1) if st == "complete"]
        for k in ids:
            fold = folds.filter(folds["fold"] == k)
            model = estimator.fit(fold.filter("role = 'train'"))
            scores.append(float(self.metric(model.transform(fold.filter("role = 'test'")), label)))
            usual = [self.sign * float(np.mean(s[: len(scores)])) for s in before]
            if self.prune and len(usual) >= self.WARM and len(scores) < len(ids) and self.sign * float(np.mean(scores)) < float(np.median(usual)):
                state = "pruned"
                break
        new = self.tell(trial, ids, scores, state)
        if self.path:
            folds.sparkSession.createDataFrame(new, ROWS).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/{self.study}/{number:06d}")

    def _load(self, spark) -> None:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{self.study}")
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            found = spark.read.schema(ROWS).parquet(f"{self.path}/{self.study}/*").orderBy("trial", "fold").collect()  # a row for each trial's fold
            self.rows = [tuple(r) for r in found]

    def run(self, folds: DataFrame, label: str, timeout: float | None = None) -> DataFrame:
        """Runs what is missing up to ``n_trials`` and gives all trials; ``timeout`` (seconds) begins no more."""
        spark, begun = folds.sparkSession, time.monotonic()
        if self.path:
            self._load(spark)
        done = {r[1] for r in self.rows}
        folds = folds.persist()
        try:
            ids = sorted(r[0] for r in folds.select("fold").distinct().collect())
            running: dict[int, object] = {}
            with ThreadPoolExecutor(self.jobs) as pool:
                for number in range(self.n_trials):
                    for ended in [n for n in running if n <= number - self.jobs]:
                        running.pop(ended).result()
                    if number in done:
                        continue
                    if timeout is not None and time.monotonic() - begun > timeout:
                        break
                    running[number] = pool.submit(self._one, number, folds, ids, label)
                for future in running.values():
                    future.result()
        finally:
            folds.unpersist()
        self.rows.sort(key=lambda r: (r[1], r[5]))
        self.trials = spark.createDataFrame(self.rows, ROWS)
        return self.trials

    def best(self) -> dict:
        """The settings of the finished trial with the best mean score, the first on ties; as text where a study was reloaded."""
        top = next((t for t in self._seen(1 << 31) if t[3] == "complete"), None)
        if top is None:
            raise ValueError("no trial has finished")
        return self.values.get(top[0]) or dict(next(r[2] for r in self.rows if r[1] == top[0]))

    def rebuilt(self) -> Estimator:
        """The estimator of the best settings, from the same factory."""
        return self.build(FixedTrial(self.best()))
