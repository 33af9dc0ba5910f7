"""Two-stage classifiers, search over settings, and transformers, all of pyspark.ml."""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import bsadf as _bsadf
from ..functions import labels as _labels
from ..functions import windows as _windows
from .splits import purged_kfold


def entropy(p: Column) -> Column:
    """Shannon entropy of an array of weights, taken as shares of their sum."""
    total = F.aggregate(p, F.lit(0.0), lambda a, x: a + x)
    return F.aggregate(p, F.lit(0.0), lambda a, x: a - F.when(x > 0, x / total * F.ln(x / total)).otherwise(0.0))


def fill_gaps(rows: DataFrame, column: str, order: list[str], keys: list[str] = ()) -> DataFrame:
    """Nulls take the last value before them, else the first after them. By default over all rows in one order, which is
    one task; with ``keys`` within each key."""
    w = Window.partitionBy(*keys).orderBy(*order) if keys else Window.orderBy(*order)
    before = F.last(column, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(column, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return rows.withColumn(column, F.coalesce(before, after))


class PrimarySecondary(Estimator):
    """A primary classifier, and a secondary one that also sees how unsure the primary is.

    The entropy that the secondary learns from is out of fold, by purged folds; rows that no fold predicts take their
    ticker's neighbours' (``fill_by_ticker=False``: the neighbours in the order of time and ticker, in one task). Rows need
    datetime, ticker, the features and the columns named by ``label``, ``meta_label`` and, if given, ``weight``.
    """

    def __init__(self, primary, secondary, primary_features: list[str], secondary_features: list[str], n_splits: int = 5, t1: str | None = None, embargo_pct: float = 0.01, fill_by_ticker: bool = True, label: str = "label", meta_label: str = "meta_label", weight: str | None = None):
        super().__init__()
        self.primary, self.secondary = primary, secondary
        self.primary_features, self.secondary_features = primary_features, secondary_features
        self.folds = {"n_splits": n_splits, "t1": t1, "embargo_pct": embargo_pct}
        self.n_splits, self.fill_by_ticker = n_splits, fill_by_ticker
        self.label, self.meta_label, self.weight = label, meta_label, weight

    @staticmethod
    def _train(estimator, rows: DataFrame, features: list[str], label: str, weight: str | None):
        stage = estimator.copy({estimator.labelCol: label, estimator.featuresCol: "_x", **({estimator.weightCol: weight} if weight else {})})
        return stage.fit(VectorAssembler(inputCols=features, outputCol="_x").transform(rows))

    def out_of_fold(self, rows: DataFrame) -> DataFrame:
        """rows with ``oof_entropy``, null where no fold predicts."""
        split = purged_kfold(rows, **self.folds).persist()
        try:
            parts = []
            for k in range(self.n_splits):
                fold = split.filter(F.col("fold") == k)
                model = self._train(self.primary, fold.filter("role = 'train'"), self.primary_features, self.label, self.weight)
                parts.append(_scored(model, fold.filter("role = 'test'"), self.primary_features, "oof"))
        finally:
            split.unpersist()
        seen = reduce(lambda a, b: a.unionByName(b), parts).select("datetime", "ticker", "oof_entropy")
        return rows.join(seen, ["datetime", "ticker"], "left")

    def _fit(self, rows: DataFrame) -> PrimarySecondaryModel:
        oof = fill_gaps(self.out_of_fold(rows), "oof_entropy", ["datetime", "ticker"], ["ticker"] if self.fill_by_ticker else [])
        primary = self._train(self.primary, rows, self.primary_features, self.label, self.weight)
        known = oof.withColumnRenamed("oof_entropy", "primary_entropy").filter("primary_entropy is not null")
        secondary = self._train(self.secondary, known, [*self.secondary_features, "primary_entropy"], self.meta_label, self.weight)
        return PrimarySecondaryModel(primary, secondary, self.primary_features, self.secondary_features)


def _scored(model, rows: DataFrame, features: list[str], prefix: str) -> DataFrame:
    own = model.copy({model.predictionCol: "_prediction", model.probabilityCol: "_probability", model.rawPredictionCol: "_raw"})
    out = own.transform(VectorAssembler(inputCols=features, outputCol="_x").transform(rows))
    p = vector_to_array("_probability")
    return out.withColumns({f"{prefix}_pred": F.col("_prediction"), f"{prefix}_proba": F.element_at(p, 2), f"{prefix}_entropy": entropy(p)}).drop("_x", "_raw", "_probability", "_prediction")


class PrimarySecondaryModel(Model):
    """Both fitted stages; ``save`` and ``load`` keep them with the names of their features."""

    def __init__(self, primary_model, secondary_model, primary_features: list[str], secondary_features: list[str]):
        super().__init__()
        self.primary_model, self.secondary_model = primary_model, secondary_model
        self.primary_features, self.secondary_features = primary_features, secondary_features

    def _transform(self, rows: DataFrame) -> DataFrame:
        """rows with primary_pred, primary_proba, primary_entropy, secondary_proba and final_decision."""
        rows = rows.drop("primary_pred", "primary_proba", "primary_entropy", "secondary_proba", "final_decision")
        out = _scored(self.primary_model, rows, self.primary_features, "primary")
        out = _scored(self.secondary_model, out, [*self.secondary_features, "primary_entropy"], "secondary")
        return out.withColumnRenamed("secondary_pred", "final_decision").drop("secondary_entropy")

    def predict(self, rows: DataFrame) -> DataFrame:
        """rows with ``prediction``, the final decision."""
        return self.transform(rows).select(*rows.columns, F.col("final_decision").alias("prediction"))

    def predict_proba(self, rows: DataFrame) -> DataFrame:
        """rows with ``probability``: of the secondary's classes 0 and 1."""
        return self.transform(rows).select(*rows.columns, F.array(1 - F.col("secondary_proba"), F.col("secondary_proba")).alias("probability"))

    def save(self, path: str) -> None:
        self.primary_model.write().overwrite().save(f"{path}/primary")
        self.secondary_model.write().overwrite().save(f"{path}/secondary")
        rows = [(k, i, c) for k, names in (("primary", self.primary_features), ("secondary", self.secondary_features)) for i, c in enumerate(names)]
        SparkSession.active().createDataFrame(rows, "stage string, place int, name string").coalesce(1).write.mode("overwrite").parquet(f"{path}/features")

    @classmethod
    def load(cls, path: str) -> PrimarySecondaryModel:
        spark = SparkSession.active()
        rows = spark.read.parquet(f"{path}/features").orderBy("place").collect()
        stages = [DefaultParamsReader.loadParamsInstance(f"{path}/{k}", spark.sparkContext) for k in ("primary", "secondary")]
        return cls(*stages, *([r["name"] for r in rows if r.stage == k] for k in ("primary", "secondary")))


def f1(rows: DataFrame, label: str, prediction: str, keys: list[str] = ()) -> DataFrame:
    """(keys, f1) of class 1."""
    hit = F.sum(((F.col(label) == 1) & (F.col(prediction) == 1)).cast("int"))
    miss = F.sum((F.col(label) != F.col(prediction)).cast("int"))
    return rows.groupBy(*keys).agg(F.coalesce(F.try_divide(2.0 * hit, 2 * hit + miss), F.lit(0.0)).alias("f1"))


def log_loss(rows: DataFrame, label: str, p: str, keys: list[str] = ()) -> DataFrame:
    """(keys, log_loss) of probabilities of class 1, cut off 1e-15 from 0 and 1."""
    safe = F.least(F.greatest(F.col(p), F.lit(1e-15)), F.lit(1 - 1e-15))
    loss = -F.avg(F.when(F.col(label) == 1, F.ln(safe)).otherwise(F.ln(1 - safe)))
    return rows.groupBy(*keys).agg(loss.alias("log_loss"))


def metric(name: str) -> Callable[[DataFrame, str], float]:
    """A score of transformed rows: f1 of the predictions, log_loss or auc of the probabilities."""
    if name == "f1":
        return lambda rows, label: rows.transform(lambda r: f1(r, label, "prediction")).first().f1
    kind = {"log_loss": log_loss, "auc": auc}[name]
    return lambda rows, label: kind(rows.withColumn("_p", F.element_at(vector_to_array("probability"), 2)), label, "_p").first()[0]


class Search:
    """Seeded search over settings, each scored fold by fold.

    ``build(settings)`` gives an estimator. The first ``startup`` trials are drawn at random, later ones by tree-structured
    Parzen estimators: of CANDIDATES drawn as the best tenth of trials has chosen, the one that is likeliest among those
    against the others; a setting is tried once (``sampler="random"``: drawn at random throughout). A trial is pruned when
    its running mean is worse than the median of the finished ones at the same fold, once WARM have finished. With
    ``path`` trials are stored after each, and a study of the same name goes on where it ended; a trial depends on the
    seed, its number and the trials before it only. Trials are rows (study, trial, params, choice, fold, score, state).
    """

    CANDIDATES = 24
    WARM = 5
    ROWS = "study string, trial int, params map<string,string>, choice array<int>, fold int, score double, state string"

    def __init__(self, build: Callable[[dict], Estimator], space: dict[str, list], metric: Callable[[DataFrame, str], float], n_trials: int = 50, seed: int = 42, maximise: bool = True, sampler: str = "tpe", startup: int = 10, study: str = "study", path: str | None = None):
        self.build, self.space, self.metric, self.n_trials = build, space, metric, n_trials
        self.seed, self.sign, self.sampler, self.startup, self.study, self.path = seed, 1 if maximise else -1, sampler, startup, study, path
        self.rows: list[tuple] = []

    def settings(self, choice) -> dict:
        return {k: values[c] for (k, values), c in zip(self.space.items(), choice)}

    def _finished(self) -> dict[int, tuple[tuple[int, ...], list[float]]]:
        out: dict[int, tuple[tuple[int, ...], list[float]]] = {}
        for _, trial, _, choice, _, score, state in self.rows:
            if state == "complete":
                out.setdefault(trial, (tuple(choice), []))[1].append(score)
        return out

    def propose(self, trial: int) -> tuple[int, ...] | None:
        """The next setting, as places in the lists of the space; None if all have been tried."""
        tried = {tuple(r[3]) for r in self.rows}
        sizes = [len(v) for v in self.space.values()]
        total = int(np.prod(sizes))
        if len(tried) >= total:
            return None
        rng = np.random.default_rng([self.seed, trial])

        def fresh(choice):
            code = int(np.ravel_multi_index(choice, sizes))
            while (choice := tuple(int(c) for c in np.unravel_index(code % total, sizes))) in tried:
                code += 1
            return choice

        done = sorted(self._finished().values(), key=lambda d: -self.sign * float(np.mean(d[1])))
        if self.sampler == "random" or trial < self.startup or len(done) < 2:
            return fresh(tuple(int(rng.integers(n)) for n in sizes))
        cut = max(1, -(-len(done) // 10))
        weigh = lambda some: [(np.bincount([c[k] for c, _ in some], minlength=n) + 1) / (len(some) + n) for k, n in enumerate(sizes)]
        good, bad = weigh(done[:cut]), weigh(done[cut:])
        drawn = [tuple(int(rng.choice(n, p=good[k])) for k, n in enumerate(sizes)) for _ in range(self.CANDIDATES)]
        gain = lambda c: sum(float(np.log(good[k][i] / bad[k][i])) for k, i in enumerate(c))
        new = [c for c in drawn if c not in tried]
        return max(new, key=gain) if new else fresh(drawn[0])

    def run(self, folds: DataFrame, label: str, timeout: float | None = None) -> DataFrame:
        spark, begun = folds.sparkSession, time.monotonic()
        if self.path:
            spark.createDataFrame([], self.ROWS).write.mode("append").parquet(self.path)
            old = spark.read.schema(self.ROWS).parquet(self.path).filter(F.col("study") == self.study)
            self.rows = [tuple(r) for r in old.orderBy("trial", "fold").collect()]  # one row a fold of each trial
        folds = folds.persist()
        try:
            ids = sorted(r[0] for r in folds.select("fold").distinct().collect())
            for trial in range(1 + max((r[1] for r in self.rows), default=-1), self.n_trials):
                if timeout is not None and time.monotonic() - begun > timeout or (choice := self.propose(trial)) is None:
                    break
                before = [d[1] for d in self._finished().values()]
                scores, state = [], "complete"
                for k in ids:
                    fold = folds.filter(F.col("fold") == k)
                    model = self.build(self.settings(choice)).fit(fold.filter("role = 'train'"))
                    scores.append(float(self.metric(model.transform(fold.filter("role = 'test'")), label)))
                    usual = [self.sign * float(np.mean(d[: len(scores)])) for d in before]
                    if len(usual) >= self.WARM and len(scores) < len(ids) and self.sign * float(np.mean(scores)) < float(np.median(usual)):
                        state = "pruned"
                        break
                named = {a: str(b) for a, b in self.settings(choice).items()}
                new = [(self.study, trial, named, list(choice), int(k), s, state) for k, s in zip(ids, scores)]
                self.rows += new
                if self.path:
                    spark.createDataFrame(new, self.ROWS).coalesce(1).write.mode("append").parquet(self.path)
        finally:
            folds.unpersist()
        self.trials = spark.createDataFrame(self.rows, self.ROWS)
        return self.trials

    def best(self) -> dict:
        """The setting of the finished trial with the best mean score, the first on ties."""
        done = self._finished()
        top = min(done, key=lambda t: (-self.sign * float(np.mean(done[t][1])), t))
        return self.settings(done[top][0])

    def rebuilt(self) -> Estimator:
        return self.build(self.best())


class ModelEngine:
    """Search (a ``Search`` or a ``search.Study``), refit on all training rows, score once on the hold-out, store with tags."""

    def __init__(self, search, path: str | None = None, tags: dict[str, str] | None = None):
        self.search, self.path, self.tags, self.model = search, path, tags or {}, None

    def validate(self, model: Model, rows: DataFrame, label: str) -> float:
        return float(self.search.metric(model.transform(rows), label))

    def register(self, model: Model, score: float, run: str = "run") -> None:
        """Keeps the model below ``path``/models/``run`` and a row of its settings, tags and score in ``path``/runs."""
        model.write().overwrite().save(f"{self.path}/models/{run}")
        row = (run, {k: str(v) for k, v in self.search.best().items()}, self.tags, score)
        SparkSession.active().createDataFrame([row], "run string, params map<string,string>, tags map<string,string>, score double").coalesce(1).write.mode("append").parquet(f"{self.path}/runs")
        self.search.trials.write.mode("append").parquet(f"{self.path}/trials")

    def load(self, run: str = "run") -> Model:
        return DefaultParamsReader.loadParamsInstance(f"{self.path}/models/{run}", SparkSession.active().sparkContext)

    def run(self, folds: DataFrame, train: DataFrame, test: DataFrame, label: str, run: str = "run"):
        self.search.run(folds, label)
        self.model = self.search.rebuilt().fit(train)
        score = self.validate(self.model, test, label)
        if self.path:
            self.register(self.model, score, run)
        return self.model, score


class _Rule(DefaultParamsReadable, DefaultParamsWritable):
    inputCol = Param(Params._dummy(), "inputCol", "input column", TypeConverters.toString)
    factor = Param(Params._dummy(), "factor", "share of the training mean", TypeConverters.toFloat)
    level = Param(Params._dummy(), "level", "values below it are of class 1", TypeConverters.toFloat)


class BelowMean(Estimator, _Rule):
    """A baseline: class 1 where a column is below ``factor`` times its mean over the training rows."""

    @keyword_only
    def __init__(self, *, inputCol="close", factor=1.0):
        super().__init__()
        self._setDefault(inputCol="close", factor=1.0)
        self._set(**self._input_kwargs)

    def _fit(self, rows: DataFrame) -> BelowMeanModel:
        mean = rows.agg(F.avg(self.getOrDefault(self.inputCol))).first()[0]
        return BelowMeanModel()._set(inputCol=self.getOrDefault(self.inputCol), level=float(mean or 0.0) * self.getOrDefault(self.factor))


class BelowMeanModel(Model, _Rule):
    def _transform(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("prediction", (F.col(self.getOrDefault(self.inputCol)) < self.getOrDefault(self.level)).cast("double"))


class AssetOrganiser:
    """Panel, split by a cutoff, fit on what is before it, decide on what is after."""

    def __init__(self, classifier: Estimator, panel: DataFrame, cutoff):
        self.classifier, self.panel, self.cutoff, self.model, self._test = classifier, panel, cutoff, None, None

    def prepare(self) -> AssetOrganiser:
        self.model = self.classifier.fit(self.panel.filter(F.col("datetime") < F.lit(self.cutoff)))
        self._test = self.model.transform(self.panel.filter(F.col("datetime") >= F.lit(self.cutoff)))
        return self

    def test(self, ticker: str | None = None) -> DataFrame:
        if self._test is None:
            raise ValueError("prepare() comes first")
        return self._test if ticker is None else self._test.filter(F.col("ticker") == ticker).drop("ticker")


class _Windowed(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """A transformer over (ticker, datetime, inputCol) that adds outputCol; with ``inputCols`` each of them is transformed
    into a column of its name and the suffix of outputCol."""

    inputCol = Param(Params._dummy(), "inputCol", "input column", TypeConverters.toString)
    inputCols = Param(Params._dummy(), "inputCols", "input columns, instead of inputCol", TypeConverters.toListString)
    outputCol = Param(Params._dummy(), "outputCol", "output column", TypeConverters.toString)

    def get(self, name: str):
        return self.getOrDefault(getattr(self, name))

    def pairs(self) -> list[tuple[str, str]]:
        many = self.get("inputCols") if self.isSet(self.inputCols) else []
        return [(c, f"{c}_{self.get('outputCol')}") for c in many] or [(self.get("inputCol"), self.get("outputCol"))]

    def _transform(self, rows: DataFrame) -> DataFrame:
        return reduce(lambda out, pair: self.one(out, *pair), self.pairs(), rows)


class FractionalDiff(_Windowed):
    d = Param(Params._dummy(), "d", "order of the difference", TypeConverters.toFloat)
    threshold = Param(Params._dummy(), "threshold", "least weight", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, inputCol="close", inputCols=None, outputCol="frac_diff", d=0.4, threshold=1e-3):
        super().__init__()
        self._setDefault(inputCol="close", outputCol="frac_diff", d=0.4, threshold=1e-3)
        self._set(**self._input_kwargs)

    def one(self, rows: DataFrame, column: str, name: str) -> DataFrame:
        return _windows.frac_diff(rows, column, self.get("d"), self.get("threshold"), name=name)


class TrendScanning(_Windowed):
    windows = Param(Params._dummy(), "windows", "window lengths", TypeConverters.toListInt)

    @keyword_only
    def __init__(self, *, inputCol="close", inputCols=None, outputCol="trend_t", windows=[5, 10, 15, 20, 30, 40, 60, 80, 100, 120, 150, 180]):  # noqa: B006
        super().__init__()
        self._setDefault(inputCol="close", outputCol="trend_t", windows=[5, 10, 15, 20, 30, 40, 60, 80, 100, 120, 150, 180])
        self._set(**self._input_kwargs)

    def one(self, rows: DataFrame, column: str, name: str) -> DataFrame:
        return _windows.trend_scan(rows, column, self.get("windows"), name)


class BackwardSadf(_Windowed):
    minLength = Param(Params._dummy(), "minLength", "least rows of a window", TypeConverters.toInt)
    lags = Param(Params._dummy(), "lags", "lagged differences", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCol="close", inputCols=None, outputCol="bsadf", minLength=20, lags=1):
        super().__init__()
        self._setDefault(inputCol="close", outputCol="bsadf", minLength=20, lags=1)
        self._set(**self._input_kwargs)

    def one(self, rows: DataFrame, column: str, name: str) -> DataFrame:
        got = _bsadf.bsadf(rows, column, "linear", self.get("lags"), self.get("minLength"))
        return rows.join(got.withColumnRenamed("bsadf", name), ["ticker", "datetime"], "left")


class TripleBarrier(_Windowed):
    """Labels; the stop is the column ``stopCol``, or the constant ``stop`` as a price level."""

    stopCol = Param(Params._dummy(), "stopCol", "stop column, or empty", TypeConverters.toString)
    stop = Param(Params._dummy(), "stop", "constant stop", TypeConverters.toFloat)
    multiple = Param(Params._dummy(), "multiple", "target distance in stop distances", TypeConverters.toFloat)
    horizon = Param(Params._dummy(), "horizon", "bars to the time limit", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCol="close", stopCol="", stop=1.0, multiple=1.0, horizon=10):
        super().__init__()
        self._setDefault(inputCol="close", stopCol="", stop=1.0, multiple=1.0, horizon=10)
        self._set(**self._input_kwargs)

    def _transform(self, rows):
        own = self.get("stopCol")
        if own and own not in rows.columns:
            raise ValueError(f"column {own} is missing")
        marked = rows.withColumn("_stop", F.col(own) if own else F.lit(self.get("stop")))
        return _labels.triple_barrier(marked, self.get("inputCol"), "_stop", self.get("multiple"), self.get("horizon")).drop("_stop")


def auc(rows: DataFrame, label: str, score: str, keys: list[str] = ()) -> DataFrame:
    """(keys, auc): chance that a row of class 1 scores above one of class 0, ties counting half.

    Scores are added up by value first, so that the running count meets one row a distinct score.
    """
    by = rows.groupBy(*keys, F.col(score).alias("_s")).agg(F.sum((F.col(label) == 1).cast("long")).alias("_p"), F.sum((F.col(label) != 1).cast("long")).alias("_n"))
    w = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    below = by.withColumn("_below", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    wins = F.sum(F.col("_p") * (F.col("_below") + F.col("_n") / 2))
    return below.groupBy(*keys).agg(F.try_divide(wins, F.sum("_p") * F.sum("_n")).alias("auc"))


def scores(model: Model, rows: DataFrame, label: str) -> DataFrame:
    """(f1, log_loss, n) of a model with probabilities, as one aggregate."""
    out = model.transform(rows).withColumn("_p", F.element_at(vector_to_array("probability"), 2))
    return f1(out, label, "prediction").join(log_loss(out, label, "_p")).join(out.agg(F.count("*").alias("n")))
