"""The define-by-run study."""

import math

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression

from tidemark.operators import learning, splits
from tidemark.operators.search import FixedTrial, Range, Study, density, sample

from .test_market import samples


def answers(t):
    kind = t.suggest_categorical("kind", ["a", "b"])
    x, k = t.suggest_float("x", 0.001, 10, log=True), t.suggest_int("k", 1, 50)
    return kind, x, k, t.suggest_float("y", 0, 1, step=0.1) if kind == "b" else 0.0


def play(seed, n=60, jobs=1, startup=8):
    study = Study(None, None, n, seed=seed, startup=startup, jobs=jobs)
    for i in range(n):
        t = study.ask(i)
        kind, x, k, y = answers(t)
        study.tell(t, [0], [-abs(math.log(x / 0.1)) - abs(k - 20) / 10 - (0.5 if kind == "a" else abs(y - 0.7))])
    return study


def test_densities_find_better_settings_than_chance():
    top = lambda **s: np.mean([max(r[6] for r in play(seed, **s).rows) for seed in range(6)])
    by_chance = top(startup=61)
    assert top() > 0.75 * by_chance and top(jobs=3) > 0.75 * by_chance  # scores are below 0


def test_conditional_settings_are_asked_for_only_where_they_matter():
    study = play(3)
    for _, _, params, inner, origin, _, _, _ in study.rows:
        assert ("y" in params) == (params["kind"] == "b") and set(params) == set(inner) == set(origin)
    assert {r[4]["x"] for r in study.rows[:8]} == {"start"} and {r[4]["x"] for r in study.rows[8:]} == {"parzen"}
    assert study.best()["kind"] == "b" and isinstance(study.best()["k"], int)


def test_a_trial_knows_only_the_trials_before_its_neighbours():
    whole, part = play(1, 20, jobs=4), play(1, 16, jobs=4)
    part.rows = part.rows[:13]  # trials 13 to 15 still run
    t = part.ask(16)
    answers(t)
    assert {k: str(v) for k, v in t.params.items()} == whole.rows[16][2]


@pytest.mark.parametrize("centres", [[], [0.0], [1.0, 1.1, 3.9]])
def test_density_is_one_and_samples_follow_it(centres):
    at = np.linspace(0, 4, 4001)
    p = np.array([density(x, centres, 0.0, 4.0) for x in at])
    assert np.trapezoid(p, at) == pytest.approx(1, abs=1e-4)
    rng = np.random.default_rng(0)
    drawn = np.sort([sample(centres, 0.0, 4.0, u, v) for u, v in rng.random((20_000, 2))])
    assert drawn[0] >= 0 and drawn[-1] <= 4
    below = np.searchsorted(drawn, at) / len(drawn)
    assert np.abs(below - np.concatenate([[0], np.cumsum((p[1:] + p[:-1]) / 2 * np.diff(at))])).max() < 0.02


def test_ranges():
    r = Range(1, 9, 2, whole=True)
    assert r.ends() == (0, 10) and [r.value(x) for x in (0, 1.9, 2.1, 9.99, 10)] == [1, 1, 3, 9, 9]
    assert Range(0.0, 1.0, 0.3).value(1.15) == pytest.approx(0.9)  # the grid's last value, below the end
    assert Range(1, 100, 1, log=True, whole=True).value(math.log(100.4)) == 100
    for bad in ((2, 1), (0, 1, None, True), (1, 2, -1.0), (1, 2, 0.5, True)):
        with pytest.raises(ValueError):
            Range(*bad)


def test_fixed_trial_gives_the_same_answers():
    study = play(5, 12)
    assert answers(FixedTrial(study.best()))[:3] == (study.best()["kind"], study.best()["x"], study.best()["k"])
    shown = {k: str(v) for k, v in study.best().items()}  # as a reloaded study has them
    assert answers(FixedTrial(shown))[:3] == answers(FixedTrial(study.best()))[:3]
    for missing in ({}, {"kind": "c"}):
        with pytest.raises(ValueError):
            answers(FixedTrial(missing))


def test_run_resume_and_engine(spark, tmp_path):
    rows = samples(spark)
    folds = splits.purged_kfold(rows, 3)
    asked = []

    def build(t):
        column = t.suggest_categorical("column", ["a", "b"])
        asked.append(t.params)
        return learning.BelowMean(inputCol=column, factor=t.suggest_float("factor", -2.0, 2.0))

    made = lambda n, path, jobs=2: Study(build, learning.metric("f1"), n, startup=3, jobs=jobs, prune=False, path=path)
    once = made(7, f"file://{tmp_path}/whole").run(folds, "y").orderBy("trial", "fold").collect()
    made(4, f"file://{tmp_path}/parts").run(folds, "y")
    before = len(asked)
    again = made(7, f"file://{tmp_path}/parts").run(folds, "y").orderBy("trial", "fold").collect()
    assert once == again and len(once) == 21 and len(asked) - before == 3
    assert {r.origin["factor"] for r in once if r.trial >= 4} == {"parzen"}
    engine = learning.ModelEngine(made(7, f"file://{tmp_path}/parts"), f"file://{tmp_path}/runs")
    model, score = engine.run(folds, rows, rows, "y")
    assert model.getOrDefault("inputCol") == engine.search.best()["column"] and 0 <= score <= 1
    assert made(9, None).run(folds, "y", timeout=-1).count() == 0


def test_pruning(spark):
    folds = splits.purged_kfold(samples(spark), 3)
    scores = {0: 0.9, 1: 0.8, 2: 0.7, 3: 0.6, 4: 0.5, 5: 0.1, 6: 0.95, 7: 0.2}
    asked = []
    study = Study(lambda t: asked.append(t.number) or learning.BelowMean(inputCol="a", factor=t.suggest_float("f", 0, 1)), lambda rows, label: scores[asked[-1]], 8, startup=100)
    states = {r.trial: (r.state, r.fold) for r in study.run(folds, "y").collect()}
    for t in range(8):
        done = [scores[j] for j in range(t) if states[j][0] == "complete"]
        assert states[t][0] == ("pruned" if len(done) >= 5 and scores[t] < np.median(done) else "complete")
    assert study._seen(8)[-1][3] == "pruned" and LogisticRegression
