import random

import numpy as np
import pytest

from tidemark.llm import toxic


@pytest.fixture(scope="module")
def marked(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(300)]
    seeds = ["idiot", "moron", "clown", "worthless", "pathetic", "scum", "trash", "vermin"]
    rows, labels = [], []
    for i in range(500):
        bad = i % 5 == 0
        text = [rng.choice(words) for _ in range(rng.randint(5, 60))]
        if bad:
            for w in rng.sample(seeds, 3):
                text.insert(rng.randrange(len(text)), w.upper() if i % 2 else w)
        rows.append((i, " ".join(text), "x"))
        labels.append((i, 1, int(bad)))
    rows += [(900, None, "x"), (901, "", "x"), (902, "word " * 30_000 + "idiot scum pathetic", "x"), (None, "nothing", "x")]
    labels += [(0, 1, 0), (None, 0, 1), (7, 1, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, p_toxic string").repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out(marked):
    docs, labels = marked
    chain = toxic.fit(docs, labels)
    rows = toxic.score(docs, chain).collect()
    assert len(rows) == 504
    held = [r for r in rows if r.held_out and r.doc_id < 500]
    assert all(r.predicted == (r.doc_id % 5 == 0) for r in held)
    assert next(r for r in rows if r.doc_id == 902).predicted == 1
    assert all(0 <= r[c] <= 1 for r in rows for c in ("p_kind_1", "p_kind_2", "p_kind_3", "p_toxic"))
    assert toxic.score(docs.limit(0), chain).count() == 0


def test_later_models_see_earlier_categories(marked):
    docs, labels = marked
    chain = toxic.fit(docs, labels)
    kept = int((chain.place >= 0).sum())
    assert [len(w) - kept - 1 for w in chain.weights] == [0, 1, 2, 3]
    assert np.abs(chain.weights[3][kept:-1]).max() > 1e-3


def test_logistic_against_gradient():
    rng = np.random.default_rng(0)
    x = (rng.random((400, 6)) < 0.4).astype(float)
    y = (rng.random(400) < 1 / (1 + np.exp(-(x @ [2, -2, 1, 0, 0, 3] - 1)))).astype(float)
    w = toxic.logistic(x, y, penalty=1.0, rounds=200)
    p = 1 / (1 + np.exp(-(x @ w[:-1] + w[-1])))
    assert np.abs(np.append(x.T @ (p - y) + w[:-1], (p - y).sum())).max() < 0.05


def newton(x, y, penalty=0.3):
    """The same model as ``toxic.logistic``, by plain Newton steps."""
    full, w = np.column_stack([x, np.ones(len(x))]), np.zeros(x.shape[1] + 1)
    keep = np.append(np.full(x.shape[1], penalty), 1e-9)
    for _ in range(60):
        p = 1 / (1 + np.exp(-full @ w))
        w = w + np.clip(np.linalg.solve((full.T * (p * (1 - p))) @ full + np.diag(keep), full.T @ (y - p) - keep * w), -2, 2)
    return w


def test_chain_against_brute_force():
    rng = np.random.default_rng(3)
    n = 400
    toxic_ = (rng.random(n) < 0.3).astype(np.int64)
    kind = rng.integers(0, 2, n)
    bags = [np.unique(np.concatenate([rng.integers(100, 130, 4), rng.integers(10 + 10 * k, 16 + 10 * k, 2) if t and rng.random() < 0.9 else rng.integers(60, 90, 2)])).astype(np.int32) for t, k in zip(toxic_, kind)]
    names = {"first": toxic_ * (kind == 0), "second": toxic_ * (kind == 1)}
    chain = toxic.train(bags, toxic_, names)
    table = lambda used: np.array([[float(f in set(b.tolist())) for f in used] for b in bags])
    x, fold = table(np.flatnonzero(chain.place >= 0)), toxic.fold_of(bags, 5)
    without = [table(toxic.chosen([b for b, f in zip(bags, fold) if f != k], toxic_[fold != k])[0]) for k in range(5)]
    earlier, real = np.zeros((n, 0)), np.zeros((n, 0))
    for y in [*names.values(), toxic_]:
        out = np.zeros(n)
        for k in range(5):
            own = np.column_stack([without[k], earlier])
            w = newton(own[fold != k], y[fold != k])
            out[fold == k] = 1 / (1 + np.exp(-(own[fold == k] @ w[:-1] + w[-1])))
        w = newton(np.column_stack([x, earlier]), y)
        real = np.column_stack([real, 1 / (1 + np.exp(-(np.column_stack([x, real]) @ w[:-1] + w[-1])))])
        earlier = np.column_stack([earlier, out])
    assert np.abs(chain.predict(bags) - real).max() < 0.02
    assert chain.names == ["first", "second", "toxic"]


def test_kinds_are_clusters_of_toxic_rows():
    rng = np.random.default_rng(1)
    toxic_ = np.repeat([1, 1, 1, 0], [60, 40, 20, 200])
    group = np.repeat([0, 1, 2, 3], [60, 40, 20, 200])
    x = np.zeros((320, 9))
    for i, g in enumerate(group):
        if g < 3:
            x[i, 3 * g + rng.integers(0, 3, 2)] = 1
    got = toxic.kinds_of(x, toxic_, 3)
    assert (got[toxic_ == 0] == -1).all() and set(got[toxic_ == 1].tolist()) == {0, 1, 2}
    assert np.bincount(got[toxic_ == 1]).tolist() == sorted(np.bincount(got[toxic_ == 1]).tolist(), reverse=True)


def test_copies_share_a_fold_and_long_and_repeated_documents_are_bounded(marked):
    docs, labels = marked
    bag = np.arange(9, dtype=np.int32)
    assert len(set(toxic.fold_of([bag, bag.copy(), bag.copy()], 5).tolist())) == 1
    a, b = toxic.fit(docs, labels), toxic.fit(docs.union(docs).union(docs.filter("doc_id = 9").selectExpr("doc_id", "'zzz' as text", "p_toxic")), labels)
    assert all(np.allclose(v, w) for v, w in zip(a.weights, b.weights))


def test_the_last_words_of_a_long_text_are_learned_from(spark, marked):
    docs, labels = marked
    long = "concat_ws(' ', transform(sequence(1, 15000), k -> concat('w', translate(k, '0123456789', 'abcdefghij'))))"
    own = docs.filter("doc_id in (1, 2, 3, 4, 6, 7, 8, 9, 11, 12)")
    clean = docs.filter("doc_id < 60").selectExpr("doc_id + 2000 as doc_id", f"{long} as text", "p_toxic")  # the same words, so that only the end tells
    more = [docs.union(clean).union(own.selectExpr("doc_id + 1000 as doc_id", f"concat({long}, ' {tail}') as text", "p_toxic")) for tail in ("zorgle zorgle", "")]
    ids = [r.doc_id for r in own.collect()]
    marks = labels.union(spark.createDataFrame([*((1000 + i, 1, 1) for i in ids), *((2000 + i, 1, 0) for i in range(60))], "doc_id long, quality int, toxic int"))
    with_, without = (toxic.fit(m, marks) for m in more)
    feature = int(toxic.hashed("zorgle")[np.isin(toxic.hashed("zorgle"), toxic.hashed("zorg"), invert=True)][0])
    assert with_.place[feature] >= 0 and without.place[feature] < 0


def test_features_are_chosen_without_the_fold():
    toxic_ = np.array([1] * 20 + [0] * 20)
    bags = [np.array([5, 100 + i], np.int32) if t else np.array([7, 200 + i], np.int32) for i, t in enumerate(toxic_)]
    assert toxic.chosen(bags, toxic_)[0].tolist() == [5, 7] and toxic.chosen(bags[20:], toxic_[20:])[0].tolist() == []


def test_without_both_classes(marked):
    docs, labels = marked
    rows = toxic.score(docs, toxic.fit(docs, labels.filter("toxic = 0"))).collect()
    assert len({r.p_toxic for r in rows}) == 1 and all(r.predicted == 0 for r in rows)
    assert toxic.score(docs, toxic.fit(docs, labels.limit(0))).first().p_toxic == 0.5
