import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import mih, pq
from tidemark.llm.components import local_forest

NAN = float("nan")


def table(spark, n=600, dim=16, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)).astype(np.float32)
    for i in range(40, n, 9):  # near copies of all degrees
        x[i] = x[i - 40] + rng.normal(size=dim) * rng.choice([0.0, 0.02, 0.1, 0.2, 0.25])
    x[100:160] = x[100] + rng.normal(size=(60, dim)) * 0.05  # one large group
    rows = [(i, v.tolist(), int(i % 3) if i % 50 else None) for i, v in enumerate(x)]
    rows[100:160] = [(i, v, 1) for i, v, _ in rows[100:160]]
    rows[7], rows[8] = (7, x[5].tolist(), 2), (8, (2 * x[5]).tolist(), 2)
    rows[5] = (5, x[5].tolist(), 2)
    rows += [(n, None, 1), (n + 1, [], 1), (n + 2, [0.0] * dim, 1), (n + 3, [NAN] + [1.0] * (dim - 1), 1), (n + 4, [None] + [1.0] * (dim - 1), 1), (n + 5, [float("inf")] * dim, 1), (n + 6, [1.0, 2.0], 1), (n + 7, [1.0, 2.0], 1)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4), rows


def brute_links(rows, cosine):
    ok = [(i, np.array(v, dtype=float), k) for i, v, k in rows if k is not None and v and all(a is not None and np.isfinite(a) for a in v) and any(v)]
    a, b = [], []
    for i, v, k in ok:
        for j, w, m in ok:
            if i < j and k == m and len(v) == len(w) and v @ w / (np.sqrt(v @ v) * np.sqrt(w @ w)) >= cosine:
                a.append(i)
                b.append(j)
    return np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)


@pytest.mark.parametrize("block", [4096, 16])
def test_links_and_components(spark, monkeypatch, block):
    monkeypatch.setattr(pq, "BLOCK", block)
    df, rows = table(spark)
    a, b = brute_links(rows, 0.98)
    n = np.bincount(np.concatenate([a, b]), minlength=len(rows))
    low = dict(zip(*local_forest(a, b)))
    got = pq.near_copies(df.withColumns({c: F.lit(1) for c in ("rep", "v", "h1", "cell", "component")})).collect()
    assert len(got) == len(rows) and len(a) > 1500
    for r in got:
        assert (r.n_links, r.component_id, r.kept) == (n[r.vec_id], low.get(r.vec_id, r.vec_id), low.get(r.vec_id, r.vec_id) == r.vec_id)


def test_no_vectors(spark):
    df, _ = table(spark)
    assert pq.near_copies(df.limit(0)).count() == 0
    only = pq.near_copies(df.filter("vec_id in (600, 601, 602)")).collect()
    assert [(r.n_links, r.kept) for r in only] == [(0, True)] * 3
    copies = pq.near_copies(df.filter("vec_id = 5").union(df.filter("vec_id = 5")).union(df.filter("vec_id = 5").withColumn("vec_id", F.lit(None).cast("long")))).collect()
    assert sorted((r.vec_id or -1, r.n_links, r.kept) for r in copies) == [(-1, 0, False), (5, 1, True), (5, 1, True)]


def test_an_id_with_two_vectors(spark):
    a, b, c = [1.0] + [0.0] * 7, [1.0, 0.1] + [0.0] * 6, [0.0] * 7 + [1.0]
    rows = [(5, a, 1), (5, c, 1), (9, b, 1), (12, c, 1), (13, c, 2), (14, None, 1), (14, b, 1)]
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in pq.near_copies(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect())
    assert got == [(5, 1, 5, True), (5, 2, 5, True), (9, 2, 5, False), (12, 1, 5, False), (13, 0, 13, True), (14, 0, 14, True), (14, 2, 5, False)]


def test_links_between_many_lists(spark, monkeypatch):
    fit = pq.fit
    monkeypatch.setattr(pq, "fit", lambda x, lists: fit(x, 24))
    monkeypatch.setattr(pq, "BLOCK", 20)
    df, rows = table(spark, n=900, dim=6, seed=4)
    a, b = brute_links(rows, 0.98)
    n = np.bincount(np.concatenate([a, b]), minlength=len(rows))
    low = dict(zip(*local_forest(a, b)))
    for r in pq.near_copies(df).collect():
        assert (r.n_links, r.component_id) == (n[r.vec_id], low.get(r.vec_id, r.vec_id))


def test_lists_that_are_not_probed_hold_no_link():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 8))
    x /= np.linalg.norm(x, axis=1)[:, None]
    quantiser = pq.fit(x, 20)
    far = (quantiser.coarse**2).sum(1) - 2 * x @ quantiser.coarse.T
    home = far.argmin(1)
    gap = far - far[np.arange(len(x)), home][:, None]
    apart = np.linalg.norm(quantiser.coarse[home][:, None] - quantiser.coarse[None], axis=2)
    probe = gap <= 2 * 0.2 * apart + 1e-9
    i, j = np.nonzero(x @ x.T >= 0.98)
    assert probe[i, home[j]].all()
    assert probe.mean() < 0.6


def test_nearest_neighbours(spark):
    df, rows = table(spark, n=1500, dim=64, seed=2)
    got = mih.search(df, df.filter("vec_id % 20 = 0"), k=20).collect()
    ok = {i: np.array(v, dtype=float) for i, v, _ in rows if v and len(v) == 64 and all(a is not None and np.isfinite(a) for a in v) and any(v)}
    ids = np.array(list(ok))
    x = np.stack(list(ok.values()))
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r)
        assert r.score == pytest.approx(float(ok[r.query_id] @ ok[r.vec_id]), rel=1e-12, abs=1e-12)
    assert set(by) == {i for i in ok if i % 20 == 0}
    hit = 0
    for q, rs in by.items():
        rs.sort(key=lambda r: r.rank)
        assert [r.rank for r in rs] == list(range(1, 21)) and q not in {r.vec_id for r in rs}
        assert all((-a.score, a.vec_id) < (-b.score, b.vec_id) for a, b in zip(rs, rs[1:]))
        score = x @ ok[q]
        score[ids == q] = -np.inf
        hit += len({r.vec_id for r in rs} & set(ids[np.lexsort([ids, -score])[:20]].tolist()))
    assert hit / (20 * len(by)) >= 0.9


def test_few_candidates_and_none(spark):
    df, _ = table(spark, n=200, dim=16)
    few = df.filter("vec_id in (0, 1, 2, 3)")
    got = mih.search(few, few.filter("vec_id = 0"), k=20).collect()
    assert sorted(r.vec_id for r in got) == [1, 2, 3] and sorted(r["rank"] for r in got) == [1, 2, 3]
    assert mih.search(df.limit(0), df, 5).count() == 0
    assert mih.search(df, df.limit(0), 5).count() == 0
    assert mih.search(df.filter("vec_id = 0"), df.filter("vec_id = 0"), 5).count() == 0


def test_ties_between_equal_vectors_go_by_id(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(700, 37))
    for g in range(30):  # 30 groups of 15 equal vectors at odd places
        x[rng.choice(700, 15, replace=False)] = rng.normal(size=37)
    ids = np.arange(700)
    for i in range(0, 700, 20):
        for part in (ids, np.sort(rng.choice(ids, 333, replace=False)), ids[::-1]):
            got, score = mih._best(x[part].copy(), part, np.arange(len(part)), x[i], 40)
            exact = {int(j): mih.inner(x[j : j + 1], x[i])[0] for j in part}
            assert got.tolist() == sorted(exact, key=lambda j: (-exact[j], j))[:40]
            assert score.tolist() == [exact[j] for j in got]
    rows = [(int(i), v.tolist(), 0) for i, v in enumerate(x)]
    found = mih.search(df := spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), df.filter("vec_id % 20 = 0"), k=20).collect()
    by = {}
    for r in found:
        by.setdefault(r.query_id, []).append((-r.score, r.vec_id))
    same = [[i for i in range(700) if (x[i] == x[j]).all()] for j in range(700)]
    for q, rs in by.items():
        for s, i in rs:
            peers = [j for j in same[i] if j != q and j < i]
            assert all((s, j) in rs for j in peers)  # a later copy only after every earlier one


def test_radius_grows_until_k_are_met(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 20))
    hasher = mih.fit(x, float(np.linalg.norm(x, axis=1).max()), 5, 0.9)
    hasher.radius = 7

    class Shipped:
        value = hasher

    import pyarrow as pa

    t = lambda rows: pa.table({"vec_id": pa.array(rows), "v": pa.array([x[i].tolist() for i in rows])})
    got = mih._search(Shipped, 290)(t([0, 20]), t(list(range(300))))
    assert len(got) == 580


def test_every_code_within_the_radius_is_retrieved():
    rng = np.random.default_rng(3)
    codes = rng.integers(0, 1 << 63, 3000, dtype=np.uint64) >> rng.integers(0, 30, 3000).astype(np.uint64)
    hasher = mih.Hasher(None, None, 1.0, 12)
    for radius in (7, 12, 19):
        index = mih.Index(codes, hasher.thresholds(radius))
        for c in codes[:40]:
            near = np.flatnonzero(np.bitwise_count(codes ^ c) <= radius)
            assert set(near) <= set(index.probe(np.array([c])))
