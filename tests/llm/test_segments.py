import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import segments

INF, NAN = float("inf"), float("nan")


def brute(rows, parts=16, entries=64, rounds=2):
    """(codes and errors by place in rows, codebooks); plain integers throughout."""
    usual = [(i, v) for i, v in enumerate(rows) if v is not None]
    x = {i: [int(np.floor(c * 256.0)) for c in v] for i, v in usual}
    d = len(next(iter(x.values())))
    at = [d * k // parts for k in range(parts + 1)]
    books = [[x[i][a:b] for i in list(x)[:entries]] for a, b in zip(at, at[1:])]
    near = lambda part, book: min((sum((p - q) ** 2 for p, q in zip(part, e)), k) for k, e in enumerate(book))
    for r in range(rounds + 1):
        found = {i: [near(v[a:b], book) for book, a, b in zip(books, at, at[1:])] for i, v in x.items()}
        if r < rounds:
            for p in range(parts):
                for e in range(len(books[p])):
                    mine = [x[i][at[p] : at[p + 1]] for i in x if found[i][p][1] == e]
                    if mine:
                        books[p][e] = [sum(c) // len(mine) for c in zip(*mine)]
    return {i: ("".join(f"{k:02x}" for _, k in f), sum(e for e, _ in f)) for i, f in found.items()}, books


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)


@pytest.mark.parametrize("dim", [32, 16, 48, 20])
def test_codes_against_brute_force(spark, dim):
    rng = np.random.default_rng(dim)
    x = (rng.normal(size=(150, dim)) * rng.choice([0.01, 1, 30], size=(150, 1))).astype(np.float32)
    x[100:120] = x[3]
    x[130] = 0
    rows = [(i, v.tolist(), [1, 2, None][i % 3]) for i, v in enumerate(x)]
    odd = [(900, None, 1), (901, [NAN] * dim, 1), (902, [None] + [0.0] * (dim - 1), 1), (903, [INF] * dim, 1)]
    aside = [(904, [1.0], 1), (905, [], 1), (906, [1e30] + [0.0] * (dim - 1), 2)]
    want, books = brute([v for _, v, _ in rows])
    sums = {k: sum(want[i][1] for i, _, label in rows if label == k) for k in (1, 2, None)}
    df = table(spark, rows + odd + aside).withColumns({c: F.lit("x") for c in ("v", "code", "error", "own", "slot", "label_error")})
    got = {r.vec_id: r for r in segments.coded(df).collect()}
    assert set(got) == {*range(150), 904, 905, 906}
    digest = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    for i, _, label in rows:
        assert (got[i].code, got[i].error, got[i].label_error, got[i].codebooks_sha256) == (*want[i], sums[label], digest)
    assert all(got[i].code is None and got[i].error is None for i in (904, 905, 906))


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 9), st.integers(1, 70), st.integers(1, 40), st.sampled_from([1, 300, 100_000_000]), st.integers(0, 1 << 30))
def test_bounds_never_change_the_nearest(width, entries, rows, scale, seed):
    rng = np.random.default_rng(seed)
    book = rng.integers(-scale, scale + 1, size=(entries, width))
    book[rng.integers(entries)] = book[0]  # ties go to the lower index
    x = np.concatenate([rng.integers(-scale, scale + 1, size=(rows, width)), book[-1:]])
    index, far, _ = segments.Codebook(book).nearest(x)
    every = ((x[:, None] - book) ** 2).sum(2)
    assert (far == every.min(1)).all() and (index == every.argmin(1)).all()


def test_bounds_leave_most_entries_out():
    rng = np.random.default_rng(0)
    smooth = lambda n, width: np.cumsum(rng.integers(-300, 300, size=(n, width)), axis=1) + rng.integers(-2000, 2000, size=(n, 1))
    for width in (8, 64):
        assert segments.Codebook(smooth(64, width)).nearest(smooth(500, width))[2] < 0.2 * 500 * 64


def test_few_and_no_vectors(spark):
    df = table(spark, [(2, [1.0] * 16, None), (1, [0.5] * 16, None), (1, [0.25] * 16, 3), (None, [9.0] * 16, 3), (7, None, 3)])
    got = sorted((r.vec_id or 99, r.code, r.error, r.label_error) for r in segments.coded(df).collect())
    assert got == [(1, "00" * 16, 0, 0), (1, "01" * 16, 0, 0), (2, "02" * 16, 0, 0), (99, "03" * 16, 0, 0)]
    assert segments.coded(df.limit(0)).count() == 0 == segments.coded(df.filter("vec_id = 7")).count()
    assert [r.code for r in segments.coded(table(spark, [(1, [], 1)])).collect()] == ["00" * 16]
    assert segments.coded(table(spark, [(i, [float(i), 1.0], 1) for i in range(5)])).filter("error = 0").count() == 5
    with pytest.raises(ValueError):
        segments.compress(df, entries=300)


def test_decoded_vectors_are_near(spark):
    x = np.random.default_rng(1).normal(size=(100, 32)).astype(np.float32)
    df = table(spark, [(i, v.tolist(), 1) for i, v in enumerate(x)])
    codes, books = segments.compress(df)
    for r in segments.decode(codes, books).collect():
        whole = np.floor(x[r.vec_id].astype(float) * 256)
        assert ((np.array(r.decoded) * 256 - 0.5 - whole) ** 2).sum() == pytest.approx(r.error)
