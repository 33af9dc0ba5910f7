import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import mix


def test_targets():
    got = mix.targets([("b", 100), ("a", 100), (None, 100)])
    assert got == pytest.approx({"a": 200, "b": 2 * 250 / 3, None: 250 / 3})
    assert mix.targets([]) == {} and mix.targets([("a", 0)]) == {"a": 0}
    assert sum(mix.targets([(f"s{i}", 10 * i) for i in range(30)]).values()) == pytest.approx(1.5 * sum(10 * i for i in range(30)))


def test_pivot_keeps_sum_and_expectation():
    rng = np.random.default_rng(0)
    for p, q in ((0.2, 0.3), (0.7, 0.8), (0.5, 0.5), (0.9, 0.1)):
        got = np.array([mix.pivot(p, q, u) for u in rng.random(20000)])
        assert np.allclose(got.sum(1), p + q)
        assert np.abs(got.mean(0) - (p, q)).max() < 0.02
        assert all(min(abs(a), abs(1 - a)) < 1e-9 or min(abs(b), abs(1 - b)) < 1e-9 for a, b in got)


def sizes(corpus):
    return {r[0]: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in corpus}


def test_copies(docs, corpus):
    rows = mix.copies(docs).collect()
    assert len(rows) == len(corpus)
    size, by = sizes(corpus), defaultdict(list)
    for r in rows:
        assert r.size == size[r.doc_id] and 0 <= r.copies <= 2
        by[r.source].append(r)
    want = mix.targets([(s, sum(r.size for r in rs)) for s, rs in by.items()])
    for s, rs in by.items():
        assert all(r.target == pytest.approx(want[s]) and r.source_size == sum(x.size for x in rs) for r in rs)
        n = [r for r in rs if r.size]
        rate = want[s] / rs[0].source_size
        assert abs(sum(r.copies for r in n) - rate * len(n)) < 1 + 1e-6  # the sum of fractions is kept
        assert abs(sum(r.copies * r.size for r in rs) - want[s]) <= 2 * max(r.size for r in rs)


def test_reruns_and_partitions_agree(docs):
    key = lambda df: sorted((r.doc_id or -1, r.size, r.copies) for r in mix.copies(df).collect())
    assert key(docs) == key(docs.repartition(11)) == key(docs.coalesce(1))


def test_many_leftovers_meet_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr(mix, "CELL", 5)
    monkeypatch.setattr(mix, "FAN_IN", 3)
    rows = [(i, "w " * (1 + i % 9), "a" if i % 3 else "b") for i in range(400)]
    got = mix.copies(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    for s in "ab":
        own = [r for r in got if r.source == s]
        assert abs(sum(r.copies for r in own) - own[0].target / own[0].source_size * len(own)) < 1 + 1e-6


def brute_copies(rows, cell, fan_in):
    """The whole tree in one process: rows (source, size, key, doc_id) to their copies."""
    sources = sorted({r[0] for r in rows}, key=lambda s: (s is None, s or ""))
    want = mix.targets([(s, sum(r[1] for r in rows if r[0] == s)) for s in sources])
    widest = max(-(-sum(r[0] == s for r in rows) // cell) for s in sources)
    out = {}
    for s in sources:
        own = [r for r in rows if r[0] == s]
        total, cells = sum(r[1] for r in own), max(1, -(-len(own) // cell))
        rate = want[s] / total if total else 0.0
        nodes = defaultdict(list)
        for r in own:
            out[r] = int(rate) if r[1] else 0
            if r[1] and rate > int(rate):
                band = min(511, max(0, 511 - int(np.floor(np.log2(r[1]) * 8))))
                nodes[0 if cells == 1 else band * cells + r[2] % cells].append(r)
        part = {r: rate - int(rate) for n in nodes.values() for r in n}
        order = {n: sorted(rs, key=lambda r: (-r[1], r[2], r[3])) for n, rs in nodes.items()}
        level, last = 0, widest * 512 - 1 if widest > 1 else 0
        while True:
            left = {}
            for n, rs in order.items():
                held = None
                for r in rs:
                    if held is not None:
                        part[held], part[r] = mix.pivot(part[held], part[r], mix._draw(r[2], level))
                        held = next((x for x in (held, r) if 1e-9 <= part[x] <= 1 - 1e-9), None)
                    elif 1e-9 <= part[r] <= 1 - 1e-9:
                        held = r
                if held is not None:
                    left[n] = held
            if last == 0:
                break
            order = defaultdict(list)
            for n in sorted(left):
                order[n // fan_in].append(left[n])
            level, last = level + 1, last // fan_in
        for r in left.values():
            part[r] = float(mix._draw(r[2], -1) < part[r])
        for r, p in part.items():
            out[r] += int(p > 0.5)
    return out


@pytest.mark.parametrize("cell,fan_in", [(5, 3), (40, 64), (10_000, 256)])
def test_copies_match_brute_force(spark, monkeypatch, cell, fan_in):
    monkeypatch.setattr(mix, "CELL", cell)
    monkeypatch.setattr(mix, "FAN_IN", fan_in)
    rows = [(i, "w " * (1 + (i * 7919) % 97 + (i % 50 == 0) * 900), "a" if i % 3 else ["b", None][i % 2]) for i in range(600)] + [(900, "", "a"), (901, None, "c"), (902, "one", "d")]
    got = mix.copies(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)).collect()
    want = brute_copies([(r.source, r["size"], r.key, r.doc_id) for r in got], cell, fan_in)
    assert {(r.source, r["size"], r.key, r.doc_id): r.copies for r in got} == want


def test_one_text_that_is_most_of_its_source(spark):
    rows = [(i, "w " * 3, "small") for i in range(30)] + [(50, "w " * 50_000, "small"), (60, "w " * 200_000, "large")]
    got = {r.doc_id: r for r in mix.copies(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(0 <= r.copies <= 2 for r in got.values())
    small = [r for r in got.values() if r.source == "small"]
    assert abs(sum(r.copies for r in small) - small[0].target / small[0].source_size * len(small)) < 1 + 1e-6


def test_mixture_keeps_columns(clash):
    out = mix.mixture(clash)
    assert out.columns == clash.columns
    want = mix.copies(clash).agg(F.sum("copies")).first()[0]
    assert out.count() == want
    assert mix.mixture(clash.limit(0)).count() == 0 and mix.copies(clash.limit(0)).count() == 0


def test_mixture_of_many_equal_rows_and_any_names(spark):
    rows = spark.range(100_000).select(F.lit(7).alias("doc_id"), F.lit("one text").alias("text"), F.lit("s").alias("source"), "id")
    rows = rows.union(spark.range(40).select(F.col("id") + 100, F.lit("another text of words"), F.lit("t"), F.col("id")))
    odd = rows.withColumns({c: F.col("id") for c in ("__n", "__nth", "__own", "__key", "__copies", "key", "row", "n", "place", "total", "salt")})
    out = mix.mixture(odd)
    assert out.columns == odd.columns and out.filter("__n <> id or row <> id or n <> id or salt <> id").count() == 0
    want = {r.source: r.n for r in mix.copies(odd).groupBy("source").agg(F.sum("copies").alias("n")).collect()}
    assert {r.source: r["count"] for r in out.groupBy("source").count().collect()} == want
    each = out.filter("source = 's'").groupBy("id").count().agg(F.min("count"), F.max("count"), F.count("*")).first()
    assert each[1] - each[0] <= 1 and each[1] <= 2
