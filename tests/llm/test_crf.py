import random
import zlib
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import crf, sample


def brute(score, trans):
    """Marginals of one chain by summing over all label sequences."""
    n = len(score)
    total, good = 0.0, np.zeros(n)
    for code in range(1 << n):
        y = [code >> t & 1 for t in range(n)]
        p = np.exp(sum(s for s, k in zip(score, y) if k) + sum(trans[a, b] for a, b in zip(y, y[1:])))
        total += p
        good += p * np.array(y)
    return good / total


def test_marginals_match_enumeration():
    rng = np.random.default_rng(0)
    counts = np.array([3, 1, 6, 2, 6])
    score, trans = rng.normal(size=counts.sum()), rng.normal(size=(2, 2))
    good, pairs = crf.Chains(counts).marginals(score, trans)
    ends = np.cumsum(counts)
    for e, c in zip(ends, counts):
        assert np.allclose(good[e - c : e], brute(score[e - c : e], trans))
    assert np.allclose(pairs.sum(1), 1)


def test_features_of_neighbours():
    x, counts, size = crf.features(["one line\nTWO $$ LINE!!\n\nfour", ""])
    assert counts.tolist() == [4, 1] and size.tolist() == [8, 13, 0, 4, 0]
    assert x.shape == (5, crf.WIDTH)
    near = len(crf._NEAR)
    assert np.allclose(x[0, crf._OWN + near : crf._OWN + 2 * near], x[1, crf._NEAR])  # what follows
    assert np.allclose(x[1, crf._OWN : crf._OWN + near], x[0, crf._NEAR])  # what comes before
    assert not x[0, crf._OWN : crf._OWN + near].any() and not x[4, crf._OWN : crf._OWN + 2 * near].any()


def test_most_frequent_word_is_counted_alike_at_any_number_of_words():
    for kinds in (5, 12, 13, 40):
        words = [f"w{k}" for k in range(kinds)]
        x, _, _ = crf.features([" ".join(words * 2)])
        assert x[0, 13] == pytest.approx(2 / (2 * kinds))


def sample_of(seed=1, n=60):
    rng = random.Random(seed)
    texts = ["\n".join(" ".join(rng.choice(["GOOD", "bad!!", "word", "x9"][i % 2 :: 2]) for _ in range(rng.randint(1, 8))) for _ in range(rng.randint(1, 6))) for i in range(n)]
    return texts, np.arange(n) % 2


def test_training_and_scoring_agree(monkeypatch):
    seen, aggregate = [], crf.aggregate
    monkeypatch.setattr(crf, "aggregate", lambda *a: seen.append(aggregate(*a)) or seen[-1])
    texts, label = sample_of()
    model = crf.train(*crf.features(texts), label, np.ones(len(texts)))
    assert np.abs(seen[0] - model.raw(texts)).max() < 1e-12


def test_scores_match_enumeration():
    texts, label = sample_of()
    model = crf.train(*crf.features(texts), label, np.ones(len(texts)))
    x, counts, size = crf.features(texts)
    end = 0
    for text, n, got in zip(texts, counts, model.score(texts)):
        rows, weight = slice(end, end + n), size[end : end + n] + 1
        end += n
        line = [sum(w * min(8, max(-8, (v - m) / s)) for w, v, m, s in zip(model.weights, r, model.mean, model.spread)) + model.weights[-1] for r in x[rows].astype(float)]
        mean = min(1 - 1e-4, max(1e-4, float((brute(line, model.trans) * weight).sum() / weight.sum())))
        assert got == pytest.approx(1 / (1 + np.exp(-(model.slope * np.log(mean / (1 - mean)) + model.offset))), abs=1e-9)


def test_sample_of_long_and_repeated_documents(marked):
    docs, labels = marked
    long = docs.withColumn("text", F.when(F.col("doc_id") == 6, F.expr("repeat(concat(text, '\n'), 400)")).otherwise(F.col("text")))
    more = long.union(long).union(long.filter("doc_id = 9").withColumn("text", F.lit("zzz")))
    a, b = crf.fit(long, labels), crf.fit(more, labels)
    assert np.allclose(a.weights, b.weights)


def test_rows_are_bounded_and_texts_are_not(marked):
    docs, labels = marked
    named = labels.filter("doc_id is not null").select(F.col("doc_id").alias("__id"), F.col("quality").alias("__label")).filter("__label is not null").distinct()
    text = {r.doc_id: r.text or "" for r in docs.filter("doc_id is not null").collect()}
    every = sample.labelled_texts(docs, named, 50).collect()
    assert max(sum(r["__label"] == k for r in every) for k in (0, 1)) == 50 and {r["__text"] for r in every} <= set(text.values())
    few = sample.labelled_texts(docs, named, 50, 2000).collect()
    assert few and {r["__text"] for r in few} < {r["__text"] for r in every}
    assert all(0 < sum(len(r["__text"].encode()) for r in few if r["__label"] == k) <= 2000 for k in (0, 1))
    one = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5)  # not held out
    tail = docs.withColumn("text", F.when(F.col("doc_id") == one, F.concat(F.expr("repeat('aa bb cc\n', 2000)"), F.lit("LAST!! LINE##"))).otherwise(F.col("text")))
    plain = docs.withColumn("text", F.when(F.col("doc_id") == one, F.concat(F.expr("repeat('aa bb cc\n', 2000)"), F.lit("last line"))).otherwise(F.col("text")))
    assert not np.allclose(crf.fit(tail, labels).weights, crf.fit(plain, labels).weights, atol=1e-12)  # the last of 2,001 lines is learned from


@pytest.fixture(scope="module")
def marked(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 8)))
    rows, labels = [], []
    for i in range(240):
        bad = i % 4 == 0
        lines = [" ".join(word().upper() + "!!" if bad and rng.random() < 0.8 else word() for _ in range(rng.randint(3, 15))) + "." for _ in range(rng.randint(1, 9))]
        rows.append((i, "\n".join(lines), "en", f"s{i % 3}", 0))
        labels.append((i, 0 if bad else 1, 0))
    rows += [(900, None, None, None, None), (901, "", "en", "s", 0), (902, "x " * 50_000, "en", "s", 0), (None, "a plain line", "en", "s", 0)]
    labels += [(0, 0, 0), (None, 1, 1), (3, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_documents(marked):
    docs, labels = marked
    rows = crf.quality(docs, crf.fit(docs, labels)).collect()
    assert len(rows) == 244
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (r.doc_id is not None and crc32(str(r.doc_id).encode()) % 5 == 0)
    held = [r for r in rows if r.held_out and r.doc_id < 240]
    assert np.mean([(r.predicted == 0) == (r.doc_id % 4 == 0) for r in held]) > 0.95


def test_labels_of_the_held_out_fold_are_not_used(marked):
    docs, labels = marked
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = crf.fit(docs, labels), crf.fit(docs, flipped)
    assert np.allclose(a.weights, b.weights) and a.offset == pytest.approx(b.offset)


def test_only_text_is_read(marked):
    docs, labels = marked
    model = crf.fit(docs, labels)
    other = docs.withColumns({"lang": F.lit("xx"), "source": F.lit("yy"), "score": F.lit(1), "__id": F.lit(2)})
    key = lambda df: sorted((r.doc_id or -1, round(r.score, 12)) for r in crf.quality(df, model).collect())
    assert key(docs) == key(other)
    kept = crf.good_documents(other, model)
    assert kept.columns == other.columns
    assert kept.count() == sum(r.predicted for r in crf.quality(docs, model).collect())


def test_without_labels(marked):
    docs, labels = marked
    assert {r.score for r in crf.quality(docs, crf.fit(docs, labels.limit(0))).collect()} == {0.5}
    one = crf.fit(docs, labels.filter("quality = 1"))
    assert all(r.score > 0.9 for r in crf.quality(docs, one).collect())
    assert crf.quality(docs.limit(0), one).count() == 0
