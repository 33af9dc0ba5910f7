"""The pipeline stage by stage against plain Python on a small corpus."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline as cp
from tests.llm.test_simhash import true_drops
from tests.llm.test_suffix import brute
from tidemark.llm import bpe


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 8)))
    shared = " ".join(word() for _ in range(60))
    rows, labels = [], []
    for i in range(160):
        bad = i % 5 == 0
        lines = [" ".join((word().upper() + "!!") if bad else word() for _ in range(rng.randint(4, 20))) + "." for _ in range(rng.randint(2, 6))]
        if i % 6 == 1:
            lines.append(shared)
        text = "\n".join(lines)
        if i % 17 == 3:
            text = rows[-1][1] if (i - 1) % 5 else text
        rows.append((i, text, "en", f"s{i % 4}", len(text)))
        labels.append((i, 0 if bad else 1, 0))
    at = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return f"{at}"


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, {}
    for k, (name, stage) in enumerate(cp.STAGES):
        before = {r.doc_id: r for r in docs.collect()} if k < 4 else docs.collect()
        out = stage(spark, docs, folder)
        out.write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        seen[name] = before, docs.collect()
        if k < 4:
            assert docs.columns == columns
    before, after = seen["quality"]
    assert np.mean([(i % 5 != 0) == (i in {r.doc_id for r in after}) for i in before]) > 0.97
    assert all(before[r.doc_id] == r for r in after)
    before, after = seen["simhash"]
    gone = true_drops([(i, r.text) for i, r in before.items()], radius=14)
    assert gone and {r.doc_id for r in after} == set(before) - gone
    assert gone == true_drops([(i, r.text) for i, r in before.items()])
    before, after = seen["suffix"]
    want = brute([(i, r.text) for i, r in before.items()])
    assert any(n for _, n, _, _ in want.values())
    for r in after:
        assert hashlib.sha256(r.text.encode()).hexdigest() == want[r.doc_id][3] and r.n_chars == len(r.text)
    before, after = seen["mix"]
    n = Counter(r.doc_id for r in after)
    assert set(n) <= set(before) and max(n.values()) <= 2
    size = lambda rows: sum(len(r.text.split()) for r in rows)
    assert abs(size(after) - 1.5 * size(before.values())) < 0.1 * size(before.values())
    before, after = seen["bpe"]
    real = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    assert Counter(r.doc_id for r in after) == Counter(r.doc_id for r in before)
    text = {r.doc_id: r.text for r in before}
    for r in after:
        assert r.ids == real.encode_ordinary(text[r.doc_id]) and r.n_tokens == len(r.ids)
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()


def test_run_is_the_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for k in range(4):
        docs = cp.STAGES[k][1](spark, docs, folder)
    want = sorted((r.doc_id, r.ids_sha256) for r in cp.STAGES[4][1](spark, docs, folder).collect())
    assert sorted((r.doc_id, r.ids_sha256) for r in cp.run(spark, folder).collect()) == want


def test_no_documents(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert cp.run(spark, str(tmp_path)).collect() == []
