import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
import public_tokenizers
import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import packing

REAL = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
REAL.encode_special_tokens = True
IDS = packing.Ids(REAL.to_str(), memo=40)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60) | st.text(alphabet=" \t\n  \x1c'sa1.é", max_size=60), max_size=5))
def test_ids_are_the_library_s(texts):
    got = IDS.encode([t.encode() for t in texts])
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [REAL.encode(t, add_special_tokens=False).ids for t in texts]


def test_odd_texts():
    odd = ["", " ", "a", "  x  y ", "don't we'll", "<|endoftext|> a <|endoftext|>", "a" * 5000, "é中文 \U0001f600", "\0 \0", "x  y", " \x1c a"]
    assert [np.frombuffer(g, "<u4").tolist() for g in IDS.encode([t.encode() for t in odd])] == [REAL.encode(t, add_special_tokens=False).ids for t in odd]


def test_long_texts_come_in_blocks(monkeypatch):
    monkeypatch.setattr(packing, "SLICE", 64)
    monkeypatch.setattr(packing, "_NEXT", 32)
    texts = ["word " * 500, "x" * 300 + " y" * 50, "é ü " * 90, "\n\n a\n" * 60, "short", "", "end. Of, line\nnext " * 40]
    assert len(list(packing._blocks(texts[0].encode()))) > 20
    assert [np.frombuffer(g, "<u4").tolist() for g in IDS.encode([t.encode() for t in texts])] == [REAL.encode(t, add_special_tokens=False).ids for t in texts]


def check(rows, want, length):
    """Every id once, in order, in gapless sequences that are full or of a power of two."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert {k: sorted(r.doc_tokens for r in v if r.start == 0) for k, v in by_doc.items()} == {k: sorted(map(len, v)) for k, v in want.items()}
    for doc, pieces in by_doc.items():
        if len(want[doc]) == 1:
            at = 0
            for r in sorted(pieces, key=lambda r: r.start):
                assert r.start == at and r.ids_crc32 == zlib.crc32(np.array(want[doc][0][at : at + r.length], "<u4").tobytes())
                at += r.length
            assert at == len(want[doc][0])
        else:
            assert sum(r.length for r in pieces) == sum(map(len, want[doc]))
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at == length or at < length and at & (at - 1) == 0
    return by_sequence


@pytest.mark.parametrize("most_open", [2048, 3])
def test_pack(docs, corpus, most_open):
    want = defaultdict(list)
    for doc, text, *_ in corpus:
        want[doc].append(REAL.encode(text or "", add_special_tokens=False).ids + [0])
    more = docs.withColumns({c: F.lit("x") for c in ("start", "length", "offset", "sequence_id", "ids")})
    packed = packing.pack(more, most_open=most_open, ids=True)
    rows = packed.collect()
    sequences = check(rows, want, 1024)
    total = sum(len(t) for v in want.values() for t in v)
    assert len(sequences) <= total / 1024 + 10 * docs.rdd.getNumPartitions()
    for r in packing.sequences(packed, pad=9).collect():
        assert len(r.ids) == 1024 or len(r.ids) == r.n_ids and r.n_ids & (r.n_ids - 1) == 0
        assert r.ids[: r.n_ids] == [i for p in sorted((q for q in rows if q.sequence_id == r.sequence_id), key=lambda q: q.offset) for i in p.ids]
    assert packing.pack(docs.limit(0)).count() == 0


def brute_choice(count, size, length):
    best = None
    for level in range(length - size + 1):
        if level and not count[level]:
            continue
        after = count.copy()
        if level:
            after[level] -= 1
        if level + size < length:
            after[level + size] += 1
        best = min(best or (1e18, 0), (int((after**2).sum()), -level))
    return -best[1]


def test_levels_minimise_the_sum_of_squares():
    rng, levels = random.Random(1), packing.Levels(32)
    for _ in range(600):
        size = rng.choice([3, 5, 8, 13, 20, 31])
        level = levels.choose(size)
        assert level == brute_choice(levels.count, size, 32)
        levels.add(level, -1)
        levels.add(level + size, 1)


def test_few_documents_are_cut_and_few_windows_stay_open():
    rng, done, most = random.Random(2), [], 0
    packer = packing.Packer(64, 40, lambda n, pieces: done.append(pieces))
    sizes = [rng.randint(1, 90) for _ in range(4000)]
    for k, n in enumerate(sizes):
        packer.add(k, bytes(4 * n))
        most = max(most, packer.n_open)
    packer.finish()
    assert most <= 40 and packer.n_open == 0
    assert sum(len(raw) // 4 for p in done for _, _, raw in p) == sum(sizes)
    pieces = sum(map(len, done))
    assert pieces - len(sizes) - sum(n > 64 for n in sizes) < 0.1 * len(sizes)


def test_one_size_that_never_fits():
    done = []
    packer = packing.Packer(64, 16, lambda n, pieces: done.append(pieces))
    for k in range(500):
        packer.add(k, bytes(4 * 40))
    packer.finish()
    fill = [sum(len(raw) // 4 for _, _, raw in p) for p in done]
    assert sum(fill) == 500 * 40 and all(f == 64 or f & (f - 1) == 0 for f in fill) and len(fill) <= 500 * 40 // 64 + 6
