import random
import re
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import collocations as co

UPPER = {65 + i: 97 + i for i in range(26)}


def brute(rows, least, share=80, scale=2_000_000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, 5) for i in range(len(w) - k + 1))
    often = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    gone = {(lang, w[i : i + k]) for (lang, w), a in often.items() for k in range(2, len(w)) for i in range(len(w) - k + 1) if 100 * a >= share * f[lang, w[i : i + k]]}
    out = {}
    for (lang, w), a in often.items():
        if (lang, w) not in gone:
            cuts = [(scale * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w))]
            score, _, left, right = min(cuts)
            out.setdefault(lang, []).append((" ".join(w), a, left, right, n[lang], score))
    return {lang: sorted(v, key=lambda r: (-r[5], -r[1], r[0].encode())) for lang, v in out.items()}


def corpus():
    rng = random.Random(3)
    words = ["a", "b", "ab", "New", "york", "é", "ß", "city", "hall", "x" * 300, " ", "<|endoftext|>", "\0z"]
    rows = []
    for i in range(700):
        t = "".join(rng.choice(words) + rng.choice([" ", "  ", "\t", ", ", ".", "\n", " ", " "]) for _ in range(rng.choice([0, 1, 5, 60])))
        rows.append((rng.choice(["en", "en", "fr", None, ""]), t + rng.choice(["new york city hall", "New  York", "a a a a a", ""])))
    return rows + [("en", None), (None, ""), ("de", "rare words only"), ("en", "new york " * 900), ("fr", " , ".join(["a b a"] * 50))]


def frame(spark, rows):
    return spark.createDataFrame([(i % 7 or None, t, lang) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string").repartition(5)


def compare(got, want, top=10**9):
    by = {}
    for r in got.orderBy("lang", "rank").collect():
        by.setdefault(r.lang, []).append((r.phrase, r.a, r.l, r.r, r.n, r.score))
        assert r["rank"] == len(by[r.lang])
    assert by == {lang: v[:top] for lang, v in want.items() if v}


@pytest.mark.parametrize("settings", [{}, {"automaton": 400}, {"crowded": True}])
def test_against_brute_force(spark, monkeypatch, settings):
    rows = corpus()
    if "automaton" in settings:
        monkeypatch.setattr(co.counts, "__defaults__", (30, settings["automaton"]))
    if "crowded" in settings:  # every counter holds many phrases: all pass, and nothing changes
        monkeypatch.setattr(co, "_phrases", lambda batches, shift, real=co._phrases: ((a, b, c, {n: (at, x & 15, y & 15) for n, (at, x, y) in d.items()}) for a, b, c, d in real(batches, shift)))
    df = frame(spark, rows).withColumns({c: F.lit("x") for c in ("phrase", "n", "rank", "score", "words", "salt")})
    want = brute(rows, 30)
    assert sum(map(len, want.values())) > 15
    compare(co.collocations(df), want)
    if not settings:
        compare(co.collocations(df, top=5), want, 5)
        compare(co.collocations(df, least=3, share=50), brute(rows, 3, 50))


def test_cut_texts_are_counted_once(monkeypatch):
    """Both passes over texts, in this process, with blocks of a few words."""
    rows = [(lang or "und", t or "") for lang, t in corpus()]
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows])], names=["lang", "text"])
    patterns = sorted({b"a", b"b", b"a b", b"new york", b"york new york", b"a a a a", b"city", b"new york city hall"})
    seen = []
    for block in (co.BLOCK, 64):
        monkeypatch.setattr(co, "BLOCK", block)
        found = Counter()
        for out in co._scan(SimpleNamespace(value=patterns), block, True)([batch]):
            for r in out.to_pylist():
                found[r["lang"], r["phrase"]] += r["n"]
        grams = Counter()
        for lang, _, _, each in co._phrases([batch], 12):
            for n, (_, a, b) in each.items():
                grams.update((lang, n, x, y) for x, y in zip(a.tolist(), b.tolist()))
        seen.append((found, grams))
    assert seen[0] == seen[1] and sum(seen[0][0].values()) > 5000 and len(seen[0][1]) > 1000


def test_nothing_is_frequent(spark):
    df = frame(spark, [("en", "a b"), ("en", None)])
    assert co.collocations(df).count() == 0 == co.collocations(df.limit(0)).count()
    with pytest.raises(ValueError):
        co.collocations(df, least=300)


def test_large_counts_are_exact(spark):
    a = 9_000_000_000_000_000_000
    found = spark.createDataFrame([("en", "", a), ("en", "p q", a - 1), ("en", "p", a), ("en", "q", a - 1)], "lang string, phrase string, n long")
    (r,) = co.scored(found).collect()
    assert r.score == 2_000_000 * (a - 1) // (2 * a - 1)


def test_scan_guards_words_and_pieces(spark):
    words = co._words(b"ab a b".translate(co._TABLE)) + co._words(b", b a. b ".translate(co._TABLE))
    text = b" ".join([b"", *words, b""]).decode("latin-1")
    got = Counter(v for _, v in co.automaton([b"a b", b"b", b"b a", b"b b"]).iter(text))
    assert got == {0: 1, 1: 3, 2: 1}


def test_a_long_text_is_cut_with_carried_words(monkeypatch):
    monkeypatch.setattr(co, "BLOCK", 40)
    text = " ".join(f"w{i % 5}" for i in range(200)) + "." + "y" * 300 + " end"
    seen, every = [], []
    for carried, words in co.blocks([text.encode(), b"tail"]):
        assert carried == seen[len(seen) - len(carried) :] and len(carried) <= 3
        seen += words
        every.append(words)
    assert len(every) > 5 and seen == co._words(text.encode().translate(co._TABLE)) + [b"tail"]


def test_counters_stop_at_the_top():
    count = np.full(3, 250, np.uint8)
    count[[0, 2]] = np.minimum(255, count[[0, 2]] + np.array([3, 900]))
    assert count.tolist() == [253, 250, 255]


def test_texts_are_read_as_often_for_many_candidates_as_for_few(spark, monkeypatch):
    """One scan for each 400 bytes of candidates before."""
    df, kept, real = frame(spark, corpus()), [], co.Scratch.keep
    monkeypatch.setattr(co.Scratch, "keep", lambda self, rows: kept.append(rows) or real(self, rows))
    few = {tuple(r) for r in co.counts(df, 3).collect()}
    reads = len(kept)
    many = {tuple(r) for r in co.counts(df, 3, 400).collect()}
    assert few == many and len(few) > 500 and len(kept) == 2 * reads


@pytest.mark.parametrize("block, most, held", [(co.BLOCK, co.PATTERNS, co.HELD), (64, 300, co.HELD), (64, 3000, 3000), (64, 3000, 1)])
def test_chunks_count_all_candidates(monkeypatch, block, most, held):
    """With counters that all are high every phrase is a candidate, in whatever chunks and blocks it stands."""
    monkeypatch.setattr(co, "BLOCK", block)
    monkeypatch.setattr(co, "HELD", held)
    rows = [(lang or "und", t or "") for lang, t in corpus()[-200:]]
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows])], names=["lang", "text"])
    got, want = Counter(), Counter()
    for out in co._chunks(SimpleNamespace(value=[b"\xff" * (1 << 13)] * 4), 16, most)([batch]):
        for r in out.to_pylist():
            got[r["lang"], r["phrase"]] += r["n"]
    for lang, text in rows:
        for w in (p.split() for p in text.encode().translate(co._TABLE).split(co.MARK)):
            want[lang, b""] += len(w)
            want.update((lang, b" ".join(w[i : i + k])) for k in range(1, 5) for i in range(len(w) - k + 1))
    assert {k: v for k, v in got.items() if v} == want


def test_a_long_phrase_is_counted_only_if_its_parts_may_be_frequent():
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * 9), pa.array(["a b c d e"] * 9)], names=["lang", "text"])
    rows = lambda low: sum(out.num_rows for out in co._sketch(16, SimpleNamespace(value=[bytes([low]) * (1 << 13)] * 2))([batch]))
    assert rows(0) == 0 < rows(255)


def test_a_word_has_one_hash_wherever_it_stands(monkeypatch):
    monkeypatch.setattr(co, "LONG", 20)
    words = [b"york", b"x" * 30, b"\0", b"\0\0", "é".encode(), b"x" * 20, b"new"]
    seen = {}
    for raw in (b" ".join(words), b"\xff".join([*words[::-1], *words]), b"   " + b"  \xff ".join(words) + b" "):
        begin, end, piece = co._spans(raw)
        found = [raw[s:e] for s, e in zip(begin, end)]
        assert found == [w for w in co._words(raw) if w != co.MARK] and piece.tolist() == [raw[:s].count(co.MARK) for s in begin]
        for word, h in zip(found, co._hashes(raw, begin, end).tolist()):
            assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(words)
