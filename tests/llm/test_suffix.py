import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import suffix


def brute(rows, length=100):
    seen, out = set(), {}
    for doc, text in sorted(rows, key=lambda r: r[0]):
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - length + 1):
            w = raw[i : i + length]
            if w in seen:
                gone[i : i + length] = True
            seen.add(w)
        edge = np.diff(np.concatenate([[0], gone.astype(int), [0]]))
        out[doc] = (len(raw), int(gone.sum()), int((edge == 1).sum()), hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest())
    return out


def test_matches_brute_force(docs, corpus):
    got = {r.doc_id: tuple(r)[1:] for r in suffix.repeats_removed(docs).collect()}
    want = brute([(r[0] if r[0] is not None else 10**9, r[1]) for r in corpus])
    want[None] = want.pop(10**9)
    assert got == want


def test_random_repeats(spark):
    rng = random.Random(3)
    passages = ["".join(rng.choice("abc ") for _ in range(rng.choice([90, 100, 130, 400]))) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = [rng.choice(passages)[rng.randrange(20) :] if rng.random() < 0.5 else "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(80))) for _ in range(5)]
        rows.append((i, "".join(parts)))
    rows += [(70, "xy" * 300), (71, "xy" * 200), (72, "z" * 500)]
    got = {r.doc_id: tuple(r)[1:] for r in suffix.repeats_removed(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_crowded_anchors_and_long_texts_by_another_way(spark, docs, corpus, monkeypatch):
    want = {r.doc_id: tuple(r) for r in suffix.repeats_removed(docs).collect()}
    monkeypatch.setattr(suffix, "CROWD", 3)
    monkeypatch.setattr(suffix, "PIECE", 700)
    assert {r.doc_id: tuple(r) for r in suffix.repeats_removed(docs).collect()} == want


def test_repeated_rows_are_one_document(spark):
    t = "some words that are long enough to be taken for a passage by themselves, if anyone repeats them " * 2
    rows = [(1, t), (1, t), (2, t), (2, "other"), (None, t)]
    got = sorted((r.doc_id or 9, r.n_bytes, r.n_removed) for r in suffix.repeats_removed(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    own = brute([(1, t)])[1][1]
    assert got == sorted([(1, len(t), own), (1, len(t), own), (2, len(t), len(t)), (2, 5, 0), (9, len(t), len(t))])


def test_cut_keeps_columns_and_characters(clash):
    out = suffix.cut(clash)
    assert out.columns == clash.columns and out.count() == clash.count()
    assert all("�" not in (r.text or "") for r in out.collect())
    assert suffix.cut(clash.limit(0)).count() == 0


def test_maximal_repeats_give_all_occurrences():
    a, b = "the quick brown fox ", "jumps over the lazy dog "
    texts = [(a + b + "1").encode(), (b + a + b + "2").encode(), ("3" + a).encode()]
    counts = np.array([len(t) - 14 for t in texts])
    got = {texts[w[0][0]][w[0][1] : w[0][1] + n]: sorted(w) for n, w, _ in suffix.maximal_repeats(texts, np.array([0, 1000, 2000]), counts, 15)}
    assert got == brute_repeats(texts, 15) and len(got[a.encode()]) == 3
    assert got[(a + b).encode()] == [(0, 0), (1, len(b))] and len(got[b.encode()]) == 3


def brute_repeats(texts, length):
    """Every maximal repeat with all its occurrences, by trying all substrings."""
    at = {}
    for t, text in enumerate(texts):
        for i in range(len(text)):
            for j in range(i + length, len(text) + 1):
                at.setdefault(text[i:j], []).append((t, i))
    edge = lambda t, i: texts[t][i] if 0 <= i < len(texts[t]) else (t, i)
    return {s: sorted(w) for s, w in at.items() if len({edge(t, i - 1) for t, i in w}) > 1 and len({edge(t, i + len(s)) for t, i in w}) > 1}


def test_all_maximal_repeats_of_random_texts():
    rng = random.Random(8)
    for _ in range(20):
        phrase = ["".join(rng.choice("ab") for _ in range(rng.randint(5, 14))) for _ in range(3)]
        texts = ["".join(rng.choice(phrase) + rng.choice("ab.") for _ in range(rng.randint(1, 4))).encode() for _ in range(5)]
        counts = np.array([max(0, len(t) - 7) for t in texts])
        got = {texts[w[0][0]][w[0][1] : w[0][1] + n]: sorted(w) for n, w, _ in suffix.maximal_repeats(texts, np.arange(5) * 1000, counts, 8)}
        assert got == brute_repeats(texts, 8)


def test_groups_hold_all_occurrences(spark, corpus):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9)))
    phrase = " ".join(word() for _ in range(40))
    rows = [(i, f"{' '.join(word() for _ in range(12))} {phrase[: 110 + 5 * i]} {' '.join(word() for _ in range(9))}") for i in range(12)]
    rows += [(20 + i, rows[i][1]) for i in range(3)] + [(40, None), (41, "short")]
    got = suffix.repeat_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    text = {i: (t or "").encode() for i, t in rows}
    by, seen = {}, set()
    for r in got:
        by.setdefault(r.group, []).append((r.doc_id, r.start, r.n_bytes))
        seen |= {(r.doc_id, r.start + k) for k in range(r.n_bytes - 99)}
    for w in by.values():
        body = {text[d][s : s + n] for d, s, n in w}
        assert len(body) == 1 and len(w) > 1 and len(body.copy().pop()) >= 100
        body = body.pop()
        assert sorted((d, s) for d, s, _ in w) == sorted((d, s) for d in text for s in range(len(text[d]) - len(body) + 1) if text[d][s : s + len(body)] == body)
    windows = {}
    for d, raw in text.items():
        for s in range(len(raw) - 99):
            windows.setdefault(raw[s : s + 100], []).append((d, s))
    assert seen == {p for w in windows.values() if len(w) > 1 for p in w}  # every repeated window is in some group
    assert suffix.repeat_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_what_a_task_has_sent_is_settled():
    sent = suffix._Sent(most=3)
    i = lambda *x: np.array(x)
    sent.add(i(1, 2), i(10, 20), i(5, 5), i(0, 7))
    assert sent.again(i(1, 1, 2, 2, 3), i(10, 11, 20, 20, 10), i(6, 6, 5, 5, 9), i(0, 0, 6, 8, 0)).tolist() == [True, False, False, True, False]
    sent.add(i(4, 5), i(1, 1), i(0, 0), i(0, 0))
    assert sent.cols[0].tolist() == [1, 4, 5]


@pytest.mark.parametrize("pairs,want", [([], []), ([(5, 9), (1, 5), (20, 30), (8, 10)], [(1, 10), (20, 30)])])
def test_merged(pairs, want):
    assert suffix.merged(pairs) == want


def test_cut_with_any_names(spark):
    text = "a passage of many words that comes again, and is longer than a hundred bytes so that it is found and cut out"
    rows = [(1, text, 5), (2, f"{text} more", 6), (3, None, 7), (2, f"{text} more", 8)]
    names = ("__rid", "__marks", "__text", "__id", "__hash", "rid", "rest", "row", "__spans_of_text")
    df = spark.createDataFrame(rows, "doc_id long, text string, n int").withColumns({c: F.col("n") for c in names})
    out = suffix.cut(df)
    assert out.columns == df.columns
    got = sorted(map(tuple, out.collect()), key=lambda r: r[2])
    assert [r[:2] for r in got[:3]] == [(1, text), (2, " more"), (3, None)] and all(set(r[2:]) == {r[2]} for r in got)
