import numpy as np
import xxhash

from tidemark.llm import simhash
from tidemark.llm.components import components, local_forest
from tidemark.llm.store import Scratch


def slow(text, width):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(corpus):
    for row in corpus:
        assert simhash.fingerprint((row[1] or "").encode(), 3) == slow(row[1], 3)


def check(rows, corpus):
    fp = {r[0]: slow(r[1], 3) for r in corpus if r[0] is not None}
    ids = np.array(sorted(fp))
    f = np.array([fp[i] for i in ids], dtype=np.uint64)
    a, b = np.nonzero(np.bitwise_count(f[:, None] ^ f[None]) <= 3)
    want = dict(zip(*local_forest(ids[a], ids[b])))
    for r in rows:
        if r.doc_id is None:
            assert r.component_id is None
        else:
            assert r.component_id == want.get(r.doc_id, r.doc_id)
            assert int(np.int64(r.fp).view(np.uint64)) == fp[r.doc_id]


def test_groups_match_brute_force(docs, corpus):
    rows = simhash.simhash_groups(docs).collect()
    assert len(rows) == len(corpus)
    check(rows, corpus)


def test_clashing_columns_and_repeats(clash, corpus):
    rows = simhash.simhash_groups(clash).collect()
    assert len(rows) == len(corpus) + 1
    check(rows, corpus)


def shingles(text, width=5):
    words = (text or "").lower().split()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def true_drops(rows, radius=64, width=5, similarity=0.8):
    """Documents with an equal text or enough similarity to any earlier one, all pairs compared; within the radius, if given."""
    rows = sorted((r[0], r[1]) for r in rows if r[0] is not None)
    bags = [shingles(t, width) for _, t in rows]
    fps = [slow(t, width) for _, t in rows] if radius < 64 else [0] * len(rows)
    alike = lambda i, j: rows[i][1] == rows[j][1] or len(bags[i] & bags[j]) >= similarity * len(bags[i] | bags[j]) - 1e-9
    return {rows[i][0] for i in range(len(rows)) if any((fps[i] ^ fps[j]).bit_count() <= radius and alike(i, j) for j in range(i))}


def test_recall_against_all_pairs(spark, corpus):
    import random

    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    texts = [r[1] or "" for r in corpus if r[0] is not None]
    for i in range(80):
        words = [word() for _ in range(rng.choice([30, 80, 200]))]
        for _ in range(4):
            texts.append(" ".join(words))
            words = list(words)
            for k in rng.sample(range(len(words)), rng.randint(0, len(words) // 40 + 1)):
                words[k] = word()
    menu = " ".join([word() for _ in range(5)] * 100)
    for _ in range(10):  # equal fingerprints of different texts, and copies of each
        text = f"{menu} {' '.join(word() for _ in range(120))}"
        texts += [text, text, f"{text} more"]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    kept = {r.doc_id for r in simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    gone, true, near = {i for i, _ in rows} - kept, true_drops(rows), true_drops(rows, radius=14)
    print(f"recall {len(gone & true)} of {len(true)}, within 14 bits {len(near)}")
    assert gone == near and gone <= true
    assert len(gone) >= 0.9 * len(true)


def test_dropped_copies(clash, corpus):
    kept = simhash.drop_near_copies(clash)
    assert kept.columns == clash.columns
    want = true_drops(corpus, radius=14)
    assert len(want) > 10
    rows = [r.doc_id for r in kept.collect()]
    assert set(rows) == {r[0] for r in corpus} - want and len(rows) == len(corpus) + 1 - len(want) - (3 in want)
    assert simhash.drop_near_copies(clash.limit(0)).count() == 0


def test_near_copies_of_long_texts_go_and_others_stay(spark):
    import random

    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows = []
    for i in range(60):
        words = [word() for _ in range(300)]
        rows.append((2 * i, " ".join(words)))
        for k in rng.sample(range(300), 4):
            words[k] = word()
        rows.append((2 * i + 1, " ".join(words)))
    kept = {r.doc_id for r in simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(2 * i in kept for i in range(60))
    assert sum(2 * i + 1 in kept for i in range(60)) <= 3


def test_copies_at_eleven_and_twelve_bits_go(spark):
    import random

    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows = []
    while len(rows) < 12:
        words = [word() for _ in range(60)]
        other = [*words[:30], word(), *words[31:]]
        a, b = " ".join(words), " ".join(other)
        if (slow(a, 5) ^ slow(b, 5)).bit_count() in (11, 12):
            rows += [(len(rows), a), (len(rows) + 1, b)]
    assert all(len(shingles(a) & shingles(b)) >= 0.8 * len(shingles(a) | shingles(b)) for (_, a), (_, b) in zip(rows[::2], rows[1::2]))
    kept = simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == list(range(0, 12, 2))


def test_every_candidate_is_compared(spark):
    import random

    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    menu = [word() for _ in range(5)] * 200
    fresh = lambda: menu + [word() for _ in range(300)]
    rows = []
    for _ in range(6):  # equal fingerprints: another text first, then one, its exact and its near copy
        text = fresh()
        rows += [(len(rows) + i, " ".join(t)) for i, t in enumerate([fresh(), text, text, [*text[:-5], *fresh()[-5:]]])]
    assert len({slow(t, 5) for _, t in rows}) == 1
    # the nearest earlier fingerprint is of another text, the copy's is farther off
    while len(rows) < 36:
        a, b = [word() for _ in range(40)], [word() for _ in range(14)]
        near, copy, last = " ".join([*a[:38], *b]), " ".join([*a, word()]), " ".join([*a])
        f = [slow(t, 5) for t in (near, copy, last)]
        s = [shingles(t) for t in (near, copy, last)]
        if (f[0] ^ f[2]).bit_count() < (f[1] ^ f[2]).bit_count() and len(s[0] & s[2]) < 0.8 * len(s[0] | s[2]) and (f[0] ^ f[1]).bit_count() > 0:
            rows += [(len(rows) + i, t) for i, t in enumerate((near, copy, last))]
    kept = simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [i for i in range(24) if i % 4 < 2] + [i for i in range(24, 36) if i % 3 < 2]


def test_all_texts_of_an_id_share_a_component(spark):
    rows = [(5, "one text of some words"), (9, "one text of some words"), (9, "and quite another thing"), (12, "and quite another thing"), (13, "far away from both")]
    got = sorted((r.doc_id, r.component_id) for r in simhash.simhash_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(5, 5), (9, 5), (9, 5), (12, 5), (13, 13)]


def test_crowded_keys_are_cut_into_blocks(spark, docs, corpus, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 2)
    check(simhash.simhash_groups(docs).collect(), corpus)
    fps = np.arange(200, dtype=np.uint64)  # one value in all but a few bits
    df = spark.createDataFrame([(int(v), int(v)) for v in fps], "fp long, rep long")
    chosen = [(list(range(8, 64)), 0)]
    assert simhash._crowded(df, chosen) == {0: 100}
    got = {r.node: r.component for r in components(simhash.link(df, 1, chosen, 3), Scratch(spark, "t")).collect()}
    assert set(got.values()) == {0} and len(got) == 200
    want = {i for i in range(1, 200) if any(bin(i ^ j).count("1") <= 1 for j in range(i))}
    met = simhash._met(df, chosen, 3, lambda *run: simhash._earlier(*run, 1), ["rep", "apart", "partner"])
    assert {r.rep for r in met.collect()} == want


def test_partners_of_many_are_dealt_to_many_places(spark, clash, monkeypatch):
    want = sorted(r.doc_id or -1 for r in simhash.drop_near_copies(clash).collect())
    monkeypatch.setattr(simhash, "SPLIT", 1)
    monkeypatch.setattr(simhash, "BLOCK", 3)
    assert sorted(r.doc_id or -1 for r in simhash.drop_near_copies(clash).collect()) == want


def test_long_runs_come_in_pieces(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(simhash, "BLOCK", 5)
    key = np.array([1] * 3 + [2] * 90 + [3] * 4 + [4] * 60 + [9])
    own = np.concatenate([[c < min(7, n) for c in range(n)] for n in (3, 90, 4, 60, 1)])
    rows = [pa.RecordBatch.from_arrays([pa.array(key[i : i + 8]), pa.array(np.arange(len(key))[i : i + 8]), pa.array(own[i : i + 8])], names=["k", "i", "own"]) for i in range(0, len(key), 8)]
    met = set()
    for k, i, o in simhash._runs(rows, lambda b: [c.to_numpy(zero_copy_only=False) for c in b.columns], 2):
        assert len(k) <= 60
        for v in np.unique(k):
            met |= {(a, b) for a in i[(k == v) & o].tolist() for b in i[k == v].tolist()}
    assert met == {(a, b) for a in range(len(key)) if own[a] for b in range(len(key)) if key[a] == key[b]}


def test_empty(docs):
    assert simhash.simhash_groups(docs.limit(0)).collect() == []


def test_dynamic_programme():
    cost, chosen = simhash.allocate([16] * 4, [10, 10, 10, 10], 100, 3)
    assert chosen == [0, 0, 0, 0]
    cost, chosen = simhash.allocate([16] * 4, [10, 10, 10, 10**9], 100, 3)
    assert chosen[3] == -1 and sum(chosen) == 0
    assert sum(simhash.allocate([32, 32], [5, 5], 10, 3)[1]) == 2


def test_correlated_bits_share_a_part():
    rng = np.random.default_rng(0)
    bits = rng.integers(0, 2, (500, 64)).astype(float)
    bits[:, 1::2] = bits[:, ::2]
    groups = simhash.correlated(bits.T @ bits, 500, 4)
    assert sorted(b for g in groups for b in g) == list(range(64))
    assert all(sum(b ^ 1 in g for b in g) >= len(g) - 2 for g in groups)


def test_unequal_partitions_lose_nothing(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    near = base.copy()
    for _ in range(3):
        near ^= np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)
    fps = np.unique(np.concatenate([base, near]))
    df = spark.createDataFrame([(int(v.view(np.int64)), i) for i, v in enumerate(fps)], "fp long, rep long")
    for plan in ([(list(range(32)), 1), (list(range(32, 64)), 1)], [(list(range(0, 64, 2)), 2), (list(range(1, 64, 2)), 0)]):
        got = {r.node: r.component for r in components(simhash.link(df, 3, plan, 3), Scratch(spark, "t")).collect()}
        a, b = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None]) <= 3)
        want = dict(zip(*local_forest(a, b)))
        assert {k: v for k, v in got.items() if k != v} == want


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(200)] + [(500, 600 + i) for i in range(50)] + [(7, 7)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(7)
    got = {r.node: r.component for r in components(df, Scratch(spark, "t")).collect()}
    assert all(got[i] == 0 for i in range(201)) and all(got[600 + i] == 500 for i in range(50))
    assert components(df.limit(0), Scratch(spark, "t")).collect() == []


def test_scratch_tables_can_be_deleted(spark, docs):
    import os

    from tidemark.llm import store

    rows = simhash.simhash_groups(docs).count()
    roots = [r.removeprefix("file:").replace("//", "/") for r in store._roots]
    assert rows and any(map(os.path.exists, roots))
    store.clean(spark)
    assert not any(map(os.path.exists, roots)) and not store._roots


def test_a_group_of_near_copies_gives_one_row_a_text_and_key():
    n = 300
    key, fp, rep = np.zeros(n, np.int64), np.arange(n, dtype=np.uint64), np.arange(n)
    cols = [fp, rep, np.ones(n, bool), np.ones(n, bool), np.full(n, 50), np.zeros((n, simhash.SKETCH // 64), np.uint64)]
    chosen = [(list(range(16, 64)), 0)]
    a, apart, b = simhash._possible(key, cols, chosen, 14, 0.8, True)
    assert a.tolist() == list(range(1, n)) and (b < a).all()
    assert all(d == min((i ^ j).bit_count() for j in range(i)) for i, d in zip(a.tolist(), apart.tolist()))
    assert len(simhash._possible(key, cols, chosen, 14, 0.8, False)[0]) == n * (n - 1) // 2
    assert simhash._rounds([(list(range(4)), 0)] * 15, True) == [[0], list(range(1, 15))]
