import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import bpe

RANKS = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
REAL = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
CODEC = bpe.Codec(RANKS, public_tokenizers.PATTERN, memo=50)
ODD = ["", "a", "  \n\n x", "<|endoftext|>", "é中文 \U0001f600", "a" * 3000, "ab" * 2000 + " z", "\0\0 x", " " * 700, "don't we'LL I'm", "x" * 257, "y" * 256]


def test_as_the_library_would():
    packed = CODEC.encode(ODD)
    assert [np.frombuffer(p, "<u4").tolist() for p in packed] == [REAL.encode_ordinary(t) for t in ODD]
    assert CODEC.decode(packed) == [t.encode() for t in ODD]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=4))
def test_round_trip(texts):
    packed = CODEC.encode(texts)
    assert [np.frombuffer(p, "<u4").tolist() for p in packed] == [REAL.encode_ordinary(t) for t in texts]
    assert CODEC.decode(packed) == [t.encode() for t in texts]


def test_long_words():
    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(list(letters), n)) for letters, n in (("ab", 1500), ("abcdefghijklmnopqrstuvwxyz", 900), ("etaoin", 1200))] + ["a" * 20_001, "xyx" * 500]
    assert [np.frombuffer(p, "<u4").tolist() for p in CODEC.encode(words)] == [REAL.encode_ordinary(w) for w in words]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text(alphabet="abcxyz", min_size=1, max_size=40), min_size=1, max_size=5))
def test_pairs_of_one_rank_in_one_step(words):
    """A vocabulary in which tokens are parts of others of lower rank, so that one contraction can undo the next."""
    assert [np.frombuffer(p, "<u4").tolist() for p in ODDER.encode(words)] == [contract(w.encode()) for w in words]


ODD_RANKS = {bytes([b]): b for b in range(256)} | {t: 256 + i for i, t in enumerate([b"bc", b"abc", b"xx", b"abca", b"xxx", b"ab", b"xab", b"yy", b"yyyy", b"yyy", b"abab", b"cab", b"ca"])}
ODDER = bpe.Codec(ODD_RANKS, r"[a-z]+", memo=20)


def contract(word):
    parts = [word[i : i + 1] for i in range(len(word))]
    while pairs := [(ODD_RANKS[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ODD_RANKS]:
        i = min(pairs)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ODD_RANKS[p] for p in parts]


def test_unknown_ids_raise():
    with pytest.raises(ValueError):
        CODEC.decode([np.array([60_000], "<u4").tobytes()])


def test_query_columns(clash, corpus):
    got = bpe.encode(clash, columns=("n_tokens", "ids_sha256", "decoded_sha256")).collect()
    want = {r[0]: r[1] or "" for r in corpus}
    assert len(got) == len(corpus) + 1
    for r in got:
        ids = REAL.encode_ordinary(want[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(want[r.doc_id].encode()).hexdigest()


def test_encode_then_decode(docs, corpus):
    back = bpe.decode(bpe.encode(docs, memo=100, slice_bytes=500, reuse=False))
    assert {r.doc_id: bytes(r.decoded).decode() for r in back.collect()} == {r[0]: r[1] or "" for r in corpus}
    assert bpe.encode(docs.limit(0)).count() == 0
