"""Byte-level BPE in DuckDB: a recursive query contracts token-position rows, an ordered aggregation decodes.

Each partition's process has its own in-memory DuckDB with the merge table. The distinct pieces that the pattern finds
in a slice of texts become rows (word, position, token); each step joins the pairs with the merge table and contracts
every word's leftmost pair of minimum rank, and with it, from left to right, the word's other pairs of that rank: they
are what the next steps would contract, unless the new token is part of a token of lower rank (table ``alone``; then only
the leftmost goes). Steps end when no word has a pair left; rows are replaced by their key, so that a very long word keeps
one row a byte whatever the number of its steps. Decoding reads nothing but ids.

Defined cases: a null text is empty and an empty text has no ids; ids outside the vocabulary raise; repeated rows are
encoded alike; an empty table gives no rows; other columns are ignored whatever their names are. Texts are worked on in
slices of SLICE bytes, and a process remembers at most 2 x MEMO pieces.
"""

from __future__ import annotations

import base64
import hashlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import tidy

SLICE = 2 << 20
MEMO = 600_000
STEP = 40_000  # words that one recursive query contracts

_ENCODE = """
WITH RECURSIVE state(place, word, token, done) USING KEY (place) AS (
  SELECT place, word, token, false FROM fresh
  UNION ALL
  SELECT * FROM (
    WITH pairs AS (
      SELECT s.*, (m.merged::BIGINT << 32) | s.nth AS pick FROM (
        SELECT place, word, token, CASE WHEN lead(word) OVER o = word THEN lead(token) OVER o END AS follows, row_number() OVER o AS nth FROM state WHERE NOT done AND token >= 0
        WINDOW o AS (ORDER BY place)) s
      LEFT JOIN merges m ON m.pair = s.token::BIGINT * 1048576 + s.follows),
    best AS (SELECT b.*, coalesce(r.alone, false) AS alone FROM (SELECT word, min(pick) >> 32 AS best, min(pick) & 4294967295 AS first FROM pairs GROUP BY word) b LEFT JOIN alone r ON r.id = b.best),
    hits AS (SELECT p.place, p.word, p.token, p.nth, b.best, coalesce(p.pick >> 32 = b.best AND (p.nth = b.first OR NOT b.alone), false) AS hit FROM pairs p JOIN best b ON p.word = b.word),
    gaps AS (SELECT *, nth - coalesce(max(CASE WHEN NOT hit THEN nth END) OVER (ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS far FROM hits)
    SELECT place, word, CASE WHEN far % 2 = 0 THEN -1 WHEN hit THEN best::INTEGER ELSE token END, best IS NULL FROM gaps)
)
SELECT list(token ORDER BY place) AS ids FROM state WHERE token >= 0 GROUP BY word ORDER BY word
"""
_DECODE = "SELECT doc, string_agg(piece, '' ORDER BY place) AS text FROM tokens JOIN vocabulary USING (id) GROUP BY doc"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


class Codec:
    """Encoder and decoder of one process."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, memo: int = MEMO):
        self.pattern, self.memo = regex.compile(pattern), memo
        self.known = np.fromiter(ranks.values(), np.int64, len(ranks))
        self.bytes_id = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        rows = [(a * 1048576 + b, rank) for token, rank in ranks.items() for k in range(1, len(token)) if (a := ranks.get(token[:k])) is not None and (b := ranks.get(token[k:])) is not None]
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "300MB"})
        pair, merged = zip(*rows) if rows else ((), ())
        self._table("merges", {"pair": pa.array(pair, pa.int64()), "merged": pa.array(merged, pa.int32())})
        # tokens that begin or end a token of lower rank
        alone = {c for token, rank in ranks.items() for k in range(1, len(token)) for c in (token[:k], token[k:]) if ranks.get(c, -1) > rank}
        self._table("alone", {"id": pa.array(ranks.values(), pa.int32()), "alone": pa.array([t in alone for t in ranks])})
        # bytes as Latin-1 characters, so that any cut of a character can be aggregated as text
        self._table("vocabulary", {"id": pa.array(ranks.values(), pa.int32()), "piece": pa.array([t.decode("latin-1") for t in ranks], pa.string())})
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _table(self, name: str, columns: dict) -> None:
        self.db.register("incoming", pa.table(columns))
        self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM incoming")
        self.db.unregister("incoming")

    def learn(self, words: set[str]) -> None:
        """Puts the packed ids of the words into the memo."""
        fresh = [w for w in words if w not in self.young]
        if len(self.young) + len(fresh) > self.memo:
            self.young, self.old = {}, self.young
            fresh = list(words)
        known = self.old
        rest = []
        for w in fresh:
            if w in known:
                self.young[w] = known[w]
            else:
                rest.append(w)
        for s in range(0, len(rest), STEP):
            some = rest[s : s + STEP]
            raw = [w.encode() for w in some]
            sizes = np.array([len(b) for b in raw])
            token = self.bytes_id[np.frombuffer(b"".join(raw), np.uint8)]
            self.db.register("fresh", pa.table({"word": np.repeat(np.arange(len(raw), dtype=np.int32), sizes), "place": np.arange(len(token), dtype=np.int64), "token": token}))
            ids = self.db.sql(_ENCODE).to_arrow_table().column("ids").combine_chunks()
            self.db.unregister("fresh")
            packed, cut = ids.values.to_numpy().astype("<u4").tobytes(), (4 * ids.offsets.to_numpy()).tolist()
            first = cut[0]
            for k, w in enumerate(some):
                self.young[w] = packed[cut[k] - first : cut[k + 1] - first]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids (little-endian, 32 bits) of each text."""
        pieces = [self.pattern.findall(t) for t in texts]
        self.learn(set().union(*pieces))
        get = self.young.__getitem__
        return [b"".join(map(get, p)) for p in pieces]

    def decode(self, packed: list[bytes]) -> list[bytes]:
        ids = np.frombuffer(b"".join(packed), "<u4")
        sizes = np.array([len(p) // 4 for p in packed], dtype=np.int64)
        out = [b""] * len(packed)
        if len(ids):
            if not np.isin(ids, self.known).all():
                raise ValueError("an id is not in the vocabulary")
            self.db.register("tokens", pa.table({"doc": np.repeat(np.arange(len(packed), dtype=np.int32), sizes), "place": np.arange(len(ids), dtype=np.int32), "id": ids.astype(np.int32)}))
            found = self.db.sql(_DECODE).to_arrow_table()
            self.db.unregister("tokens")
            for doc, text in zip(found.column("doc").to_pylist(), found.column("text").to_pylist()):
                out[doc] = text.encode("latin-1")
        return out


_codecs: dict[int, Codec] = {}


def _codec(shipped, pattern: str, memo: int) -> Codec:
    key = hash((shipped.value, pattern, memo))
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec({base64.b64decode(t): int(r) for t, r in (line.split() for line in shipped.value.splitlines())}, pattern, memo)
    return _codecs[key]


def _slices(values, size, most: int = SLICE):
    begin, total = 0, 0
    for i, v in enumerate(values):
        n = size(v)
        if i > begin and total + n > most:
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(values):
        yield begin, len(values)


_COLUMNS = {
    "ids": ("array<int>", lambda ids, text: np.frombuffer(ids, "<i4")),
    "n_tokens": ("long", lambda ids, text: len(ids) // 4),
    "ids_sha256": ("string", lambda ids, text: hashlib.sha256(ids).hexdigest()),
    "decoded": ("binary", lambda ids, text: text),
    "decoded_sha256": ("string", lambda ids, text: hashlib.sha256(text).hexdigest()),
}


def _ship(df: DataFrame, path: str):
    with open(path, "rb") as file:
        return df.sparkSession.sparkContext.broadcast(file.read())  # one vocabulary, whatever the size of the data


def encode(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN, columns=("ids", "n_tokens"), memo: int = MEMO, slice_bytes: int = SLICE, reuse: bool = True) -> DataFrame:
    """(doc_id, *columns); columns of ids, n_tokens, ids_sha256, decoded and decoded_sha256 (of the ids, decoded).

    ``memo``, ``slice_bytes`` and ``reuse`` (a process keeps its tables for its next task) trade memory for time; results
    are the same.
    """
    shipped = _ship(docs, path or public_tokenizers.path("byte_bpe_50k.tiktoken"))
    kinds = {"array<int>": pa.list_(pa.int32()), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}

    def run(batches):
        codec = _codec(shipped, pattern, memo)
        for batch in batches:
            texts = batch.column(1)
            for a, b in _slices(texts, lambda t: len(t.as_buffer()) if t.is_valid else 0, slice_bytes):
                packed = codec.encode([t or "" for t in texts[a:b].to_pylist()])
                plain = codec.decode(packed) if any(c.startswith("decoded") for c in columns) else [b""] * len(packed)
                made = [pa.array([_COLUMNS[c][1](i, t) for i, t in zip(packed, plain)], kinds[_COLUMNS[c][0]]) for c in columns]
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], *made], names=["doc_id", *columns])
        if not reuse:
            del codec
            _codecs.clear()

    out = ", ".join(["doc_id long", *(f"{c} {_COLUMNS[c][0]}" for c in columns)])
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(run), out)


def decode(encoded: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """(doc_id, decoded binary) of rows with ``ids``; null ids decode to nothing."""
    shipped = _ship(encoded, path or public_tokenizers.path("byte_bpe_50k.tiktoken"))

    def run(batches):
        codec = _codec(shipped, pattern, MEMO)
        for batch in batches:
            ids = batch.column(1)
            for a, b in _slices(ids, lambda t: 4 * len(t.values) if t.is_valid else 0):
                packed = [t.values.to_numpy(zero_copy_only=False).astype("<u4").tobytes() if t.is_valid else b"" for t in ids[a:b]]
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(codec.decode(packed), pa.binary())], names=["doc_id", "decoded"])

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, decoded binary")
