"""Vector codes by integer codebooks, with nearest entries found through segment-mean lower bounds.

Components become integers, vectors are cut into equal consecutive parts, and each part position has a codebook that starts
as the parts of the first vectors and is refined in rounds. The nearest entry is searched from coarse to fine: of a part and
of every entry the sums over 1, 2, 4, ... blocks and the norm of what the block means leave are known, and

    |x - c|^2  >=  sum over blocks of (Sx - Sc)^2 / length  +  (rx - rc)^2.

The exact distance to the entry of least bound, at each level, bounds the minimum from above; entries whose lower bound lies
above it are left out, level by level, with a margin for rounding. Survivors get exact distances in 64-bit integers, ties go to the
lower index, so that the bounds change the work and never the result.

Sums of parts are kept in each task and added exactly (38 digits) over tasks: one row for each entry and component
leaves a task, whatever the number of vectors.

Defined cases: null vectors and those with null or non-finite components are dropped; a vector of another length than most
(of two lengths equally common the longer counts) or so large that an error might not fit a long keeps its row with a null
code and error, and takes no part in codebooks; parts are of equal length where the length is divisible, else cut evenly;
fewer vectors than entries give that many entries; null ids come last, and of equal ids the smaller vector first; repeated
rows are rows of their own; null labels are one label; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Scratch

SCALE = 256
ROWS = 2048  # vectors worked on at a time


def cuts(length: int, pieces: int) -> np.ndarray:
    return np.array([length * k // pieces for k in range(pieces + 1)])


class Codebook:
    """The entries of one part position, with their block sums and residual norms at every level."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries  # int64, one row an entry
        width, self.levels = entries.shape[1], []
        blocks = 1
        while blocks <= max(1, width // 2):
            self.levels.append((cuts(width, blocks), *_means(entries, cuts(width, blocks))))
            blocks *= 2
        self.square = (entries.astype(np.float64) ** 2).sum(1)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(index of the nearest entry, exact squared distance, exact distances worked out) of each row."""
        if not self.entries.shape[1] or not len(x):
            return np.zeros(len(x), np.int64), np.zeros(len(x), np.int64), 0
        at, sums, rest = self.levels[0]
        mine, own_rest = _means(x, at)
        bound = (mine - sums.T) ** 2 / np.diff(at)[0] + (own_rest[:, None] - rest) ** 2
        slack = 1e-9 * ((x.astype(np.float64) ** 2).sum(1) + self.square.max()) + 0.5
        most = _distance(x, self.entries[bound.argmin(1)]) + slack
        row, entry = np.nonzero(bound <= most[:, None])
        for at, sums, rest in self.levels[1:]:
            mine, own_rest = _means(x, at)
            bound = ((mine[row] - sums[entry]) ** 2 / np.diff(at)).sum(1) + (own_rest[row] - rest[entry]) ** 2
            # the entry of least bound at this level may be nearer than the one before
            first = _first(row)
            best = np.flatnonzero(bound == np.minimum.reduceat(bound, first)[row])
            best = best[_first(row[best])]
            most = np.minimum(most, _distance(x, self.entries[entry[best]]) + slack)
            near = bound <= most[row]
            row, entry = row[near], entry[near]
        exact = _distance(x[row], self.entries[entry])
        first = _first(row)  # every row keeps its nearest entry
        least = np.minimum.reduceat(exact, first)
        index = np.minimum.reduceat(np.where(exact == least[row], entry, len(self.entries)), first)
        return index, least, len(row)


def _first(row: np.ndarray) -> np.ndarray:
    """Where each value begins in a sorted array."""
    return np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))


def _means(x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the blocks, and the norm of what is left without the blocks' means."""
    if not x.shape[1]:
        return np.zeros((len(x), 1)), np.zeros(len(x))
    y = x.astype(np.float64)
    sums = np.add.reduceat(y, at[:-1], axis=1)
    means = np.repeat(sums / np.diff(at), np.diff(at), axis=1)
    return sums, np.sqrt(((y - means) ** 2).sum(1))


def _distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return ((x - y) ** 2).sum(1)


def _matrix(column, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _code(books: list[Codebook], at: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of each part, distances summed over parts)."""
    index, error = np.empty((len(x), len(books)), np.int64), np.zeros(len(x), np.int64)
    for k, book in enumerate(books):
        index[:, k], far, _ = book.nearest(x[:, at[k] : at[k + 1]])
        error += far
    return index, error


def _sums(shipped, width: int, at: np.ndarray):
    """(slot, total, n): one row for each used entry and component of a task; slot numbers them."""

    def run(batches):
        books = [Codebook(b) for b in shipped.value]
        k = len(books[0].entries)
        totals, counts = np.zeros((len(books), k, int(np.diff(at).max())), np.int64), np.zeros((len(books), k), np.int64)
        for batch in batches:
            whole = _matrix(batch.column(0), width)
            for s in range(0, len(whole), ROWS):
                x = whole[s : s + ROWS]
                index, _ = _code(books, at, x)
                for p in range(len(books)):
                    counts[p] += np.bincount(index[:, p], minlength=k)
                    by = np.argsort(index[:, p], kind="stable")
                    first = _first(index[by, p])
                    part = x[by, at[p] : at[p + 1]]
                    if part.shape[1]:
                        totals[p, index[by[first], p], : part.shape[1]] += np.add.reduceat(part, first, axis=0)
        p, e = np.nonzero(counts)
        slot = ((p * k + e)[:, None] * totals.shape[2] + np.arange(totals.shape[2])).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(totals[p, e].ravel()), pa.array(np.repeat(counts[p, e], totals.shape[2]))], names=["slot", "total", "n"])

    return run


def _codes(shipped, width: int, at: np.ndarray):
    def run(batches):
        books = [Codebook(b) for b in shipped.value]
        for batch in batches:
            v = batch.column("v")
            fit = np.flatnonzero(v.is_valid().to_numpy(zero_copy_only=False))
            code, error = np.full(len(v), None, dtype=object), np.zeros(len(v), np.int64)
            for s in range(0, len(fit), ROWS):
                rows = fit[s : s + ROWS]
                index, error[rows] = _code(books, at, _matrix(v.take(pa.array(rows)), width))
                text = index.astype(np.uint8).tobytes().hex()
                code[rows] = [text[2 * i : 2 * (i + len(books))] for i in range(0, len(books) * len(rows), len(books))]
            missing = v.is_null().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(code, pa.string()), pa.array(error, mask=missing)], names=["vec_id", "label", "code", "error"])

    return run


def whole_vectors(vectors: DataFrame, scratch: Scratch) -> tuple[DataFrame, int]:
    """(vec_id, label, v) of the rows that are kept, v as integers or null where it takes no part; and the usual length."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    kept = vectors.filter(F.col("embedding").isNotNull() & F.coalesce(finite, F.lit(False)))
    usual = kept.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    width = usual.d if usual else 0
    most = float(2**30 / max(width, 1) ** 0.5)  # differences of two such components, squared and summed, stay below 2 ** 62
    fit = (F.size("embedding") == width) & F.forall("embedding", lambda x: F.abs(x.cast("double") * SCALE) <= most)
    v = F.when(fit, F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE)))
    return scratch.keep(kept.select(F.col("vec_id").cast("long").alias("vec_id"), "label", v.alias("v"))), width


def fit(rows: DataFrame, width: int, parts: int = 16, entries: int = 64, rounds: int = 2) -> list[np.ndarray]:
    """The codebooks, one array of entries a part position, of ``whole_vectors``."""
    at = cuts(width, parts)
    first = rows.filter("v is not null").select("vec_id", "v").orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).collect()
    start = np.array([r.v for r in first], np.int64).reshape(len(first), width)
    books = [start[:, at[k] : at[k + 1]].copy() for k in range(parts)]
    if not width or not first:
        return books
    wide = int(np.diff(at).max())
    for _ in range(rounds):
        shipped = rows.sparkSession.sparkContext.broadcast(books)  # ``entries`` vectors
        sums = rows.filter("v is not null").select("v").mapInArrow(_sums(shipped, width, at), "slot long, total long, n long")
        # entries x components rows come to the driver
        for r in sums.groupBy("slot").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).collect():
            k, place = divmod(r.slot, wide)
            p, e = divmod(k, len(first))
            if place < books[p].shape[1]:
                books[p][e, place] = int(r.total) // r.n
        shipped.unpersist()
    return books


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(c) for book in books for c in book.ravel()).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2) -> tuple[DataFrame, list[np.ndarray]]:
    """((vec_id, label, code, error) of each kept row, the codebooks); code has two hex digits a part."""
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits: 1 to 256 entries")
    scratch = Scratch(vectors.sparkSession, "segments")
    rows, width = whole_vectors(vectors, scratch)
    books = fit(rows, width, parts, entries, rounds)
    shipped = vectors.sparkSession.sparkContext.broadcast(books)
    out = f"vec_id long, label {rows.schema['label'].dataType.simpleString()}, code string, error long"
    return rows.mapInArrow(_codes(shipped, width, cuts(width, parts)), out), books


def decode(codes: DataFrame, books: list[np.ndarray], column: str = "code") -> DataFrame:
    """The rows with ``decoded``, the vector that the code stands for (null for a null code)."""
    entry = [F.array(*(F.array(*map(F.lit, map(int, e))) if len(e) else F.expr("cast(array() as array<bigint>)") for e in book)) for book in books]
    index = [F.conv(F.substring(column, 2 * k + 1, 2), 16, 10).cast("int") for k in range(len(books))]
    whole = F.concat(*(F.element_at(e, i + 1) for e, i in zip(entry, index))) if len(books[0]) else F.lit(None)
    return codes.withColumn("decoded", F.transform(whole, lambda x: (x + 0.5) / SCALE))


def coded(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256): codes with the errors summed over each label."""
    scratch = Scratch(vectors.sparkSession, "segments-codes")
    codes, books = compress(vectors, parts, entries, rounds)
    codes = scratch.keep(codes)
    # one row a label; joined by Spark's choice, as its files tell its size
    sums = codes.groupBy(F.col("label").alias("own")).agg(F.expr("try_cast(sum(cast(error as decimal(38,0))) as bigint)").alias("label_error"))
    out = codes.join(scratch.keep(sums), F.col("label").eqNullSafe(F.col("own")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


_ROUND = """near{r} AS (SELECT id, p, arg_min(e, struct_pack(far := far, e := e)) AS e, min(far) AS far FROM (
  SELECT c.id, c.p, b.e, (list_sum(list_transform(list_zip(c.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))::BIGINT AS far FROM cut c JOIN book{r} b USING (p)) GROUP BY id, p)"""
_NEXT = """sum{r} AS (SELECT p, e, i, sum(c.x[i])::BIGINT AS s, count(*) AS n FROM near{r} JOIN cut c USING (id, p), range(1, len(c.x) + 1) t(i) GROUP BY p, e, i),
book{q} AS (SELECT p, b.e, coalesce(m.x, b.x) AS x FROM book{r} b LEFT JOIN (SELECT p, e, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS x FROM sum{r} GROUP BY p, e) m USING (p, e))"""
#: DuckDB SQL for the rows of ``coded`` over vectors of one length that 16 divides.
ORACLE = f"""WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS id, vec_id, label, v FROM (
    SELECT vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)),
cut AS MATERIALIZED (SELECT id, p, v[p * len(v) // 16 + 1 : (p + 1) * len(v) // 16] AS x FROM kept, range(16) t(p)),
book0 AS MATERIALIZED (SELECT p, id AS e, x FROM cut WHERE id < 64),
{_ROUND.format(r=0)}, {_NEXT.format(r=0, q=1)}, {_ROUND.format(r=1)}, {_NEXT.format(r=1, q=2)}, {_ROUND.format(r=2)},
coded AS (SELECT id, string_agg(lower(lpad(hex(e), 2, '0')), '' ORDER BY p) AS code, sum(far)::BIGINT AS error FROM near2 GROUP BY id),
named AS (SELECT vec_id, label, code, error FROM coded JOIN kept USING (id)),
books AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS h FROM book2)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256 FROM named, books"""
