"""Nearest neighbours by multi-index hashing over learned binary codes.

Vectors become 64-bit codes: centred, turned onto their principal axes, then by an iteratively learned rotation that
brings them near the corners of a cube, and cut by sign. A code is split into eight substrings, each with an index of its
own. If two codes differ in at most r bits, then in some substring j they differ in at most t_j, where the t_j add up to
r - 7; so probing each index at its own t_j retrieves every code within r. What is retrieved is checked against r and
reranked by the exact inner product of the original vectors in double precision.

Largest inner products become smallest angles by one more coordinate that lifts every candidate to the largest norm. The
radius is the smallest one that holds ``recall`` of the true neighbours in a sample; it grows for a query that meets fewer
than k codes in it.

Candidates and queries are dealt to blocks; every query block meets every candidate block once, as a stated query set
must, and passes on k rows. Blocks grow with the table (up to LARGEST rows), as each side is sent once a block of the
other. Rotation and radius are learned from at most ``sample`` vectors; every row is indexed. Scores are added up in the
order of components, so that equal vectors have equal scores wherever they lie.

Defined cases: vectors that are null, zero, empty or hold null or non-finite components, or of another length than most,
take no part, nor do null ids; a query is never its own neighbour, nor are rows that repeat its id; of rows that repeat
an id, each counts; ties go to the smaller id; no query or no candidate gives no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import Scratch
from .vectors import matrix, usable

SAMPLE = 8192
BLOCK = 8192
QUERIES = 16384
LARGEST = 65536
SLACK = 1e-9  # of the norms, above any difference between two orders of summing
PARTS = 8


@dataclass
class Hasher:
    centre: np.ndarray
    turn: np.ndarray
    top: float  # largest norm
    radius: int

    def codes(self, x: np.ndarray, lift: bool) -> np.ndarray:
        more = np.sqrt(np.maximum(self.top**2 - (x * x).sum(1), 0)) if lift else np.zeros(len(x))
        full = np.column_stack([x, more])
        full /= np.maximum(np.linalg.norm(full, axis=1), 1e-300)[:, None]
        return np.packbits((full - self.centre) @ self.turn > 0, axis=1).view(np.uint64).ravel()

    def thresholds(self, radius: int) -> list[int]:
        spare = radius - PARTS + 1
        return [spare // PARTS + (j < spare % PARTS) for j in range(PARTS)]


def fit(x: np.ndarray, top: float, k: int, recall: float, seed: int = 3) -> Hasher:
    more = np.sqrt(np.maximum(top**2 - (x * x).sum(1), 0))
    full = np.column_stack([x, more]) / top
    centre = full.mean(0)
    rng = np.random.default_rng(seed)
    _, _, axes = np.linalg.svd(full - centre, full_matrices=False)
    axes = axes[:64].T
    low = (full - centre) @ axes
    if low.shape[1] < 64:
        turn = rng.normal(size=(low.shape[1], 64))
    else:
        turn = np.linalg.qr(rng.normal(size=(64, 64)))[0]
        for _ in range(40):
            u, _, v = np.linalg.svd(np.where(low @ turn > 0, 1.0, -1.0).T @ low)
            turn = v.T @ u.T
    hasher = Hasher(centre, axes @ turn, top, 64)
    queries = x[:512]
    score = queries @ x.T
    score[np.arange(len(queries)), np.arange(len(queries))] = -np.inf
    best = np.argpartition(-score, min(k, len(x) - 1) - 1, axis=1)[:, :k] if len(x) > 1 else np.zeros((len(queries), 1), int)
    mine, theirs = hasher.codes(queries, False), hasher.codes(x, True)
    apart = np.sort(np.bitwise_count(mine[:, None] ^ theirs[best]).ravel())
    hasher.radius = max(PARTS - 1, int(apart[min(len(apart) - 1, int(np.ceil(recall * len(apart))))]))
    return hasher


class Index:
    """One table a substring: for each of its 256 values the candidates within t_j of it, as packed bits."""

    def __init__(self, codes: np.ndarray, limits: list[int]):
        self.size = len(codes)
        self.parts = codes.view(np.uint8).reshape(-1, PARTS)
        self.tables = []
        for j, t in enumerate(limits):
            bits = np.zeros((256, -(-self.size // 8)), dtype=np.uint8)
            by = np.argsort(self.parts[:, j], kind="stable")
            value = self.parts[by, j]
            np.bitwise_or.at(bits, (value, by // 8), (128 >> (by % 8)).astype(np.uint8))
            for _ in range(max(t, 0)):  # one bit further away each time
                wider = bits.copy()
                for b in range(8):
                    wider |= bits[np.arange(256) ^ (1 << b)]
                bits = wider
            self.tables.append(bits if t >= 0 else None)

    def probe(self, code: np.ndarray) -> np.ndarray:
        """Places of the candidates that some substring's table gives for a code."""
        found = np.zeros(self.tables[0].shape[1], dtype=np.uint8)
        for j, value in enumerate(code.view(np.uint8)):
            if self.tables[j] is not None:
                found |= self.tables[j][value]
        return np.flatnonzero(np.unpackbits(found, count=self.size))


def inner(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of the rows of x with q, added up one component after another."""
    total = np.zeros(len(x))
    for d in range(len(q)):
        total += x[:, d] * q[d]
    return total


def _best(x, ids, met, q, k):
    """The k largest of the rows ``met``, ties by id; a fast product only leaves out what cannot be among them."""
    if len(met) > k:
        rough = x[met] @ q
        slack = SLACK * float(np.sqrt(q @ q)) * float(np.sqrt((x[met] ** 2).sum(1).max()))
        met = met[rough >= np.partition(rough, len(met) - k)[len(met) - k] - slack]
    score, ids = inner(x[met], q), ids[met]
    by = np.lexsort([ids, -score])[:k]
    return ids[by], score[by]


def _search(shipped, k: int):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        if not len(queries) or not len(rows):
            return schema.empty_table()
        hasher = shipped.value
        x, ids = matrix(rows.column("v").combine_chunks()), rows.column("vec_id").to_numpy()
        q, who = matrix(queries.column("v").combine_chunks()), queries.column("vec_id").to_numpy()
        codes = hasher.codes(x, True)
        indexes: dict[int, Index] = {}
        out = [[], [], []]
        for code, mine, me in zip(hasher.codes(q, False), q, who.tolist()):
            radius, met = hasher.radius, ids[:0]
            while True:
                if radius not in indexes:
                    indexes[radius] = Index(codes, hasher.thresholds(radius))
                met = indexes[radius].probe(np.array([code]))
                met = met[(np.bitwise_count(codes[met] ^ code) <= radius) & (ids[met] != me)]
                if len(met) >= k or radius >= 64:
                    break
                radius = min(64, radius + 8)
            near, score = _best(x, ids, met, mine, k)
            out[0].append(np.full(len(near), me))
            out[1].append(near)
            out[2].append(score)
        return pa.Table.from_arrays([pa.array(np.concatenate(o)) for o in out], schema=schema)

    return run


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, recall: float = 0.95, sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of ``vectors`` that each of ``queries`` meets; both (vec_id, embedding)."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "mih")
    clean = lambda df: df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).filter(F.col("vec_id").isNotNull() & usable("v"))
    rows, asked = scratch.keep(clean(vectors)), clean(queries)
    length = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    empty = "query_id long, rank int, vec_id long, score double"
    if not length:
        return spark.createDataFrame([], empty)
    rows, asked = rows.filter(F.size("v") == length.d), asked.filter(F.size("v") == length.d)
    n, top = rows.agg(F.count("*"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)))).first()
    got = rows.orderBy(F.xxhash64("vec_id"), "vec_id").select("v").limit(sample).toArrow()
    shipped = spark.sparkContext.broadcast(fit(matrix(got.column("v").combine_chunks()), top, k, recall))
    size = lambda rows, least: max(least, min(LARGEST, rows // 64))
    asks = asked.count()
    wide, tall = -(-n // size(n, BLOCK)), max(1, -(-asks // size(asks, QUERIES)))
    pick = lambda m: F.pmod(F.xxhash64("vec_id"), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    left = asked.withColumn("qb", pick(tall)).select("vec_id", "v", "qb", every(wide).alias("cb"))
    right = rows.withColumn("cb", pick(wide)).select("vec_id", "v", "cb", every(tall).alias("qb"))
    met = left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInArrow(_search(shipped, k), "query_id long, vec_id long, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return met.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
