"""Embedding near-duplicates by product quantisation.

A coarse quantiser deals unit vectors to inverted lists; each list keeps its members' residuals as codes of subspace
codewords together with the exact error of the code. A vector probes every list that can hold a vector within the
radius: list c, if its own is h, only if (|x-c|^2 - |x-h|^2) / (2 |c-h|) is at most the radius, the distance to the plane
between the two lists. As this holds for either end of a link, only the end of the smaller list probes. In a list,
table-lookup distances are compared with the radius plus the member's code error (the triangle inequality), so that no
link is lost, and what passes is decided by the exact cosine in double precision.

Links are counted where they are found and only a spanning forest of them is emitted, never the pairs of a group. Equal
vectors are one vector with a count. A crowded list is cut into blocks of members, each probed by everyone. Vectors are
exchanged once, with what they probe. The number of lists grows with the root of the vectors of a label, up to half of
``sample``; tables of over 4 10^9 vectors a label want a larger sample.

The quantisers are fitted on at most ``sample`` vectors; every vector is indexed and searched.

Defined cases: a vector that is null, zero, empty or holds null or non-finite components, or has a null label, links with
nothing; vectors of another length than most are compared with their like in one list; a null id has no links and no
component; rows that repeat an id and its vector count as copies; different vectors of one id are linked like any others
and share a component; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components, local_forest
from .store import Scratch, partitions
from .vectors import kmeans, matrix, nearest, usable

SAMPLE = 8192
BLOCK = 4096  # members that one block of a list holds
CROWDED = 4096  # lists that can be cut into blocks: each has over this share of all vectors


@dataclass
class Quantiser:
    dim: int
    coarse: np.ndarray
    books: list[np.ndarray]  # codewords of each subspace
    cuts: list[int]

    def code(self, residual: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, distance between the residual and what its code says)."""
        codes = np.empty((len(residual), len(self.books)), dtype=np.uint8)
        gone = np.zeros(len(residual))
        for k, book in enumerate(self.books):
            part = residual[:, self.cuts[k] : self.cuts[k + 1]]
            codes[:, k] = nearest(part, book)
            gone += ((part - book[codes[:, k]]) ** 2).sum(1)
        return codes, np.sqrt(gone)

    def tables(self, residual: np.ndarray) -> list[np.ndarray]:
        """For each subspace the squared distances of the residuals' parts to all codewords."""
        out = []
        for k, book in enumerate(self.books):
            part = residual[:, self.cuts[k] : self.cuts[k + 1]]
            out.append(np.maximum((part * part).sum(1)[:, None] - 2 * part @ book.T + (book * book).sum(1), 0))
        return out


def fit(x: np.ndarray, lists: int, subspaces: int = 8, words: int = 256) -> Quantiser:
    coarse = kmeans(x, lists)
    residual = x - coarse[nearest(x, coarse)]
    dim = x.shape[1]
    cuts = [dim * k // min(subspaces, dim) for k in range(min(subspaces, dim) + 1)]
    return Quantiser(dim, coarse, [kmeans(residual[:, a:b], words, 6) for a, b in zip(cuts, cuts[1:])], cuts)


def _homes(quantiser: Quantiser | None, batch):
    """(cell, usual rows, their unit vectors) of a batch: the nearest list, or less than 0 for another length than most."""
    length = np.diff(batch.column("v").offsets.to_numpy())
    cell = -length.astype(np.int32)
    usual = np.flatnonzero(length == (quantiser.dim if quantiser else -1))
    x = np.empty((0, 0))
    if len(usual):
        x = matrix(batch.column("v").take(pa.array(usual)))
        x /= np.linalg.norm(x, axis=1)[:, None]
        cell[usual] = nearest(x, quantiser.coarse)
    return cell, usual, x


def _cells(shipped):
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(_homes(shipped.value, batch)[0])], names=["label", "cell"])

    return run


def _place(shipped, radius: float, crowds: dict[tuple[int, int], int]):
    """Each vector as a member of its list, and as a prober of its list's other blocks and of all blocks of every list
    after its own that it must look into."""

    def run(batches):
        quantiser = shipped.value
        for batch in batches:
            if not len(batch):
                continue
            home, usual, x = _homes(quantiser, batch)
            label, uid = batch.column("label").to_numpy(), batch.column("uid").to_numpy()
            row, cell = [np.arange(len(home))], [home]
            if len(usual):
                mine, centres = home[usual], quantiser.coarse
                far = (centres**2).sum(1) - 2 * x @ centres.T  # squared distance less 1
                gap = far - far[np.arange(len(x)), mine][:, None]
                between = np.sqrt(np.maximum((centres[mine] ** 2).sum(1)[:, None] + (centres**2).sum(1) - 2 * centres[mine] @ centres.T, 0))
                i, c = np.nonzero((gap <= 2 * (radius + 1e-7) * between + 1e-9) & (np.arange(len(centres)) > mine[:, None]))
                row.append(usual[i])
                cell.append(c.astype(np.int32))
            row, cell = np.concatenate(row), np.concatenate(cell)
            n = np.array([crowds.get(k, 1) for k in zip(label[row].tolist(), cell.tolist())]) if crowds else np.ones(len(row), np.int64)
            block = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32)
            row, cell, n = np.repeat(row, n), np.repeat(cell, n), np.repeat(n, n)
            member = (cell == home[row]) & (block == uid[row] * 0x9E3779B97F4A7C1 % (1 << 31) % n)
            for s in range(0, len(row), 8192):
                some = batch.take(pa.array(row[s : s + 8192]))
                put = [some.column("label"), *(pa.array(c[s : s + 8192]) for c in (cell, block, member)), some.column("uid"), some.column("mult"), pa.array(home[row[s : s + 8192]] == cell[s : s + 8192]), some.column("v")]
                yield pa.RecordBatch.from_arrays(put, names=["label", "cell", "block", "member", "uid", "mult", "home", "v"])

    return run


class _List:
    """The members of one block of one inverted list."""

    def __init__(self, quantiser: Quantiser | None, cell: int):
        self.quantiser, self.cell, self.parts, self.ready = quantiser, cell, [], False

    def add(self, rep, mult, x):
        self.parts.append((rep, mult, x))

    def close(self):
        """Codes the members; gives their ids, counts and vectors."""
        self.rep, self.mult, self.x = (np.concatenate(p) for p in zip(*self.parts)) if self.parts else (np.empty(0, np.int64), np.empty(0, np.int64), None)
        self.ready = True
        if len(self.rep):
            self.unit = self.x / np.linalg.norm(self.x, axis=1)[:, None]
            if self.cell >= 0:
                self.codes, self.error = self.quantiser.code(self.unit - self.quantiser.coarse[self.cell])
                self.codes = self.codes.astype(np.int64)
        return self.rep, self.mult, self.x

    def search(self, rep, mult, x, both: np.ndarray, cosine: float, radius: float):
        """(vector, linked rows) and a spanning forest of the links; where ``both`` holds, members count the prober too."""
        found = []
        if len(self.rep):
            unit = x / np.linalg.norm(x, axis=1)[:, None]
            for s in range(0, len(rep), 256):
                q = unit[s : s + 256]
                if self.cell >= 0:
                    near = np.zeros((len(q), len(self.rep)))
                    for k, table in enumerate(self.quantiser.tables(q - self.quantiser.coarse[self.cell])):
                        near += np.take(table, self.codes[:, k], axis=1)
                    i, j = np.nonzero(near <= (radius + 1e-6 + self.error) ** 2)
                else:
                    i, j = (a.ravel() for a in np.indices((len(q), len(self.rep))))
                keep = rep[s + i] != self.rep[j]
                i, j = i[keep], j[keep]
                for t in range(0, len(i), 65536):
                    a, b = i[t : t + 65536], j[t : t + 65536]
                    xs, ys = x[s + a], self.x[b]
                    exact = (xs * ys).sum(1) / (np.sqrt((xs * xs).sum(1)) * np.sqrt((ys * ys).sum(1)))
                    ok = exact >= cosine
                    found.append((s + a[ok], b[ok]))
        if not found:
            return (np.empty(0, np.int64),) * 4
        i, j = (np.concatenate(p) for p in zip(*found))
        n = np.bincount(i, weights=self.mult[j], minlength=len(rep)).astype(np.int64)
        again = both[i]
        m = np.bincount(j[again], weights=mult[i[again]], minlength=len(self.rep)).astype(np.int64)
        who, whom = np.flatnonzero(n), np.flatnonzero(m)
        return np.concatenate([rep[who], self.rep[whom]]), np.concatenate([n[who], m[whom]]), *local_forest(rep[i], self.rep[j])


def _search(shipped, cosine: float, radius: float):
    """Rows sorted by block, members first: members meet one another, then each batch of probers meets them."""

    def rows(who, n, low, high):
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([who, low])), pa.array(np.concatenate([n, np.zeros(len(low), np.int64)])), pa.array(np.concatenate([who, high]))], names=["a", "n", "b"])

    def inner(block):
        rep, mult, x = block.close()
        return rows(*block.search(rep, mult, x, np.zeros(len(rep), bool), cosine, radius))

    def run(batches):
        key, block = None, None
        for batch in batches:
            label, cell, part = (batch.column(c).to_numpy() for c in ("label", "cell", "block"))
            member, home = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("member", "home"))
            cut = np.flatnonzero(np.concatenate([[True], (label[1:] != label[:-1]) | (cell[1:] != cell[:-1]) | (part[1:] != part[:-1]) | (member[1:] != member[:-1])]))
            for a, b in zip(cut, [*cut[1:], len(label)]):
                if key != (label[a], cell[a], part[a]):
                    if block and not block.ready:
                        yield inner(block)
                    key = (label[a], cell[a], part[a])
                    block = _List(shipped.value, int(cell[a]))
                some = batch.slice(a, b - a)
                rep, mult, x = some.column("uid").to_numpy(), some.column("mult").to_numpy(), matrix(some.column("v"))
                if member[a]:
                    block.add(rep, mult, x)
                    continue
                if not block.ready:
                    yield inner(block)
                # a member of another block of this list probes this one as well as the other way round
                yield rows(*block.search(rep, mult, x, ~home[a:b], cosine, radius))
        if block and not block.ready:
            yield inner(block)

    return run


def _tied(marked: DataFrame, unique: DataFrame, same: list[str]) -> DataFrame:
    """Edges between the vectors of ids that have several."""
    ids = marked.filter("h1 is not null")
    several = ids.groupBy("vec_id").agg(F.min(F.struct(*same)).alias("lo"), F.max(F.struct(*same)).alias("hi")).filter("lo <> hi").select("vec_id")
    both = ids.join(several, "vec_id", "left_semi").join(unique.select(*same, "uid"), same).select("vec_id", "uid")
    low = both.groupBy("vec_id").agg(F.min("uid").alias("b"))
    return both.join(low, "vec_id").filter("uid <> b").select(F.col("uid").alias("a"), "b")


def near_copies(vectors: DataFrame, cosine: float = 0.98, sample: int = SAMPLE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row; links need equal labels and a cosine of at least ``cosine``."""
    spark = vectors.sparkSession
    scratch, wide = Scratch(spark, "pq"), partitions(spark)
    radius = float(np.sqrt(max(0.0, 2 - 2 * cosine)))
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").alias("v"))
    fit_for = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable("v")
    base = base.withColumn("h1", F.when(fit_for, F.xxhash64("v"))).withColumn("h2", F.when(fit_for, F.xxhash64(F.lit(1), "v")))
    same = ["label", "h1", "h2"]
    marked = scratch.keep(base.select("vec_id", *same))
    unique = base.filter("h1 is not null").groupBy(*same).agg(F.min("vec_id").alias("rep"), F.count("*").alias("mult"), F.any_value("v").alias("v"))
    unique = scratch.keep(unique.withColumn("uid", F.monotonically_increasing_id()))  # the node of a distinct vector
    n, alike = unique.groupBy("label").count().agg(F.sum("count"), F.sum(F.pow(F.col("count").cast("double"), 2)) / F.sum("count")).first()
    lengths = unique.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    quantiser = None
    if lengths:
        rows = unique.filter(F.size("v") == lengths.d).orderBy(F.xxhash64("rep"), "rep", "h1").select("v").limit(sample).toArrow()
        x = matrix(rows.column("v").combine_chunks())
        quantiser = fit(x / np.linalg.norm(x, axis=1)[:, None], max(1, min(len(x) // 2, round(alike**0.5 / 16))))
    shipped = spark.sparkContext.broadcast(quantiser)  # codebooks, bounded by the sample
    sizes = unique.select("label", "v").mapInArrow(_cells(shipped), "label long, cell int").groupBy("label", "cell").count()
    crowds = {(r.label, r.cell): -(-r["count"] // BLOCK) for r in sizes.filter(F.col("count") > max(BLOCK, (n or 0) // CROWDED)).collect()}
    out = f"label long, cell int, block int, member boolean, uid long, mult long, home boolean, v {base.schema['v'].dataType.simpleString()}"
    placed = unique.select("label", "uid", "mult", "v").mapInArrow(_place(shipped, radius, crowds), out)
    dealt = placed.repartition(wide, "label", "cell", "block").sortWithinPartitions("label", "cell", "block", F.desc("member"))
    found = scratch.keep(dealt.mapInArrow(_search(shipped, cosine, radius), "a long, n long, b long"))
    links = found.filter("n > 0").groupBy(F.col("a").alias("link_uid")).agg(F.sum("n").alias("links"))
    groups = components(found.filter("n = 0").select("a", "b").union(_tied(marked, unique, same)), scratch)
    named = unique.select(*same, "uid", "rep", "mult").join(links, F.col("uid") == F.col("link_uid"), "left").join(groups, F.col("uid") == F.col("node"), "left")
    named = named.select(*(F.col(c).alias(f"u_{c}") for c in same), "rep", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("links"), F.coalesce("component", "uid").alias("group"))
    first = named.groupBy(F.col("group").alias("g")).agg(F.min("rep").alias("component"))
    named = named.join(first, F.col("group") == F.col("g"))
    out = marked.join(named, [F.col(c) == F.col(f"u_{c}") for c in same], "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("vec_id").isNotNull(), component).alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
