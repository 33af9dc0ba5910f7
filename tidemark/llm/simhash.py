"""SimHash near-duplicates by the generalised pigeonhole principle.

Correlated bits are grouped into partitions, each partition gets its own threshold (unequal, -1 for "not probed") by
dynamic programming on estimated candidate counts, and every pair within the radius meets in some partition.

Keys that very many fingerprints own are cut into blocks of owners, each met by every row that probes the key; a task
holds one block of owners and a piece of its probers at a time.

Defined cases: a null text has no words (fingerprint zero, linked like any other); rows with a null id get a
fingerprint but no component and link nothing; repeated rows share a component, and so do all texts of one id; an empty
table gives no rows; other columns of the input are ignored whatever their names are.
"""

from __future__ import annotations

from functools import reduce
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components, local_forest
from .store import Scratch, partitions, tidy

_LANES = (np.arange(8) * 256).astype(np.int64)
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
SEED = 42
SKETCH = 512  # cells of parities
ROWS = 20  # probe rows of a text that are on disk at a time
ROW_COST = 9000  # a probe row with its sketch, in pairs of a key; some 1,000 pairs are checked at its price, a ninth is near in size
BLOCK = 1 << 16  # owners of a key that one block holds
CROWDED = 4096  # keys of a partition that can be cut into blocks: each has over this share of all fingerprints
SPLIT = 1000  # partners of one text that are compared in one place


def _hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 of the ``width``-word shingles, repeats included (fewer words: the whole sequence); A-Z count as a-z."""
    words = text.lower().split()
    if not words:
        return np.empty(0, "<u8")
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(joined, SEED)], "<u8")
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-1]])
    spans = zip(starts[: len(words) - width + 1].tolist(), (ends[width - 1 :] - 1).tolist())
    return np.array([digest(joined[a:b], SEED) for a, b in spans], dtype="<u8")


def _majority(hashes: np.ndarray) -> int:
    seen = np.bincount((hashes.view(np.uint8).reshape(-1, 8) + _LANES).ravel(), minlength=2048).reshape(8, 256)
    return sum(1 << i for i, n in enumerate((seen @ _BITS).ravel().tolist()) if 2 * n > len(hashes))


def fingerprint(text: bytes, width: int) -> int:
    """Bits set in over half the XXH64 of the ``width``-word shingles, repeats included; A-Z count as a-z."""
    return _majority(_hashes(text, width))


def fingerprints(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, fp, hash): the 64 bits as a signed long, and a hash of the whole text."""

    def run(batches):
        for batch in batches:
            texts = batch.column(1)
            found = np.array([fingerprint((texts[i].as_py() or "").encode(), width) for i in range(len(texts))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64)), batch.column(2)], names=["doc_id", "fp", "hash"])

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.xxhash64(text).alias("hash")).mapInArrow(tidy(run), "doc_id long, fp long, hash long")


def correlated(together: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Bits dealt into ``parts`` groups of near-equal size, each grown by the bit most correlated with it."""
    mean = np.diag(together) / max(n, 1)
    spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-12))
    tie = np.abs((together / max(n, 1) - np.outer(mean, mean)) / np.outer(spread, spread))
    left, groups = set(range(64)), []
    for k in range(parts):
        group: list[int] = []
        for _ in range((64 - sum(map(len, groups))) // (parts - k)):
            rest = sorted(left)
            score = tie[np.ix_(rest, group)].sum(1) if group else tie[np.ix_(rest, rest)].sum(1)
            group.append(rest[int(np.argmax(score))])
            left.discard(group[-1])
        groups.append(sorted(group))
    return groups


def allocate(widths: list[int], crowds: list[int], n: int, radius: int, row_cost: float = 1000.0) -> tuple[float, list[int]]:
    """Cheapest thresholds t_i >= -1 that add up to radius - parts + 1.

    ``crowds`` has the sum of squared value counts of each partition over all fingerprints. A threshold t is taken to
    cost ball(t) probes a fingerprint (``row_cost`` pair checks each) and ball(t) times the partition's crowd in pairs.
    """
    want, parts = radius - len(widths) + 1, len(widths)
    best = {0: (0.0, [])}
    for w, crowd in zip(widths, crowds):
        step: dict[int, tuple[float, list[int]]] = {}
        for total, (cost, chosen) in best.items():
            for t in range(-1, radius + 1):
                ball = sum(comb(w, k) for k in range(t + 1))
                more = cost + ball * (row_cost * n + crowd)
                if total + t not in step or more < step[total + t][0]:
                    step[total + t] = (more, [*chosen, t])
        best = step
    assert want in best, (parts, radius)
    return best[want]


def _part(fps: np.ndarray, bits: list[int]) -> np.ndarray:
    out = np.zeros(len(fps), dtype=np.uint64)
    for k, b in enumerate(bits):
        out |= ((fps >> np.uint64(b)) & np.uint64(1)) << np.uint64(k)
    return out


def _flips(width: int, t: int) -> np.ndarray:
    masks = np.array([0], dtype=np.uint64)
    for _ in range(t):
        masks = np.unique(np.concatenate([masks, (masks[:, None] ^ (np.uint64(1) << np.arange(width, dtype=np.uint64))).ravel()]))
    return masks


def within(a: np.ndarray, ra: np.ndarray, b: np.ndarray, rb: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, as edges of ids, of the pairs of a x b within the radius. Rows of blocks, so memory is bounded."""
    xs, ys = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    step = max(1, (1 << 20) // max(1, len(b)))
    for i in range(0, len(a), step):
        p, q = np.nonzero(np.bitwise_count(a[i : i + step, None] ^ b[None, :]) <= radius)
        x, y = local_forest(ra[i : i + step][p], rb[q])
        xs.append(x)
        ys.append(y)
    return np.concatenate(xs), np.concatenate(ys)


def _near(key: np.ndarray, fp: np.ndarray, rep: np.ndarray, own: np.ndarray, radius: int):
    """Verified links inside runs of equal keys (sorted): short runs by shifts of the whole array, long ones in blocks."""
    cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
    size = np.diff(cut)
    run = np.repeat(np.arange(len(size)), size)
    xs, ys = [], []
    short = 64
    small = size[run] <= short
    for d in range(1, min(short, int(size.max(initial=1)))):
        i = np.flatnonzero((run[d:] == run[:-d]) & small[d:])
        if not len(i):
            break
        ok = (own[i] | own[i + d]) & (np.bitwise_count(fp[i] ^ fp[i + d]) <= radius)
        xs.append(rep[i[ok]])
        ys.append(rep[i[ok] + d])
    for g in np.flatnonzero(size > short):
        s = slice(cut[g], cut[g + 1])
        mine = own[s]
        x, y = within(fp[s][mine], rep[s][mine], fp[s], rep[s], radius)
        xs.append(x)
        ys.append(y)
    return local_forest(np.concatenate(xs), np.concatenate(ys)) if xs else (np.empty(0, np.int64), np.empty(0, np.int64))


def _earlier(key: np.ndarray, fp: np.ndarray, rep: np.ndarray, own: np.ndarray, radius: int):
    """For each row of a run the nearest owner of its key with a smaller id, if within the radius: (id, distance, that id)."""
    by = np.lexsort([rep, ~own, key])  # owners first, by id, so that the first minimum is the smallest id
    key, fp, rep, own = key[by], fp[by], rep[by], own[by]
    cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
    found = []
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
        k = int(own[a:b].sum())
        if b - a < 2 or not k:
            continue
        step = max(1, (1 << 20) // k)
        for i in range(a, b, step):
            j = min(i + step, b)
            apart = np.bitwise_count(fp[i:j, None] ^ fp[None, a : a + k])
            apart[rep[i:j, None] <= rep[None, a : a + k]] = 255
            best = apart.argmin(1)
            near = apart[np.arange(j - i), best]
            ok = np.flatnonzero(near <= radius)
            found.append((rep[i + ok], near[ok].astype(np.int64), rep[a + best[ok]]))
    return [np.concatenate(c) for c in zip(*found)] if found else [np.empty(0, np.int64)] * 3


def plan(spark: SparkSession, fps: DataFrame, radius: int, parts: tuple[int, ...] = (2, 3, 4, 5, 6), row_cost: float = 1000.0) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each probed partition, from counts over all fingerprints."""

    def sums(batches):
        for batch in batches:
            x = batch.column(0).to_numpy().view(np.uint64)
            bits = ((x[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(4097)), pa.array(np.append((bits.T @ bits).ravel(), len(x)).astype(np.int64))], names=["cell", "n"])

    got = {r.cell: r.n for r in fps.select("fp").mapInArrow(sums, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()}
    n = got.get(4096, 0)
    together = np.array([got.get(k, 0) for k in range(4096)], dtype=float).reshape(64, 64)
    choices = {m: correlated(together, n, m) for m in parts if m <= radius + 1}
    flat = [(m, i, bits) for m, groups in choices.items() for i, bits in enumerate(groups)]

    def values(batches):
        for batch in batches:
            x = batch.column(0).to_numpy().view(np.uint64)
            for k, (_, _, bits) in enumerate(flat):
                v, c = np.unique(_part(x, bits), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), k)), pa.array(v.view(np.int64)), pa.array(c)], names=["k", "v", "c"])

    counts = fps.select("fp").mapInArrow(values, "k long, v long, c long").groupBy("k", "v").agg(F.sum("c").alias("c"))
    crowd = {r.k: r.s for r in counts.groupBy("k").agg(F.sum(F.col("c") * F.col("c")).alias("s")).collect()}
    ranked = []
    for m, groups in choices.items():
        at = [crowd.get(k, 0) for k, f in enumerate(flat) if f[0] == m]
        ranked.append((*allocate([len(g) for g in groups], at, n, radius, row_cost), groups))
    _, chosen, groups = min(ranked, key=lambda r: r[0])
    return [(g, t) for g, t in zip(groups, chosen) if t >= 0]


def _crowded(fps: DataFrame, chosen: list[tuple[list[int], int]]) -> dict[int, int]:
    """Blocks of each key with over BLOCK owners, and over 1 / CROWDED of all; at most CROWDED keys a partition."""

    def own(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            for k, (bits, _) in enumerate(chosen):
                yield pa.RecordBatch.from_arrays([pa.array((_part(fp, bits) | np.uint64(k) << np.uint64(58)).view(np.int64))], names=["key"])

    counts = fps.select("fp").mapInArrow(own, "key long").groupBy("key").agg(F.count("*").alias("n"))
    return {r.key: -(-r.n // BLOCK) for r in counts.filter(F.col("n") > max(BLOCK, fps.count() // CROWDED)).collect()}


def _keys(fp: np.ndarray, chosen: list[tuple[list[int], int]], crowds: dict[int, int], asking: np.ndarray | None = None, only: list[int] | None = None):
    """(row, key, whether it owns the key) of everything that rows probe; rows that do not ask only own.

    A key is a partition's number, a block and a value. A row owns its own value in the block that its hash picks, and
    probes all other blocks of it, and all blocks of the values near to it. ``only`` names the partitions, if not all.
    """
    many = np.array(sorted(crowds), dtype=np.int64)
    blocks = np.array([crowds[k] for k in sorted(crowds)], dtype=np.int64)
    every = np.arange(len(fp))
    mix = (fp * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
    for k, (bits, t) in enumerate(chosen):
        if only is not None and k not in only:
            continue
        part = _part(fp, bits)
        for mask in _flips(len(bits), t):
            row = every if asking is None or not mask else every[asking]
            key = (part[row] ^ mask | np.uint64(k) << np.uint64(58)).view(np.int64)
            at = np.searchsorted(many, key)
            n = np.where(np.append(many, 0)[at] == key, np.append(blocks, 1)[at], 1) if len(many) else np.ones(len(row), np.int64)
            home = (mix[row] % n.astype(np.uint64)).astype(np.int64)
            if len(many) and (n > 1).any():
                block = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                row, key, home = np.repeat(row, n), np.repeat(key, n) | block << 32, np.repeat(home, n)
                own = (block == home) & (mask == 0)
                if asking is not None:
                    keep = own | asking[row]
                    row, key, own = row[keep], key[keep], own[keep]
                yield row, key, own
            else:
                yield row, key, np.full(len(row), mask == 0)


def _runs(batches, columns, own: int):
    """Whole runs of equal keys, sorted, as lists of columns; a run too long for one task comes as all its owners (the
    column ``own`` tells them; they come first) with one piece of the others after another."""
    held: list[list[np.ndarray]] = []
    put = lambda parts: [np.concatenate(c) for c in zip(*parts)]
    for batch in batches:
        if not len(batch):
            continue
        cols = columns(batch)
        last = int(np.searchsorted(cols[0], cols[0][-1]))  # the last key may go on in the next batch
        if held and (last or held[-1][0][-1] != cols[0][0]):
            yield put([*held, [c[:last] for c in cols]])
            held = []
        elif last:
            yield [c[:last] for c in cols]
        held.append([c[last:] for c in cols])
        if sum(len(h[0]) for h in held) > 4 * BLOCK + (int(held[0][own].sum()) if len(held) > 1 else 0):
            whole = put(held)
            yield whole
            held = [[c[whole[own]] for c in whole]]
    if held:
        yield put(held)


def _rounds(chosen: list[tuple[list[int], int]], first: bool) -> list[list[int]]:
    """Partitions whose probe rows are on disk at a time: up to ROWS a text, or one; the first one alone, if asked for."""
    rounds: list[list[int]] = []
    taken = 0
    for k, (bits, t) in enumerate(chosen):
        rows = sum(comb(len(bits), i) for i in range(t + 1))
        if not rounds or first and k == 1 or taken + rows > ROWS:
            rounds.append([])
            taken = 0
        rounds[-1].append(k)
        taken += rows
    return rounds


def _met(fps: DataFrame, chosen: list[tuple[list[int], int]], width: int, find, names: list[str]) -> DataFrame:
    """Every fingerprint (fp, rep) under each key it probes; ``find`` sees whole runs of equal keys and gives long columns."""
    crowds = _crowded(fps, chosen)

    def probes(batches):
        for batch in batches:
            fp, rep = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
            for row, key, own in _keys(fp, chosen, crowds):
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[row].view(np.int64)), pa.array(rep[row]), pa.array(own)], names=["key", "fp", "rep", "own"])

    def verify(batches):
        for key, fp, rep, own in _runs(batches, lambda b: [c.to_numpy(zero_copy_only=False) for c in b.columns], 3):
            got = find(key, np.ascontiguousarray(fp).view(np.uint64), rep, own)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in got], names=names)

    met = fps.select("fp", "rep").mapInArrow(probes, "key long, fp long, rep long, own boolean")
    return met.repartition(width, "key").sortWithinPartitions("key", F.desc("own")).mapInArrow(tidy(verify), ", ".join(f"{n} long" for n in names))


def link(fps: DataFrame, radius: int, chosen: list[tuple[list[int], int]], width: int) -> DataFrame:
    """Edges (a, b) that span the links between fingerprints within the radius; fps: (fp, rep), fp distinct."""
    return _met(fps, chosen, width, lambda *run: _near(*run, radius), ["a", "b"])


def _tied(marked: DataFrame, fps: DataFrame) -> DataFrame:
    """Edges between the fingerprints of ids that have several."""
    ids = marked.filter("doc_id is not null")
    several = ids.groupBy("doc_id").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).filter("lo <> hi").select("doc_id")
    both = ids.join(several, "doc_id", "left_semi").join(fps, "fp").select("doc_id", "rep")
    low = both.groupBy("doc_id").agg(F.min("rep").alias("b"))
    return both.join(low, "doc_id").filter("rep <> b").select(F.col("rep").alias("a"), "b")


def simhash_groups(docs: DataFrame, radius: int = 3, width: int = 3) -> DataFrame:
    """(doc_id, fp, component_id): smallest doc_id reachable over links of at most ``radius`` differing bits."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "simhash")
    marked = scratch.keep(fingerprints(docs, width))
    fps = scratch.keep(marked.filter("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")))
    edges = link(fps, radius, plan(spark, fps, radius), partitions(spark))
    found = components(edges.union(_tied(marked, fps)), scratch)
    named = fps.join(found, fps.rep == found.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return marked.join(named, "fp", "left").select("doc_id", "fp", F.expr("if(doc_id is null, null, component_id)").alias("component_id"))


def _bag(text: str | None, width: int) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted."""
    words = (text or "").encode().lower().split()
    shingles = {xxhash.xxh64_intdigest(b" ".join(words[i : i + width])) for i in range(max(1, len(words) - width + 1))} if words else set()
    return np.sort(np.fromiter(shingles, np.uint64, len(shingles)))


def _sets(width: int):
    """(doc_id, bag) of each document."""

    def run(batches):
        for batch in batches:
            bags = [_bag(text.as_py(), width).tobytes() for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bags, pa.binary())], names=["doc_id", "bag"])

    return run


def _marks(width: int):
    """(doc_id, fp, hash, size, sketch) of each text: its fingerprint, how many different shingles it has, and the parity
    of their counts over SKETCH cells."""

    def run(batches):
        for batch in batches:
            found = [[], [], []]
            for text in batch.column(1):
                hashes = _hashes((text.as_py() or "").encode(), width)
                bag = np.unique(hashes)
                odd = np.bincount((bag % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH) & 1
                for column, value in zip(found, (_majority(hashes), len(bag), np.packbits(odd).tobytes())):
                    column.append(value)
            fp = pa.array(np.array(found[0], dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), fp, batch.column(2), pa.array(found[1], pa.int64()), pa.array(found[2], pa.binary())], names=["doc_id", "fp", "hash", "size", "sketch"])

    return run


def _possible(key: np.ndarray, cols: list[np.ndarray], chosen: list[tuple[list[int], int]], radius: int, similarity: float, best: bool):
    """(id, distance, smaller id) of each asking row and owner of its key within the radius that may be alike, where they
    meet first; ``best``: of each row's the nearest, then smallest id, of a key.

    Two bags differ in at least as many shingles as their parities differ in cells, so nothing alike is left out. Rows
    meet in the order of their sizes, so that only those near in size are checked.
    """
    fp, rep, own, ask, size, sketch = cols
    masks = [(np.uint64(sum(1 << b for b in bits)), t) for bits, t in chosen]
    cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
    both = np.flatnonzero(np.logical_or.reduceat(own, cut[:-1]) & np.logical_or.reduceat(ask, cut[:-1]) & (np.diff(cut) > 1))
    found = [(np.empty(0, np.int64),) * 3]
    for g in both.tolist():
        at = np.arange(cut[g], cut[g + 1])
        at = at[np.argsort(size[at], kind="stable")]
        mine, theirs = at[ask[at]], at[own[at]]
        sizes = size[theirs]
        part = int(key[cut[g]].view(np.uint64) >> np.uint64(58))
        for i in range(0, len(mine), 256):
            x = mine[i : i + 256]
            near = theirs[np.searchsorted(sizes, similarity * size[x[0]] - 1e-6) : np.searchsorted(sizes, size[x[-1]] / similarity + 1e-6, "right")]
            mets = []
            for j in range(0, len(near), 2048):
                y = near[j : j + 2048]
                p, q = np.nonzero(np.bitwise_count(fp[x, None] ^ fp[None, y]) <= radius)
                p, q = x[p], y[q]
                ok = (rep[q] < rep[p]) & (np.minimum(size[p], size[q]) >= similarity * np.maximum(size[p], size[q]) - 1e-9)
                for mask, t in masks[:part]:
                    ok &= np.bitwise_count((fp[p] ^ fp[q]) & mask) > t
                p, q = p[ok], q[ok]
                total = size[p] + size[q]
                shared = (total - np.bitwise_count(sketch[p] ^ sketch[q]).sum(1, dtype=np.int64)) / 2
                ok = shared >= similarity * (total - shared) - 1e-9
                p, q = p[ok], q[ok]
                mets.append((rep[p], np.bitwise_count(fp[p] ^ fp[q]).astype(np.int64), rep[q]))
            if not mets:
                continue
            a, apart, b = (np.concatenate(c) for c in zip(*mets))
            if best:
                by = np.lexsort([b, apart, a])
                by = by[np.unique(a[by], return_index=True)[1]]
                a, apart, b = a[by], apart[by], b[by]
            found.append((a, apart, b))
    return [np.concatenate(c) for c in zip(*found)]


def _others(texts: DataFrame, chosen: list[tuple[list[int], int]], radius: int, similarity: float, width: int, crowds: dict[int, int], only: list[int], best: bool = False) -> DataFrame:
    """(doc_id, apart, partner) of every row that asks and every earlier text, or the nearest ones, that may be alike;
    texts: (fp, rep, ask, size, sketch)."""
    names = ["key", "fp", "rep", "own", "ask", "size", "sketch"]

    def probes(batches):
        for batch in batches:
            fp, asking = batch.column(0).to_numpy().view(np.uint64), batch.column(2).to_numpy(zero_copy_only=False)
            for row, key, own in _keys(fp, chosen, crowds, asking, only):
                fp_, rep, ask, size, sketch = batch.take(pa.array(row)).columns
                yield pa.RecordBatch.from_arrays([pa.array(key), fp_, rep, pa.array(own), ask, size, sketch], names=names)

    def columns(batch):
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns[:-1]]
        return [*cols, np.frombuffer(b"".join(batch.columns[-1].to_pylist()), np.uint64).reshape(-1, SKETCH // 64)]

    def verify(batches):
        for cols in _runs(batches, columns, 3):
            got = _possible(cols[0], [np.ascontiguousarray(cols[1]).view(np.uint64), *cols[2:]], chosen, radius, similarity, best)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in got], names=["doc_id", "apart", "partner"])

    met = texts.select("fp", "rep", "ask", "size", "sketch").mapInArrow(probes, "key long, fp long, rep long, own boolean, ask boolean, size long, sketch binary")
    return met.repartition(width, "key").sortWithinPartitions("key", F.desc("own")).mapInArrow(tidy(verify), "doc_id long, apart long, partner long")


def _alike(similarity: float):
    def run(batches):
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep, pa.bool_()))], names=["doc_id"])

    return run


def _verified(texts: DataFrame, pairs: DataFrame, width: int, similarity: float, scratch: Scratch) -> DataFrame:
    """doc_id of the pairs (doc_id, partner) whose texts are alike; a text that is the partner of many is dealt to many places."""
    need = pairs.select("doc_id").union(pairs.select("partner")).distinct()
    bags = scratch.keep(texts.join(need, "doc_id", "left_semi").mapInArrow(tidy(_sets(width)), "doc_id long, bag binary"))
    scratch.release()
    places = pairs.groupBy("partner").agg(F.ceil(F.count("*") / SPLIT).cast("int").alias("places"))
    dealt = pairs.join(places, "partner").select("doc_id", "partner", F.pmod(F.xxhash64("doc_id"), "places").cast("int").alias("place"))
    other = bags.join(places, F.col("doc_id") == F.col("partner")).select("partner", F.col("bag").alias("other"), F.explode(F.sequence(F.lit(0), F.col("places") - 1)).alias("place"))
    return dealt.join(bags, "doc_id").join(other, ["partner", "place"]).select("doc_id", "bag", "other").mapInArrow(_alike(similarity), "doc_id long")


def _asking(texts: DataFrame, ids: DataFrame, ask: bool) -> DataFrame:
    """texts with the column ``ask``: ``ask`` for those with one of the ids in doc_id, else its opposite."""
    named = ids.select(F.col("doc_id").alias("rep"), F.lit(ask).alias("ask")).distinct()
    return texts.join(named, "rep", "left").withColumn("ask", F.coalesce("ask", F.lit(not ask)))


def drop_near_copies(docs: DataFrame, radius: int = 14, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs without near copies of earlier ones; all columns stay.

    A document goes if one of smaller id has an equal text, or a fingerprint within the radius and distinct shingles of a
    Jaccard similarity of at least ``similarity``. Equal texts are settled by their hash, and one of each is compared with
    earlier ones that sizes and parities do not rule out: first with one partner (the nearest of the first partitions
    that have any), then, if that is not alike, with all others within the radius. So no two documents that stay are such
    copies. Rows without an id stay, and so do all rows of an id that stays.
    """
    spark = docs.sparkSession
    scratch, wide = Scratch(spark, "copies"), partitions(spark)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).filter("doc_id is not null")
    marked = scratch.keep(texts.select("doc_id", "text", F.xxhash64("text")).mapInArrow(tidy(_marks(width)), "doc_id long, fp long, hash long, size long, sketch binary"))
    unlike = scratch.keep(marked.groupBy("fp", "hash").agg(F.min("doc_id").alias("rep"), F.first("size").alias("size"), F.first("sketch").alias("sketch")))
    equal = marked.select("doc_id", "fp", "hash").join(unlike.select("fp", "hash", "rep"), ["fp", "hash"]).filter("doc_id <> rep").select("doc_id")
    chosen = plan(spark, unlike, radius, (4, 5, 6, 8, 10, 12, 15), ROW_COST)
    crowds = _crowded(unlike, chosen)
    compared, met = unlike.withColumn("ask", F.lit(True)), []
    for only in _rounds(chosen, True):  # who has met a partner asks no more
        met.append(scratch.keep(_others(compared, chosen, radius, similarity, wide, crowds, only, True)))
        scratch.release()
        found = reduce(DataFrame.union, met)
        compared = _asking(unlike, found, False)
    pairs = scratch.keep(found.groupBy("doc_id").agg(F.min(F.struct("apart", "partner")).alias("best")).select("doc_id", "best.partner"))
    gone = scratch.keep(equal.union(_verified(texts, pairs, width, similarity, scratch)).distinct())
    scratch.release()
    compared = scratch.keep(_asking(unlike, pairs.join(gone, "doc_id", "left_anti"), True))
    rest = []
    for only in _rounds(chosen, False):
        rest.append(scratch.keep(_others(compared, chosen, radius, similarity, wide, crowds, only)))
        scratch.release()
    more = _verified(texts, reduce(DataFrame.union, rest).select("doc_id", "partner"), width, similarity, scratch)
    gone = scratch.keep(gone.union(more).select(F.col("doc_id").alias("__gone")).distinct())
    return docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")
