"""Suffix-array dedup: remove every byte that a repeated ``length``-byte string covers, but for its first occurrence.

A match of ``length`` bytes holds the same minimiser at the same place in both texts, so the windows of a text fall into
runs that share a minimiser (its anchor), and only runs with equal anchors need comparing. Equal runs are settled by
their hash in a sort; of what is left, one run of each kind goes to the enhanced suffix array of its anchors. There a
stack scan of the common-prefix intervals tests each interval for diverse left extensions and gives the maximal repeats
with all their occurrences: ``repeat_groups`` has them as rows, ``spans`` keeps what must go.

Hot runs are pre-aggregated before the exchange: a piece of text sends one run of each kind, a task none that it has sent
before (for the kinds that it met again, as many as it remembers; the exchange settles the rest). An anchor with over CROWD
different runs has its windows met by hash, in an aggregate, as no one task should hold so many.

Defined cases: a null text is empty; texts shorter than ``length`` lose nothing; repeated rows (same id and text) are
one document and none of them precedes another; one id with several texts, or a null id, is ordered by id (null last)
and then by the text's hash; an empty table gives no rows; other columns are kept by ``cut`` and ignored by ``spans``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import Scratch, partitions, tidy

GRAM = 24  # bytes of an anchor
PIECE = 1 << 20  # bytes of text that one call works on
CHUNK = 3 << 20  # bytes of runs that one suffix array holds
CROWD = 60_000  # different runs of one anchor that one suffix array takes
HOT = 1 << 16  # kinds of runs that a task remembers
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]


def _hashes(arr: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes at each place."""
    one = (arr.astype(np.uint64) + _ODD[0]) * _ODD[1]
    two = one[:-1] * _ODD[2] + one[1:]
    four = two[:-2] * _ODD[3] + two[2:]
    eight = four[:-4] * _ODD[4] + four[4:]
    twice = eight[:-8] * _ODD[5] + eight[8:]
    out = twice[:-8] * _ODD[6] + eight[16:]
    out ^= out >> np.uint64(33)
    out *= _ODD[1]
    out ^= out >> np.uint64(29)
    return out


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if size < width else x


def runs(blob: bytes, starts: np.ndarray, sizes: np.ndarray, length: int):
    """(text, lo, windows, anchor, hash) of each run; texts lie in blob one after another."""
    keep = np.flatnonzero(sizes >= length)
    if not len(keep):
        return [np.empty(0, np.int64)] * 5
    arr = np.frombuffer(blob, np.uint8)
    h = _hashes(arr)
    bits = np.uint64(len(arr).bit_length())
    least = _sliding_min((h >> bits << bits) | np.arange(len(h), dtype=np.uint64), length - GRAM + 1)
    count = sizes[keep] - length + 1
    begin = np.cumsum(count) - count
    at = np.arange(count.sum()) + np.repeat(starts[keep] - begin, count)
    place = (least[at] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    cut = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1], [True]]))
    lo, n, place = at[cut[:-1]], np.diff(cut), place[cut[:-1]]
    text = keep[np.searchsorted(begin, cut[:-1], "right") - 1]
    digest = xxhash.xxh3_64_intdigest
    seg = np.array([digest(blob[a:b]) for a, b in zip(lo.tolist(), (lo + n + length - 1).tolist())], dtype=np.uint64).view(np.int64)
    return [text, lo - starts[text], n, h[place].view(np.int64), seg]


def _pieces(rids, texts, length: int):
    """Lists of (rid, offset, bytes) of about PIECE bytes; longer texts come in pieces that overlap by length - 1."""
    found, size = [], 0
    for rid, text in zip(rids, texts):
        raw = (text.as_py() or "").encode()
        for off in range(0, max(1, len(raw) - length + 1), PIECE):
            part = raw[off : off + PIECE + length - 1]
            if found and size + len(part) > PIECE:
                yield found
                found, size = [], 0
            found.append((rid, off, part))
            size += len(part)
    if found:
        yield found


def _settled(anchor, seg, rid, lo):
    """(runs that repeat an earlier run of the same piece, first runs of the kinds that are repeated): a combine before the
    exchange, as no count can change them."""
    by = np.lexsort([lo, rid, seg, anchor])
    out = np.zeros(len(by), dtype=bool)
    same = (anchor[by[1:]] == anchor[by[:-1]]) & (seg[by[1:]] == seg[by[:-1]])
    out[by[1:]] = same
    return out, by[:-1][same & ~out[by[:-1]]]


class _Sent:
    """Kinds of runs that a task has sent and met more than once; later runs of them are settled."""

    def __init__(self, most: int = HOT):
        self.most, self.cols = most, [np.empty(0, np.int64)] * 4  # anchor, seg, rid, lo, sorted by the first two

    def again(self, anchor, seg, rid, lo):
        out = np.zeros(len(anchor), dtype=bool)
        if len(self.cols[0]):
            a, s, r, o = self.cols
            at = np.minimum(np.searchsorted(a, anchor), len(a) - 1)  # an anchor with several kinds shows its first one
            out = (a[at] == anchor) & (s[at] == seg) & ((r[at] < rid) | (r[at] == rid) & (o[at] < lo))
        return out

    def add(self, *cols):
        if len(cols[0]):
            both = [np.concatenate([new, old])[: self.most] for new, old in zip(cols, self.cols)]
            by = np.lexsort([both[3], both[2], both[1], both[0]])
            by = by[np.concatenate([[True], (both[0][by][1:] != both[0][by][:-1]) | (both[1][by][1:] != both[1][by][:-1])])]
            self.cols = [c[by] for c in both]


def _joined(rid, lo, n, length):
    """Runs to remove, as (rid, first byte, windows) of the stretches that they cover together."""
    by = np.lexsort([lo, rid])
    rid, lo, stop = rid[by], lo[by], (lo + n + length - 1)[by]
    if not len(rid):
        return rid, lo, n
    new = np.concatenate([[True], (rid[1:] != rid[:-1]) | (lo[1:] > stop[:-1])])
    at = np.flatnonzero(new)
    return rid[at], lo[at], np.maximum.reduceat(stop, at) - lo[at] - length + 1


def _mark(length: int, settle: bool = True):
    def rows(anchor, seg, rid, lo, n, done):
        cols = [pa.array(anchor), pa.array(seg), pa.array(rid), pa.array(lo.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(np.full(len(rid), done))]
        return pa.RecordBatch.from_arrays(cols, names=["anchor", "seg", "rid", "lo", "n", "done"])

    def run(batches):
        sent = _Sent()
        for batch in batches:
            for part in _pieces(batch.column(0).to_pylist(), batch.column(1), length):
                sizes = np.array([len(x) for _, _, x in part])
                text, lo, n, anchor, seg = runs(b"".join(x for _, _, x in part), np.cumsum(sizes) - sizes, sizes, length)
                if len(text):
                    rid = np.array([r for r, _, _ in part])[text]
                    lo = lo + np.array([o for _, o, _ in part])[text]
                    if not settle:
                        yield rows(anchor, seg, rid, lo, n, False)
                        continue
                    done, first = _settled(anchor, seg, rid, lo)
                    done |= sent.again(anchor, seg, rid, lo)
                    first = first[~done[first]]
                    sent.add(*(x[first] for x in (anchor, seg, rid, lo)))
                    yield rows(*(x[~done] for x in (anchor, seg, rid, lo, n)), False)
                    rid, lo, n = _joined(rid[done], lo[done], n[done], length)
                    # settled rows ride along under keys of their own, so that no key gathers them
                    yield rows(rid * 0x9E3779B97F4A7C1 + lo, lo.astype(np.int64), rid, lo, n, True)

    return run


def maximal_repeats(texts: list[bytes], order: np.ndarray, counts: np.ndarray, length: int):
    """Maximal repeats of at least ``length`` bytes among the suffixes that begin in the first counts[i] bytes of texts[i].

    Yields (repeat's length, all of its occurrences as [(text, start)], those of them that no longer repeat has settled,
    the first of all last); ``order`` ranks the texts' origins: an occurrence is earlier by order[text] + start. The suffix
    array holds the suffixes that share their first ``length`` bytes with another; those are the intervals of that depth
    or more.
    """
    sizes = np.array([len(t) for t in texts])
    starts = np.cumsum(sizes) - sizes
    blob = b"".join(texts)
    arr = np.frombuffer(blob + b"\0" * 80, np.uint8)
    at = np.arange(counts.sum()) + np.repeat(starts - (np.cumsum(counts) - counts), counts)
    # buckets: equal hash of the first bytes; a prefix sum of powers gives every window's hash
    base = 0x9E3779B97F4A7C15
    power = np.full(len(arr), base, dtype=np.uint64)
    power[0] = 1
    power = np.cumprod(power)
    inverse = np.full(len(arr), pow(base, -1, 1 << 64), dtype=np.uint64)
    inverse[0] = 1
    inverse = np.cumprod(inverse)
    table = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)
    total = np.concatenate([[np.uint64(0)], np.cumsum(table[arr] * power)])
    h = (total[at + length] - total[at]) * inverse[at]
    by = np.argsort(h, kind="stable")
    at, h = at[by], h[by]
    same = h[1:] == h[:-1]
    many = np.concatenate([same, [False]]) | np.concatenate([[False], same])
    at, h = at[many], h[many]
    if not len(at):
        return
    text = np.searchsorted(starts, at, "right") - 1
    left = np.where(at > starts[text], arr[np.maximum(at - 1, 0)].astype(np.int64), -1 - at)
    # a bucket whose suffixes all have the same byte before them lies within a longer repeat
    cut = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    diverse = np.maximum.reduceat(left, cut) != np.minimum.reduceat(left, cut)
    use = np.repeat(diverse, np.diff(np.append(cut, len(h))))
    at, h, text, left = at[use], h[use], text[use], left[use]
    if not len(at):
        return
    # the suffix array of what is left: by bucket, then by the bytes that follow up to the text's end
    after = at + length
    room = starts[text] + sizes[text] - after
    words = []
    for k in range(0, int(room.max(initial=0)), 7):
        word = np.zeros(len(at), dtype=np.uint64)
        for j in range(7):
            inside = room > k + j
            word = (word << np.uint64(9)) | np.where(inside, arr[np.minimum(after + k + j, len(arr) - 1)].astype(np.uint64) + np.uint64(1), np.uint64(0))
        words.append(word)
    by = np.lexsort([text, *words[::-1], h])
    at, h, text, left, room, after = (x[by] for x in (at, h, text, left, room, after))
    # common prefixes of neighbours
    lcp = np.zeros(len(at), dtype=np.int64)
    joined = np.flatnonzero((h[1:] == h[:-1])) + 1
    if len(joined):
        width = int(room.max(initial=0))
        for s in range(0, len(joined), 1 << 16):
            i = joined[s : s + (1 << 16)]
            head = np.arange(length)
            ok = np.ones(len(i), dtype=bool)
            for t in range(0, length, 25):
                ok &= (arr[at[i][:, None] + head[t : t + 25]] == arr[at[i - 1][:, None] + head[t : t + 25]]).all(1)
            tail = np.arange(width)
            both = np.minimum(room[i], room[i - 1])
            differ = (arr[np.minimum(after[i][:, None] + tail, len(arr) - 1)] != arr[np.minimum(after[i - 1][:, None] + tail, len(arr) - 1)]) | (tail >= both[:, None])
            follow = np.where(differ.any(1), differ.argmax(1), width) if width else np.zeros(len(i), dtype=np.int64)
            lcp[i] = np.where(ok, length + follow, 0)
    # stack scan of the interval tree; an interval holds those of its occurrences that no inner one has settled
    rank = (order[text] + at - starts[text]).tolist()
    where = list(zip(text.tolist(), (at - starts[text]).tolist()))
    left, depths = left.tolist(), [*lcp[1:].tolist(), 0]
    stack: list[list] = []  # depth, left byte or None if diverse, open occurrences, first place in the suffix array
    for i, depth in enumerate(depths):
        node = [1 << 60, left[i], [i], i]
        while stack and stack[-1][0] > depth:
            top = stack.pop()
            top[2].extend(node[2])
            top[1] = top[1] if top[1] == node[1] else None
            members = sorted(top[2], key=rank.__getitem__, reverse=True)
            if top[1] is None and len(members) > 1:
                yield top[0], where[top[3] : i + 1], [where[j] for j in members]
            node = [top[0], top[1], [members[-1]], top[3]]
        if depth:
            if stack and stack[-1][0] == depth:
                stack[-1][2].extend(node[2])
                stack[-1][1] = stack[-1][1] if stack[-1][1] == node[1] else None
            else:
                stack.append([depth, *node[1:]])


def _scan(length: int):
    """Runs (rid, lo, n, body), sorted by anchor, to the spans of all but the first occurrence of each maximal repeat."""

    def spans(part):
        _, rid, lo, n, body = (np.concatenate([p[k] for p in part]) for k in range(5))
        # origins are ranked by (rid, lo); starts differ by under 2**31, so that rank and offset add up
        _, rank = np.unique(rid, return_inverse=True)
        order = (rank.astype(np.int64) << 31) + lo
        out = [(rid[t], lo[t] + s, lo[t] + s + depth) for depth, _, where in maximal_repeats(body.tolist(), order, n.astype(np.int64), length) for t, s in where[:-1]]
        a, b, c = (np.array(x, dtype=np.int64) for x in zip(*out)) if out else (np.empty(0, np.int64),) * 3
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b.astype(np.int32)), pa.array(c.astype(np.int32))], names=["rid", "start", "stop"])

    return _arrays(spans)


def _groups(length: int):
    """Runs to (group, n_bytes, anchor, seg, at): the occurrences of each maximal repeat, as places in a kind of run."""

    def occurrences(part):
        anchor, _, lo, n, body, seg = (np.concatenate([p[k] for p in part]) for k in range(6))
        out, texts = [], body.tolist()
        for depth, where, _ in maximal_repeats(texts, np.arange(len(texts)) << 31, n.astype(np.int64), length):
            t, s = where[0]
            name = xxhash.xxh3_64_intdigest(texts[t][s : s + depth]) - (1 << 63)
            out += [(name, depth, anchor[t], seg[t], s) for t, s in where]
        cols = zip(*out) if out else [()] * 5
        kinds = (np.int64, np.int32, np.int64, np.int64, np.int32)
        return pa.RecordBatch.from_arrays([pa.array(np.array(c, dtype=k)) for c, k in zip(cols, kinds)], names=["group", "n_bytes", "anchor", "seg", "at"])

    return _arrays(occurrences)


def _arrays(work):
    """Feeds ``work`` whole anchors (rows are sorted by them), about CHUNK bytes of runs at a time."""

    def run(batches):
        part, size, last = [], 0, None
        for batch in batches:
            if not len(batch):
                continue
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            cut = np.flatnonzero(np.concatenate([[cols[0][0] != last], cols[0][1:] != cols[0][:-1]]))
            last = cols[0][-1]
            grown = np.cumsum([len(x) for x in cols[4]])
            begin = 0
            for c in cut:  # only a new anchor may begin a new array
                if size + grown[c - 1] * (c > 0) - (grown[begin - 1] if begin else 0) >= CHUNK:
                    yield work([*part, [x[begin:c] for x in cols]])
                    part, size, begin = [], 0, c
            part.append([x[begin:] for x in cols])
            size += grown[-1] - (grown[begin - 1] if begin else 0)
        if part:
            yield work(part)

    return run


def _bodies(length: int):
    def run(batches):
        for batch in batches:
            for text, rid, marks in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2)):
                raw, found = (text.as_py() or "").encode(), marks.values
                anchor, lo, n, more = (found.field(k).to_numpy() for k in range(4))
                body = [raw[a:b] for a, b in zip(lo.tolist(), (lo + n + length - 1).tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(np.full(len(lo), rid)), pa.array(lo), pa.array(n), pa.array(body, pa.binary()), pa.array(more)], names=["anchor", "rid", "lo", "n", "body", "more"])

    return run


def _windows(length: int):
    def run(batches):
        for batch in batches:
            for rid, lo, n, body in zip(*(batch.column(k).to_pylist() for k in range(1, 5))):
                seen = [xxhash.xxh3_128_digest(body[i : i + length]) for i in range(n)]
                yield pa.RecordBatch.from_arrays([pa.array(seen, pa.binary()), pa.array([rid] * n, pa.int64()), pa.array(range(lo, lo + n), pa.int32())], names=["window", "rid", "start"])

    return run


def spans(docs: DataFrame, scratch: Scratch, length: int = 100) -> DataFrame:
    """(rid, start, stop), byte ranges to remove, of docs with a unique long ``rid`` in their order and ``text``."""
    spark = docs.sparkSession
    wide = partitions(spark)
    marks = docs.select("rid", "text").mapInArrow(tidy(_mark(length)), "anchor long, seg long, rid long, lo int, n int, done boolean")
    kind, family = Window.partitionBy("anchor", "seg"), Window.partitionBy("anchor")
    seen = marks.repartition(wide, "anchor").withColumn("first", F.min(F.struct("rid", "lo")).over(kind))
    seen = seen.withColumn("isfirst", ~F.col("done") & (F.struct("rid", "lo") == F.col("first"))).withColumn("crowd", F.sum(F.col("isfirst").cast("int")).over(family))
    seen = scratch.keep(seen.filter("not isfirst or crowd > 1").select("anchor", "rid", "lo", "n", "isfirst", F.col("crowd").cast("int")))
    scratch.release()
    equal = seen.filter("not isfirst").select("rid", F.col("lo").alias("start"), (F.col("lo") + F.col("n") + (length - 1)).cast("int").alias("stop"))
    wanted = seen.filter("isfirst and crowd > 1").distinct().groupBy("rid").agg(F.collect_list(F.struct("anchor", "lo", "n", "crowd")).alias("marks"))
    bodies = docs.select("rid", "text").join(wanted, "rid").select("text", "rid", "marks").mapInArrow(tidy(_bodies(length)), "anchor long, rid long, lo int, n int, body binary, more int")
    bodies = scratch.keep(bodies)
    scratch.release()
    some = bodies.filter(F.col("more") <= CROWD).repartition(wide, "anchor").sortWithinPartitions("anchor")
    found = some.mapInArrow(tidy(_scan(length)), "rid long, start int, stop int")
    crowded = bodies.filter(F.col("more") > CROWD).mapInArrow(_windows(length), "window binary, rid long, start int")
    first = crowded.groupBy("window").agg(F.min(F.struct("rid", "start")).alias("first"), F.count("*").alias("k")).filter("k > 1")
    again = crowded.join(first, "window").filter(F.struct("rid", "start") > F.col("first")).select("rid", "start", (F.col("start") + length).cast("int").alias("stop"))
    return equal.union(found).union(again)


def repeat_groups(docs: DataFrame, length: int = 100) -> DataFrame:
    """(group, n_bytes, doc_id, start): every occurrence of every repeat of at least ``length`` bytes, a row each.

    A group is a maximal repeat of the suffix array of an anchor, or a run that occurs more than once; ``group`` is a hash
    of its bytes. A repeat that is longer than a run (as passages of many lines are) comes as one group a run, which overlap
    by all but one byte of ``length``. All different runs of one anchor meet in one task here. Defined cases as in ``spans``.
    """
    spark = docs.sparkSession
    scratch, wide = Scratch(spark, "groups"), partitions(spark)
    _, once = with_rid(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), scratch)
    once = once.select(F.col("__rid").alias("rid"), "doc_id", "text")
    marks = scratch.keep(once.select("rid", "text").mapInArrow(tidy(_mark(length, False)), "anchor long, seg long, rid long, lo int, n int, done boolean").drop("done"))
    kinds = scratch.keep(marks.groupBy("anchor", "seg").agg(F.min(F.struct("rid", "lo", "n")).alias("one"), F.count("*").alias("times")))
    several = kinds.groupBy("anchor").agg(F.count("*").alias("crowd")).filter("crowd > 1").select("anchor")
    wanted = kinds.join(several, "anchor", "left_semi").groupBy("one.rid").agg(F.collect_list(F.struct("anchor", "one.lo", "one.n", "seg")).alias("marks"))
    bodies = once.join(wanted, "rid").select("text", "rid", "marks").mapInArrow(tidy(_bodies(length)), "anchor long, rid long, lo int, n int, body binary, more long")
    found = bodies.repartition(wide, "anchor").sortWithinPartitions("anchor").mapInArrow(tidy(_groups(length)), "group long, n_bytes int, anchor long, seg long, at int")
    runs_ = kinds.filter("times > 1").select(F.xxhash64("anchor", "seg").alias("group"), (F.col("one.n") + (length - 1)).alias("n_bytes"), "anchor", "seg", F.lit(0).alias("at"))
    all_ = found.union(runs_).join(marks, ["anchor", "seg"]).select("group", "n_bytes", "rid", (F.col("lo") + F.col("at")).alias("start")).distinct()
    return all_.join(once.select("rid", "doc_id"), "rid").select("group", "n_bytes", "doc_id", "start")


def with_rid(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """docs with a long ``__rid`` that follows doc_id (doc_id itself unless it repeats or has nulls), and one row a rid."""
    odd = docs.agg((F.count("*") - F.count_distinct("doc_id")).alias("n")).first()[0]
    if not odd:
        out = docs.withColumn("__rid", F.col("doc_id").cast("long"))
        return out, out
    key = docs.select("doc_id", F.xxhash64("text").alias("__text")).distinct().orderBy(F.asc_nulls_last("doc_id"), "__text")
    key = scratch.keep(key.withColumn("__rid", F.monotonically_increasing_id())).withColumnRenamed("doc_id", "__id")
    both = docs.withColumn("__hash", F.xxhash64("text"))
    out = both.join(key, both["doc_id"].eqNullSafe(key["__id"]) & (F.col("__hash") == F.col("__text"))).drop("__id", "__text", "__hash")
    return out, out.dropDuplicates(["__rid"])


def merged(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(pairs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _cut(batches):
    for batch in batches:
        n_bytes, removed, n_spans, shas, texts = [], [], [], [], []
        for text, marks in zip(batch.column("text"), batch.column("marks")):
            raw = (text.as_py() or "").encode()
            found = merged([(m["start"], m["stop"]) for m in marks.as_py()]) if marks.is_valid else []
            kept, at = [], 0
            for a, b in found:
                kept.append(raw[at:a])
                at = b
            kept = b"".join([*kept, raw[at:]])
            n_bytes.append(len(raw))
            removed.append(len(raw) - len(kept))
            n_spans.append(len(found))
            shas.append(hashlib.sha256(kept).hexdigest())
            texts.append(kept)
        new = [pa.array(n_bytes, pa.int64()), pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(shas, pa.string()), pa.array(texts, pa.binary())]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *new], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def _marked(docs: DataFrame, length: int) -> DataFrame:
    scratch = Scratch(docs.sparkSession, "suffix")
    docs, once = with_rid(docs, scratch)
    found = scratch.keep(spans(once.select(F.col("__rid").alias("rid"), "text"), scratch, length))
    scratch.release()
    marks = found.groupBy(F.col("rid").alias("__rid")).agg(F.collect_list(F.struct("start", "stop")).alias("__marks"))
    return docs.join(marks, "__rid", "left")


def repeats_removed(docs: DataFrame, length: int = 100) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each row."""
    marked = _marked(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), length)
    out = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    return marked.select("doc_id", "text", F.col("__marks").alias("marks")).mapInArrow(tidy(_cut), out).drop("kept")


def cut(docs: DataFrame, length: int = 100) -> DataFrame:
    """docs with the repeats cut from ``text``; spans shrink to whole characters. A text without spans stays as it is."""

    names, text = docs.columns, docs.columns.index("text")

    def shorter(value, marks):
        if not marks.is_valid or not value.is_valid:
            return value.as_py()
        raw, kept, at = value.as_py().encode(), [], 0
        for a, b in merged([(m["start"], m["stop"]) for m in marks.as_py()]):
            while a < b and raw[a] & 0xC0 == 0x80:
                a += 1
            while a < b < len(raw) and raw[b] & 0xC0 == 0x80:
                b -= 1
            kept.append(raw[at:a])
            at = b
        return b"".join([*kept, raw[at:]]).decode()

    def run(batches):
        for batch in batches:
            cols = [batch.column(i) for i in range(len(names))]
            cols[text] = pa.array([shorter(t, m) for t, m in zip(cols[text], batch.column(len(names)))], cols[text].type)
            yield pa.RecordBatch.from_arrays(cols, names=names)

    # all other columns travel as one, so that no name can clash
    rest = F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`") for c in names if c not in ("doc_id", "text")))
    marked = _marked(docs.select("doc_id", "text", rest.alias("rest")), length)
    back = [(F.col(c) if c in ("doc_id", "text") else F.col("rest")[c]).alias(f"c{k}") for k, c in enumerate(names)]
    return marked.select(*back, F.col("__marks").alias("marks")).mapInArrow(tidy(run), docs.schema)
