"""Mixing sources to target weights by pivotal dependent rounding.

Every source gets a target number of words; each of its documents should be copied target / source size times. The
whole part of that is taken outright. The fractions meet in pairs: mass moves at random from one document to the other
until one of the two is 0 or 1, and the other goes on to the next pair, so that expected copies stay exact and the sum
of fractions is kept at every step. Documents of a source are dealt to numbered cells by size, a cell is streamed in order
of size (pairs are of near-equal size, so that moving mass hardly moves words), and what is left over, one document a cell
at most, goes to the cell's parent in a reduction tree, number div FAN_IN, up to one document a source. The number of
documents taken is kept exactly; words follow as far as the sizes of a source's documents allow (one document of 20 % of
its source's words cannot be taken in part).

All draws are a hash of the seed, the level and the document; cells depend on the data alone, so reruns agree whatever
the partitions are.

Defined cases: a null text has size 0; a null source is a source, ordered last; documents of size 0 and sources without
words take nothing; repeated rows are documents of their own; an empty table gives no rows; other columns stay as they
are in ``mixture`` and are ignored by ``copies``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import Scratch, partitions

WORD = r"[^\x20\x09-\x0D]+"
CELL = 2_500  # documents that a cell should hold
FAN_IN = 256  # children, so leftovers, of one node of the tree
SALTS = 64
BANDS = 512  # bands of size, eight to each doubling, the largest first


def targets(sizes: list[tuple[str | None, int]], weights=(5, 2, 1), share: float = 1.5, most: float = 2.0) -> dict[str | None, float]:
    """Words each source should give: ``share`` of all words by weight, at most ``most`` times its size.

    Sources in order of code point (null last) take the weights in turn; what lies above a source's stop is shared
    anew by weight until no source is above.
    """
    order = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    weight = {s: float(weights[i % len(weights)]) for i, (s, _) in enumerate(order)}
    stop = {s: most * n for s, n in order}
    left, open_, out = share * sum(n for _, n in order), [s for s, _ in order], {}
    while open_:
        total = sum(weight[s] for s in open_)
        above = [s for s in open_ if left * weight[s] / total > stop[s]]
        if not above:
            return out | {s: left * weight[s] / total for s in open_}
        for s in above:
            out[s] = stop[s]
            left -= stop[s]
        open_ = [s for s in open_ if s not in out]
    return out


def _draw(key: int, level: int) -> float:
    """A number in (0, 1) from a document's 64-bit key and a level of the tree."""
    x = (key ^ (level * 0x9E3779B97F4A7C15)) & 0xFFFFFFFFFFFFFFFF
    for k in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        x = ((x ^ (x >> 30)) * k) & 0xFFFFFFFFFFFFFFFF
    return ((x ^ (x >> 31)) + 1) / (2.0**64 + 2)


def pivot(p: float, q: float, u: float) -> tuple[float, float]:
    """Moves mass between two fractions until one is 0 or 1; expectations and the sum are kept."""
    total = p + q
    if total <= 1:
        return (total, 0.0) if u * total < p else (0.0, total)
    return (1.0, total - 1) if u * (2 - total) < 1 - q else (total - 1, 1.0)


def _settled(p: float) -> bool:
    return p < 1e-9 or p > 1 - 1e-9


def _round(level: int):
    """Streams rows (group, rid, key, part) sorted by group: settled rows as (rid, extra), leftovers with their part."""

    def run(batches):
        held = None  # group, rid, key, part
        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if held and held[0] != row[0]:
                    out.append(held)
                    held = None
                if _settled(row[3]):
                    out.append(row)
                elif held is None:
                    held = row
                else:
                    p, q = pivot(held[3], row[3], _draw(row[2], level))
                    held, row = (*held[:3], p), (*row[:3], q)
                    if _settled(q):
                        out.append(row)
                        done = held
                    else:
                        out.append(held)
                        done = row
                    if _settled(done[3]):
                        out.append(done)
                        held = None
                    else:
                        held = done
            yield _rows(out)
        if held:
            yield _rows([held])

    return run


def _rows(out):
    cols = list(zip(*out)) if out else [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.float64())], names=["node", "rid", "key", "part"])


_ROWS = "node string, rid long, key long, part double"


def _last(batches):
    """Rounds each remaining fraction by itself."""
    for batch in batches:
        yield _rows([(node, rid, key, float(_draw(key, -1) < part)) for node, rid, key, part in zip(*(batch.column(k).to_pylist() for k in range(4)))])


def copies(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 7) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, key) of each row; key is a hash of doc_id, source and text."""
    spark = docs.sparkSession
    scratch, wide = Scratch(spark, "mix"), partitions(spark)
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), _key(seed).alias("key"))
    base = scratch.keep(base.withColumn("rid", F.monotonically_increasing_id()))
    # one row a source comes to the driver, never one a document
    totals = [(r["source"], r["n"], r["docs"]) for r in base.groupBy("source").agg(F.sum("size").alias("n"), F.count("*").alias("docs")).collect()]
    goal = targets([(s, n) for s, n, _ in totals], weights, share, most)
    order = sorted(totals, key=lambda r: (r[0] is None, r[0] or ""))
    table = spark.createDataFrame([(s, i, n, float(goal[s]), goal[s] / n if n else 0.0, max(1, -(-d // CELL))) for i, (s, n, d) in enumerate(order)], "s string, rank int, source_size long, target double, rate double, cells int")
    base = base.join(table, base["source"].eqNullSafe(table["s"])).drop("s")
    # a cell is a source, or where that is large, its documents of like size, split by the key; large documents come
    # first everywhere, so that what is left in the end is small
    band = F.least(F.lit(BANDS - 1), F.greatest(F.lit(0), F.lit(BANDS - 1) - F.floor(F.log2("size") * 8)))
    number = F.when(F.col("cells") == 1, F.lit(0)).otherwise(band * F.col("cells") + F.pmod("key", "cells"))
    open_ = base.filter("size > 0 and rate > floor(rate)").select(_node(F.col("rank"), number), "rid", "key", F.expr("rate - floor(rate)").alias("part"), "size", "doc_id")
    now = open_.repartition(wide, "node").sortWithinPartitions("node", F.desc("size"), "key", "doc_id").select("node", "rid", "key", "part")
    now = scratch.keep(now.mapInArrow(_round(0), _ROWS))
    is_settled = "part < 1e-9 or part > 1 - 1e-9"
    extra, left, level = now.filter(is_settled), now.filter(f"not ({is_settled})"), 1
    largest = max((-(-d // CELL) for _, _, d in totals), default=1)
    last = largest * BANDS - 1 if largest > 1 else 0  # the largest number of a cell
    while last > 0:
        rank, number = F.substring_index("node", ".", 1), F.substring_index("node", ".", -1).cast("long")
        met = left.select(_node(rank, F.floor(number / FAN_IN)).alias("up"), "rid", "key", "part", "node").repartition(wide, "up").sortWithinPartitions("up", "node", "key")
        now = scratch.keep(met.select(F.col("up").alias("node"), "rid", "key", "part").mapInArrow(_round(level), _ROWS))
        extra, left, level, last = extra.union(now.filter(is_settled)), now.filter(f"not ({is_settled})"), level + 1, last // FAN_IN
    extra = extra.union(left.mapInArrow(_last, _ROWS))
    extra = extra.filter("part > 0.5").select(F.col("rid").alias("one_more"))
    n = F.when(F.col("size") > 0, F.floor("rate")).otherwise(0) + F.col("one_more").isNotNull().cast("long")
    return base.join(extra, base["rid"] == extra["one_more"], "left").select("doc_id", "source", "size", "source_size", "target", n.cast("long").alias("copies"), "key")


def _node(rank, number):
    """A cell of a source, by its number; sorts as the numbers do."""
    return F.concat_ws(".", F.lpad(rank.cast("string"), 10, "0"), F.lpad(number.cast("string"), 19, "0")).alias("node")


def _key(seed: int):
    return F.xxhash64(F.lit(seed), F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("string"))


def mixture(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 7) -> DataFrame:
    """docs with each row as often as the mix copies it; all columns stay.

    Rows that are equal in id, source and text share their copies as evenly as can be; they are numbered in SALTS parts, so
    that no task holds all of a text's rows.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "mixture")
    taken = copies(docs, weights, share, most, seed).groupBy("key").agg(F.sum("copies").alias("total"), F.count("*").alias("rows")).filter("total > 0")
    taken = scratch.keep(taken)
    whole = docs.select(_key(seed).alias("key"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.monotonically_increasing_id().alias("nth"))
    once = whole.join(taken.filter("rows = 1").select("key", F.col("total").alias("n")), "key").select("row", "n")
    same = scratch.keep(whole.join(taken.filter("rows > 1"), "key").withColumn("salt", F.pmod(F.xxhash64("nth"), F.lit(SALTS))))
    parts = same.groupBy("key", "salt").agg(F.count("*").alias("k"))
    before = F.coalesce(F.sum("k").over(Window.partitionBy("key").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = same.withColumn("place", F.row_number().over(Window.partitionBy("key", "salt").orderBy("nth")) - 1).join(parts.select("key", "salt", before.alias("before")), ["key", "salt"])
    several = placed.select("row", F.expr("total div rows + if(place + before < total % rows, 1, 0)").alias("n"))
    both = once.union(several).filter("n > 0")
    return both.select("row", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).select("row.*")
