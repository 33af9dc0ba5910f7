"""Sharding by histogram sort: shards of near-equal bytes, found by counting, filled by one exchange.

Rows are sorted by (hash of the text, hash of the id), so that equal texts lie together. Each round counts exact bytes
between candidate boundaries over all partitions, first over prefixes of the text's hash and then over STEP more bits of
it in only those buckets that a splitter falls into, until every splitter is within ``tolerance`` of its target or its
bucket is a single text. A single text may lie within ``whole`` of the target instead, so that groups of equal texts of up
to twice that always stay whole; a larger one is cut by the hash of its ids, counted in the same way. Both are shares of a
shard, so a shard is off by twice the tolerance at most (and by a single row's bytes), and by twice ``whole`` only where a
group would be split.

With the splitters fixed, rows are counted once more by cell (a shard's part of a hash bucket, or of a large text's
ids), which gives each cell its first slot, and the rows are exchanged once, by cell. A writer gets a shard's rows from
its cells (``shard``, ``slot``); no cell holds more than about a 512th of all rows.

DataFrame functions only. Defined cases: a null text has no bytes, a null crc and is a group; ids may be any long, null
ones are ids like others; rows equal in id and text are interchangeable, and where very many are, a number of their own
deals them; an empty table gives no rows; all other columns stay, input columns named ``shard`` or ``slot`` (in any case)
as ``input_shard`` and ``input_slot``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .store import Scratch

STEP = 12  # bits that one round refines
CROWD = 512  # a text, or a row, with over one CROWD-th of all rows is spread over many cells
TOP = 1 << 63


def keyed(docs: DataFrame) -> DataFrame:
    """What the sort needs, and the columns of docs as __row: __h, __size, __doc and __nth (a number of each row)."""
    text = F.col("text").cast("string")
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8
    return docs.select(
        F.xxhash64(text).alias("__h"), size.alias("__size"), F.col("doc_id").cast("long").alias("__doc"), F.crc32(text).alias("__crc"),
        F.monotonically_increasing_id().alias("__nth"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"),
    )


def _refine(keys: DataFrame, by: str, goal: dict[int, float], accept) -> dict[int, tuple[int, bool, float]]:
    """For each goal (bytes before a boundary) the first value of ``by`` that lies after it: {k: (value, single, rest)}.

    Buckets of equal leading bits are counted, STEP more bits of them each round and only where a boundary falls into.
    ``accept(below, after, single)`` ends the search at a bucket's nearer edge; a ``single`` value that is not accepted
    comes back with the bytes still missing before the boundary.
    """
    base, bucket, found, shift = {k: 0 for k in goal}, {}, {}, 64
    while open_ := sorted(goal.keys() - found.keys()):
        within = keys if shift == 64 else keys.filter(F.shiftright(by, shift).isin(sorted({bucket[k] for k in open_})))
        last, shift = shift, max(0, shift - STEP)
        # at most 2 ** STEP rows for each open boundary
        rows = within.groupBy(F.shiftright(by, shift).alias("b")).agg(F.sum("__size").alias("n"), F.min(by).alias("lo"), F.max(by).alias("hi")).collect()
        rows.sort(key=lambda r: r.b)
        for k in open_:
            below, mine = base[k], [r for r in rows if last == 64 or r.b >> (last - shift) == bucket[k]]
            for r in mine:
                if below + r.n >= goal[k] or r is mine[-1]:
                    before, after = goal[k] - below, below + r.n - goal[k]
                    if accept(before, after, r.lo == r.hi):
                        found[k] = ((r.b if before <= after else r.b + 1) << shift, False, 0.0)
                    elif r.lo == r.hi:
                        found[k] = (r.lo, True, before)
                    else:
                        bucket[k], base[k] = r.b, below
                    break
                below += r.n
    return found


def splitters(keys: DataFrame, shards: int, tolerance: float, whole: float) -> list[tuple[int, int | None]]:
    """shards - 1 boundaries (text hash, id hash): rows below sort before them; id hash None is the start of the text."""
    total = keys.agg(F.sum("__size")).first()[0] or 0
    near, far = tolerance * total / shards, whole * total / shards
    if not total:
        return [(TOP, None)] * (shards - 1)
    goal = {k: total * k / shards for k in range(1, shards)}
    found = _refine(keys, "__h", goal, lambda before, after, single: min(before, after) <= (far if single else near))
    marks: dict[int, tuple[int, int | None]] = {k: (h, None) for k, (h, single, _) in found.items() if not single}
    for h in sorted({h for h, single, _ in found.values() if single}):
        rest = {k: r for k, (g, single, r) in found.items() if single and g == h}
        inner = _refine(keys.filter(F.col("__h") == h), "__g", rest, lambda before, after, single: single or min(before, after) <= near)
        marks |= {k: (h, g) for k, (g, _, _) in inner.items()}
    return [marks[k] for k in sorted(goal)]


def _after(boundary: tuple[int, int | None]) -> Column:
    h, at = boundary
    if h >= TOP:
        return F.lit(0)
    if at is not None and at >= TOP:
        return (F.col("__h") > h).cast("int")
    past = F.col("__h") >= h if at is None else (F.col("__h") > h) | ((F.col("__h") == h) & (F.col("__g") >= at))
    return past.cast("int")


def sharded(keys: DataFrame, shards: int, tolerance: float = 0.005, whole: float = 0.02) -> DataFrame:
    """``keyed`` rows with shard and slot. Give it a table that is cheap to read again."""
    n = keys.count()
    many = max(1, n // CROWD)
    # at most CROWD texts, and CROWD pairs of text and id; those are dealt by the number of the row
    texts = keys.groupBy(F.col("__h").alias("__big")).agg(F.count("*").alias("__k")).filter(F.col("__k") > many)
    texts = F.broadcast(texts.select("__big", F.ceil(F.log2(F.col("__k") / many)).cast("int").alias("__bits")))
    pairs = keys.join(texts, F.col("__h") == F.col("__big"), "left_semi").groupBy(F.col("__h").alias("__same"), F.col("__doc").alias("__id")).agg(F.count("*").alias("__k")).filter(F.col("__k") > many)
    pairs = F.broadcast(pairs.select("__same", "__id"))
    keys = keys.join(pairs, (F.col("__h") == F.col("__same")) & F.col("__doc").eqNullSafe(F.col("__id")), "left")
    keys = keys.withColumn("__g", F.when(F.col("__same").isNotNull(), F.xxhash64("__nth")).otherwise(F.xxhash64("__doc"))).drop("__same", "__id")
    marks = splitters(keys, shards, tolerance, whole)
    keys = keys.withColumn("__shard", sum((_after(m) for m in marks), F.lit(0)))
    keys = keys.join(texts, F.col("__h") == F.col("__big"), "left")
    # cells of a bucket: the rows outside crowded texts, and each crowded text's ids by the leading bits of their hash
    part = F.when(F.col("__big").isNotNull(), F.expr("shiftright(__g, 64 - __bits)")).otherwise(0)
    bits = max(1, min(STEP, (max(1, n) // 256).bit_length()))
    own = F.when(F.col("__big").isNotNull(), F.col("__h"))
    keys = keys.withColumns({"__bucket": F.shiftright("__h", 64 - bits), "__own": own, "__part": part.cast("long")})
    cell = ["__shard", "__bucket", "__own", "__part"]
    # at most 2 ** STEP cells of buckets, 2 x CROWD of crowded texts, and one more of each for each splitter
    counts = keys.groupBy(*cell).agg(F.count("*").alias("__n"))
    w = W.partitionBy("__shard").orderBy("__bucket", F.asc_nulls_first("__own"), "__part").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(*(F.col(c).alias(f"{c}_s") for c in cell), F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__start"))
    same = [F.col(c).eqNullSafe(F.col(f"{c}_s")) for c in cell]
    dealt = keys.join(F.broadcast(starts), same[0] & same[1] & same[2] & same[3])
    slot = F.row_number().over(W.partitionBy(*cell).orderBy("__h", "__doc", "__g")) - 1 + F.col("__start")
    out = dealt.withColumns({"shard": F.col("__shard").cast("int"), "slot": slot.cast("long")})
    return out.drop(*cell, *(f"{c}_s" for c in cell), "__start", "__big", "__bits", "__g")


def equal_bytes(docs: DataFrame, shards: int = 24, tolerance: float = 0.005, whole: float = 0.02) -> DataFrame:
    """All columns of docs and shard and slot; the keys are counted from the table itself, the rows exchanged once."""
    done = sharded(keyed(docs), shards, tolerance, whole)
    rename = lambda c: f"input_{c}" if c.lower() in ("shard", "slot") else c
    return done.select(*(F.col("__row")[c].alias(rename(c)) for c in docs.columns), "shard", "slot")


def digest(docs: DataFrame, shards: int = 24, tolerance: float = 0.005, whole: float = 0.02) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of each row."""
    scratch = Scratch(docs.sparkSession, "shard")
    done = sharded(scratch.keep(keyed(docs).drop("__row")), shards, tolerance, whole)
    return done.select(F.col("__doc").alias("doc_id"), F.col("__size").alias("size"), F.col("__crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
