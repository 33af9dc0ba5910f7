"""Linear recursions as segmented scans: y = ratio * y of one row ago + term, folded in blocks that are joined afterwards.

Such a step is an affine map, and maps compose: a block of rows maps what comes before it to ratio ** rows * before +
total. Rows of a block add up their terms, each weighted by its distance, in one window of the block; blocks, one row each,
are joined by a window over blocks; every row then takes its block's start, weighted by its place. Blocks are so long that a
start has faded to one in a million at the end, so a few blocks' totals give a start to the last digit, and no sum spans
more digits than a double holds. No task holds a series: rows are exchanged by (ticker, block).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FADED, GONE = 1e-6, 1e-24  # what is left of a block's start at its end, and what is left out


def block_rows(ratio: float) -> int:
    return 1 if ratio <= FADED else max(1, math.ceil(math.log(FADED) / math.log(ratio)))


def scanned(rows: DataFrame, terms: dict[str, Column], ratio: float, valid: Column) -> DataFrame:
    """rows (with ``ticker`` and ``_pos`` from 0) with a column for each term: its sum, ``ratio`` to the power of each earlier
    row's distance; null from the first row of a ticker on that is not ``valid``. Before a term's first row it should be 0.
    """
    if not 0 <= ratio < 1:
        raise ValueError("the ratio must be at least 0 and below 1")
    size = block_rows(ratio)
    back = 1 if ratio == 0 else max(1, math.ceil(math.log(GONE) / (math.log(ratio) * size)))
    decay = lambda n: F.when(n == 0, 1.0).otherwise(F.pow(F.lit(ratio), n)) if ratio == 0 else F.pow(F.lit(ratio), n)
    rows = rows.withColumns({"_block": F.expr(f"_pos div {size}"), "_place": F.expr(f"_pos % {size}").cast("double")})
    rows = rows.withColumns({"_bad": (~F.coalesce(valid, F.lit(False))).cast("int"), **{f"_term_{c}": F.when(valid, t).otherwise(0.0) for c, t in terms.items()}})
    run = Window.partitionBy("ticker", "_block").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    local = {c: F.sum(F.col(f"_term_{c}") / decay(F.col("_place"))).over(run) * decay(F.col("_place")) for c in terms}
    rows = rows.withColumns({"_bad": F.max("_bad").over(run), **{f"_local_{c}": v for c, v in local.items()}})
    blocks = rows.groupBy("ticker", "_block").agg(F.max("_bad").alias("_spoilt"), *(F.max_by(f"_local_{c}", "_pos").alias(f"_total_{c}") for c in terms))
    w = Window.partitionBy("ticker").orderBy("_block")
    start = {c: sum((F.coalesce(F.lag(f"_total_{c}", k + 1).over(w), F.lit(0.0)) * ratio ** (size * k) for k in range(back)), F.lit(0.0)) for c in terms}
    spoilt = F.max("_spoilt").over(w.rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.select("ticker", "_block", F.coalesce(spoilt, F.lit(0)).alias("_spoilt"), *(v.alias(f"_start_{c}") for c, v in start.items()))
    out = rows.join(blocks, ["ticker", "_block"])
    whole = {c: F.when((F.col("_bad") == 0) & (F.col("_spoilt") == 0), F.col(f"_local_{c}") + F.col(f"_start_{c}") * decay(F.col("_place") + 1)) for c in terms}
    return out.withColumns(whole).drop("_block", "_place", "_bad", "_spoilt", *(f"_{k}_{c}" for k in ("term", "local", "start") for c in terms))
