"""Plan rewrites that Catalyst cannot make: filters below grouped maps, padded ranges of time, long series in pieces."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Step:
    """A per-ticker operation and how many rows it reads before and after each row (None: no bound)."""

    run: Callable[[DataFrame], DataFrame]
    lookback: int | None = 0
    lookahead: int | None = 0


def _edge(bars: DataFrame, at, rows: int, before: bool) -> DataFrame:
    """(ticker, edge): the time ``rows`` rows outside the range, or the last there is."""
    side = bars.select("ticker", "datetime").filter(F.col("datetime") < F.lit(at) if before else F.col("datetime") >= F.lit(at))
    order = F.desc("datetime") if before else F.asc("datetime")
    near = side.withColumn("_r", F.row_number().over(Window.partitionBy("ticker").orderBy(order))).filter(F.col("_r") <= rows)
    return near.groupBy("ticker").agg((F.min if before else F.max)("datetime").alias("_edge"))


def query(bars: DataFrame, steps: list[Step], tickers: list[str] | None = None, start=None, stop=None) -> DataFrame:
    """The steps' result for some tickers in [start, stop), reading only the bars it depends on.

    Ticker filters go below everything. A time range is widened by the rows that the steps look back and ahead, computed,
    and cut again; a step without a bound on a side keeps that side open.
    """
    if tickers is not None:
        bars = bars.filter(F.col("ticker").isin(tickers))
    back = None if any(s.lookback is None for s in steps) else sum(s.lookback for s in steps)
    ahead = None if any(s.lookahead is None for s in steps) else sum(s.lookahead for s in steps)
    read = bars
    for at, rows, before in ((start, back, True), (stop, ahead, False)):
        if at is None or rows is None:
            continue
        inside = F.col("datetime") >= F.lit(at) if before else F.col("datetime") < F.lit(at)
        if rows:
            read = read.join(_edge(bars, at, rows, before), "ticker", "left")
            reach = F.col("datetime") >= F.col("_edge") if before else F.col("datetime") <= F.col("_edge")
            read = read.filter(inside | F.coalesce(reach, F.lit(False))).drop("_edge")
        else:
            read = read.filter(inside)
    for step in steps:
        read = step.run(read)
    if start is not None:
        read = read.filter(F.col("datetime") >= F.lit(start))
    return read if stop is None else read.filter(F.col("datetime") < F.lit(stop))


def positions(bars: DataFrame, previous: list[str] = (), bucket: str = "month") -> DataFrame:
    """bars with ``_pos``, each row's place in its ticker's time, from 0; and of each column in ``previous`` the value one row
    ago, as ``_previous_<column>``.

    Rows are numbered in two levels (counts of calendar buckets summed up, rows numbered within their bucket), so that no
    task sorts a whole series.
    """
    placed = bars.withColumn("_b", F.date_trunc(bucket, "datetime"))
    lasts = [F.max_by(c, "datetime").alias(f"_last_{k}") for k, c in enumerate(previous)]
    counts = placed.groupBy("ticker", "_b").agg(F.count("*").alias("_n"), *lasts)
    months, w = Window.partitionBy("ticker").orderBy("_b"), Window.partitionBy("ticker", "_b").orderBy("datetime")
    before = F.coalesce(F.sum("_n").over(months.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("ticker", "_b", before.alias("_before"), *(F.lag(f"_last_{k}").over(months).alias(f"_last_{k}") for k in range(len(previous))))
    placed = placed.withColumn("_i", F.row_number().over(w) - 1).withColumns({f"_inner_{k}": F.lag(c).over(w) for k, c in enumerate(previous)})
    placed = placed.join(counts, ["ticker", "_b"]).withColumn("_pos", F.col("_before") + F.col("_i"))
    placed = placed.withColumns({f"_previous_{c}": F.when(F.col("_i") > 0, F.col(f"_inner_{k}")).otherwise(F.col(f"_last_{k}")) for k, c in enumerate(previous)})
    return placed.drop("_b", "_i", "_before", *(f"_inner_{k}" for k in range(len(previous))), *(f"_last_{k}" for k in range(len(previous))))


def in_pieces(bars: DataFrame, step: Step, size: int = 100_000, bucket: str = "month") -> DataFrame:
    """``step`` over series too long for one task: pieces of ``size`` rows (by ``positions``) that overlap by what the step reads.

    The step must group and order by (ticker, datetime) and have both bounds.
    """
    if step.lookback is None or step.lookahead is None or size < max(step.lookback, step.lookahead):
        raise ValueError("pieces need bounds no larger than their size")
    placed = positions(bars, bucket=bucket)
    own = F.floor(F.col("_pos") / size).cast("long")
    first = F.greatest(F.lit(0), F.floor((F.col("_pos") - step.lookahead) / size)).cast("long")
    last = F.floor((F.col("_pos") + step.lookback) / size).cast("long")
    dealt = placed.withColumns({"_own": own, "_piece": F.explode(F.sequence(first, last))}).drop("_pos")
    named = dealt.withColumn("_ticker", F.col("ticker")).withColumn("ticker", F.concat_ws("\x1f", "ticker", F.col("_piece").cast("string")))
    return step.run(named).filter("_own = _piece").withColumn("ticker", F.col("_ticker")).drop("_ticker", "_own", "_piece")
