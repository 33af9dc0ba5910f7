"""Labels and sample weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .windows import by_time


def triple_barrier(bars: DataFrame, price: str = "close", stop: str = "sl", multiple: float = 2.0, horizon: int = 10) -> DataFrame:
    """bars with ``label`` and ``t1``: stop hit first or in the same bar 0, target hit first 2, neither in a full window 1.

    The target is price + multiple * (price - stop). Bars 0 to ``horizon`` ahead are looked at; a null stop is never hit,
    nor is its target; a window cut off by the end of the series without a hit is null.
    """
    ahead = F.collect_list(F.struct(F.col("datetime").alias("at"), F.col(price).alias("p"))).over(by_time().rowsBetween(0, horizon))
    # comparing with NaN would be a hit
    level = F.nanvl(F.col(stop), F.lit(None).cast("double"))
    out = bars.select("*", ahead.alias("_ahead"), level.alias("_sl"), (F.col(price) + multiple * (F.col(price) - level)).alias("_tp"))
    hit = F.get(F.filter("_ahead", lambda x: (x["p"] <= F.col("_sl")) | (x["p"] >= F.col("_tp"))), F.lit(0))
    out = out.withColumn("_hit", hit)
    full = F.size("_ahead") == horizon + 1
    label = F.when(F.col("_hit").isNotNull(), F.when(F.col("_hit.p") <= F.col("_sl"), 0).otherwise(2)).when(full, 1)
    t1 = F.when(F.col("_hit").isNotNull(), F.col("_hit.at")).when(full, F.get("_ahead", F.lit(horizon))["at"])
    return out.withColumns({"label": label.cast("int"), "t1": t1}).drop("_ahead", "_sl", "_tp", "_hit")


def sample_weights(events: DataFrame, returns: str | None = None) -> DataFrame:
    """(ticker, t0, t1, weight): mean uniqueness of each event (ticker, t0, t1[, returns]) with a t1.

    The bars of a ticker are the starts of its events. An event spans the bars from its own up to t1, both included; a
    bar's uniqueness is one over the events on it; an event that ends before it starts weighs 0. With ``returns`` the
    weight is multiplied by the size of that column. Counting bars up to t1 is a running count over both kinds of times,
    range means are differences of prefix sums; nothing compares events with one another.
    """
    w = Window.partitionBy("ticker")
    kept = events.filter("t1 is not null")
    placed = kept.withColumns({"_s": F.row_number().over(w.orderBy("t0", "t1")) - 1, "_n": F.count("*").over(w)})
    times = placed.select("ticker", F.col("t0").alias("_t"), F.lit(1).alias("_bar"), F.lit(None).cast("int").alias("_s"))
    times = times.union(placed.select("ticker", "t1", F.lit(0), "_s"))
    upto = F.sum("_bar").over(w.orderBy("_t", F.desc("_bar")).rowsBetween(Window.unboundedPreceding, 0))
    ends = times.withColumn("_e", upto).filter("_bar = 0").select("ticker", "_s", "_e")
    spans = placed.join(ends, ["ticker", "_s"])
    closing = ends.groupBy("ticker", F.col("_e").alias("_s")).agg(F.count("*").alias("_closed"))
    on = placed.select("ticker", "_s").join(closing, ["ticker", "_s"], "left")
    run = w.orderBy("_s").rowsBetween(Window.unboundedPreceding, 0)
    on = on.withColumn("_c", F.sum(1 - F.coalesce("_closed", F.lit(0))).over(run))
    prefix = on.withColumn("_cum", F.sum(F.when(F.col("_c") > 0, 1 / F.col("_c")).otherwise(0.0)).over(run))
    before = prefix.select("ticker", (F.col("_s") + 1).alias("_s"), F.col("_cum").alias("_from"))
    through = prefix.select("ticker", (F.col("_s") + 1).cast("long").alias("_e"), F.col("_cum").alias("_to"))
    out = spans.join(before, ["ticker", "_s"], "left").join(through, ["ticker", "_e"], "left")
    life = F.col("_e") - F.col("_s")
    weight = F.when(life > 0, (F.col("_to") - F.coalesce("_from", F.lit(0.0))) / life).otherwise(0.0)
    if returns:
        weight = weight * F.abs(returns)
    return out.select("ticker", "t0", "t1", weight.alias("weight"))
