"""Cross-validation splits as tables. Ranks of time are taken over the distinct times, never over the facts."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _before(counts: DataFrame, by: str, n: str):
    """How many there are before each value of ``by``."""
    return F.coalesce(F.sum(n).over(Window.orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def time_ranks(rows: DataFrame, time: str = "datetime", bucket: str = "month") -> DataFrame:
    """(time, rank from 0) of the distinct times: calendar buckets are counted and summed up, times are numbered within
    their bucket, so that only the buckets are sorted in one place."""
    times = rows.select(time).distinct().withColumn("_b", F.date_trunc(bucket, time))
    counts = times.groupBy("_b").agg(F.count("*").alias("_n"))
    starts = counts.select(F.col("_b").alias("_at"), _before(counts, "_b", "_n").alias("_start"))
    nth = F.row_number().over(Window.partitionBy("_b").orderBy(time)) - 1
    out = times.withColumn("_nth", nth).join(starts, F.col("_b").eqNullSafe(F.col("_at")))
    return out.select(time, (F.col("_start") + F.col("_nth")).cast("int").alias("rank"))


def purged_kfold(rows: DataFrame, n_splits: int = 5, t1: str | None = None, embargo_pct: float = 0.01, time: str = "datetime") -> DataFrame:
    """rows once for each fold, with ``fold`` and ``role``: test, embargo, purged or train.

    Folds are equal ranges of the distinct times, the last takes the rest; the times right after a test fold are under
    embargo; rows that begin before its end and whose t1 reaches its start are purged (a null t1 never is).
    """
    ranks = time_ranks(rows, time)
    n = ranks.count()
    size, embargo = n // n_splits, int(n * embargo_pct)
    if not size:
        raise ValueError(f"{n} times are too few for {n_splits} folds")
    edges = [(k, k * size, (k + 1) * size - 1 if k < n_splits - 1 else n - 1) for k in range(n_splits)]
    wanted = sorted({r for _, a, b in edges for r in (a, b, min(b + embargo, n - 1))})
    at = {r["rank"]: r[time] for r in ranks.filter(F.col("rank").isin(wanted)).collect()}  # three times a fold
    folds = F.array(*(F.struct(F.lit(k).alias("fold"), F.lit(at[a]).alias("lo"), F.lit(at[b]).alias("hi"), F.lit(at[min(b + embargo, n - 1)]).alias("rest")) for k, a, b in edges))
    out = rows.select("*", F.explode(folds).alias("_f"))
    t = F.col(time)
    purged = F.coalesce((t <= F.col("_f.hi")) & (F.col(t1) >= F.col("_f.lo")), F.lit(False)) if t1 else F.lit(False)
    role = F.when(t.between(F.col("_f.lo"), F.col("_f.hi")), "test").when((t > F.col("_f.hi")) & (t <= F.col("_f.rest")), "embargo").when(purged, "purged").otherwise("train")
    return out.withColumns({"fold": F.col("_f.fold"), "role": role}).drop("_f")


def positions(rows: DataFrame, time: str = "datetime", key: str = "ticker", bucket: str = "month") -> DataFrame:
    """rows with ``position`` in the order (time, key), without sorting the facts in one place: counts of calendar buckets
    are summed up, rows are numbered within their bucket."""
    placed = rows.withColumn("_b", F.date_trunc(bucket, time))
    counts = placed.groupBy("_b").agg(F.count("*").alias("_n"))
    starts = counts.select(F.col("_b").alias("_at"), _before(counts, "_b", "_n").alias("_start"))
    nth = F.row_number().over(Window.partitionBy("_b").orderBy(time, key)) - 1
    return placed.withColumn("_nth", nth).join(starts, F.col("_b").eqNullSafe(F.col("_at"))).withColumn("position", F.col("_start") + F.col("_nth")).drop("_b", "_at", "_start", "_nth")


def combinatorial(rows: DataFrame, n_splits: int = 5, n_test: int = 2, purge: int = 0, embargo: int = 0, canonical: bool = False, time: str = "datetime", key: str = "ticker") -> DataFrame:
    """rows once for each way to choose the test blocks, with ``split`` and ``role``.

    Blocks are equal ranges of positions, the last takes the rest. Between disjoint blocks the limits have no effect;
    ``canonical`` applies them: ``purge`` positions before and ``embargo`` positions after each test block leave the
    training rows. No rows give no rows.
    """
    placed = positions(rows, time, key)
    n = rows.count()
    size = n // n_splits
    if n and not size:
        raise ValueError(f"{n} rows are too few for {n_splits} blocks")
    block = F.least(F.floor(F.col("position") / max(size, 1)), F.lit(n_splits - 1)).cast("int")
    chosen = list(combinations(range(n_splits), n_test))
    splits = F.array(*(F.struct(F.lit(i).alias("split"), F.array(*map(F.lit, c)).alias("test")) for i, c in enumerate(chosen)))
    out = placed.withColumn("block", block).select("*", F.explode(splits).alias("_s"))
    near = F.lit(False)
    if canonical:
        end = lambda b: F.when(b == n_splits - 1, n).otherwise((b + 1) * size)
        near = F.exists("_s.test", lambda b: ((F.col("position") < b * size) & (F.col("position") >= b * size - purge)) | ((F.col("position") >= end(b)) & (F.col("position") < end(b) + embargo)))
    role = F.when(F.array_contains("_s.test", F.col("block")), "test").when(near, "purged").otherwise("train")
    return out.withColumns({"split": F.col("_s.split"), "role": role}).drop("_s")


def walk_forward(ranks: DataFrame, train: int = 126, test: int = 63) -> DataFrame:
    """(time, split, role): split s trains on ranks [s * test, s * test + train) and tests on the next ``test``; a rank is
    given to its splits by arithmetic, without a join."""
    n = ranks.count()
    splits = max(0, (n - train) // test)
    first = F.greatest(F.lit(0), F.floor((F.col("rank") - (train + test)) / test) + 1).cast("int")
    last = F.least(F.lit(splits - 1), F.floor(F.col("rank") / test)).cast("int")
    out = ranks.filter(first <= last).withColumn("split", F.explode(F.sequence(first, last)))
    offset = F.col("rank") - F.col("split") * test
    return out.withColumn("role", F.when(offset < train, "train").when(offset < train + test, "test")).filter("role is not null")


def randomised(spark: SparkSession, tickers: list[str], n_times: int, n_subsamples: int = 100, subset: int = 10, window: int | None = None, seed: int = 0) -> DataFrame:
    """(subsample, ticker, first_rank, last_rank): sets of assets, each with a window of times, drawn by hashes of the seed."""
    window = min(window or n_times, n_times)
    drawn = lambda *parts: F.md5(F.concat_ws(":", F.lit(str(seed)), *parts))
    s = F.col("subsample").cast("string")
    names = spark.createDataFrame([(t,) for t in tickers], "ticker string")
    all_ = spark.range(n_subsamples).select(F.col("id").cast("int").alias("subsample"), F.explode(F.array(*map(F.lit, tickers))).alias("ticker")) if tickers else names.withColumn("subsample", F.lit(0))
    nth = F.row_number().over(Window.partitionBy("subsample").orderBy(drawn(s, F.col("ticker")), "ticker"))
    start = (F.conv(F.substring(drawn(s), 1, 8), 16, 10).cast("long") % (n_times - window + 1)).cast("int")
    picked = all_.withColumn("_nth", nth).filter(F.col("_nth") <= subset)
    return picked.select("subsample", "ticker", start.alias("first_rank"), (start + window - 1).alias("last_rank"))
