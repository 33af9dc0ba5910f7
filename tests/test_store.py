"""The store's commits: two writers, a killed load, added columns."""

from concurrent.futures import ThreadPoolExecutor
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.sources import store

from .test_market import DAY, frame, walk


def source(df, barrier=None):
    def fetch(ticker, start, stop, interval):
        rows = df if start is None else df.filter(F.col("datetime") > F.lit(start))
        return rows.drop("ticker").withColumnRenamed("datetime", "Datetime")

    return fetch


def test_two_loads_of_a_ticker_at_once_leave_each_bar_once(spark, tmp_path):
    root, df = f"file://{tmp_path}", frame(spark, walk(30))
    stores = [store.MarketStore(spark, root) for _ in range(3)]
    stores[0].add_ticker("A", source(df.filter(F.col("datetime") < F.lit(DAY + timedelta(10)))), DAY - timedelta(1))
    with ThreadPoolExecutor(4) as pool:
        jobs = [pool.submit(s.update_ticker, "A", source(df)) for s in stores] + [pool.submit(stores[1].add_ticker, "B", source(df), DAY - timedelta(1))]
        for job in jobs:
            job.result()
    market = store.MarketStore(spark, root)
    assert market.get_data("A").count() == 30 == market.get_data("B").count()
    versions = [e.version for e in market.log.entries()]
    assert versions == list(range(6)) and market.vacuum() == []


def test_a_stale_writer_decides_again(spark, tmp_path, monkeypatch):
    root, df = f"file://{tmp_path}", frame(spark, walk(12))
    slow, fast = store.MarketStore(spark, root), store.MarketStore(spark, root)
    real, raced = slow.write, []

    def late(bars):
        name = real(bars)
        if not raced:
            raced.append(name)
            fast.add_ticker("A", source(df), DAY - timedelta(1))
        return name

    monkeypatch.setattr(slow, "write", late)
    slow.add_ticker("A", source(df), DAY - timedelta(1))
    assert fast.get_data("A").count() == 12 and len([e for e in fast.log.entries() if e.kind == "load"]) == 2
    assert raced[0] not in {e.name for e in fast.log.entries()} and fast.vacuum() == []
    assert not slow.log.put(1, kind="load") and slow.log.entries()[1].name  # a number is taken once


def test_a_killed_load_is_never_read(spark, tmp_path):
    root, df = f"file://{tmp_path}", frame(spark, walk(8))
    market = store.MarketStore(spark, root)
    name = market.write(df)
    assert market.get_data("A").count() == 0 and market.tickers().count() == 0
    market.add_ticker("A", source(df), DAY - timedelta(1))
    assert store.MarketStore(spark, root).get_data("A").count() == 8
    assert market.vacuum() == [name] and market.get_data("A").count() == 8


def test_columns_are_added(spark, tmp_path):
    root, df = f"file://{tmp_path}", frame(spark, walk(6))
    market = store.MarketStore(spark, root)
    market.add_ticker("A", source(df.limit(0).union(df.filter(F.col("datetime") < F.lit(DAY + timedelta(3))))), DAY - timedelta(1))
    market.add_column("adjusted", "double")
    market.add_column("adjusted", "double")
    market.update_ticker("A", source(df.withColumn("Adjusted", F.col("close") * 2)))
    got = store.MarketStore(spark, root).prices(["A"]).orderBy("datetime").collect()
    assert [r.adjusted for r in got] == [None] * 3 + [pytest.approx(2 * r.close) for r in got[3:]]
    assert [e.kind for e in market.log.entries()] == ["columns", "load", "columns", "load"]
    assert market.get_data("A").columns == ["datetime", "Open", "High", "Low", "Close", "Volume"]
