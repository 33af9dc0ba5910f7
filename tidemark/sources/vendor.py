"""Requests to a price vendor, and the data source that would send them."""

from __future__ import annotations

import warnings
from datetime import date
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..schema import normalise


def quarter_windows(spark: SparkSession, tickers: DataFrame, years: list[int], quarters: list[int] = [1, 2, 3, 4]) -> DataFrame:  # noqa: B006
    """(ticker, year, quarter, start, stop): half-open request windows, one row a request."""
    grid = spark.createDataFrame([(y, q, date(y, 3 * q - 2, 1)) for y in years for q in quarters], "year int, quarter int, start date")
    asked = tickers.select("ticker", F.explode(F.array(*(F.struct(F.lit(y).alias("year"), F.lit(q).alias("quarter")) for y in years for q in quarters))).alias("w"))
    asked = asked.select("ticker", "w.year", "w.quarter")
    return asked.join(grid, ["year", "quarter"]).select("ticker", "year", "quarter", "start", F.add_months("start", 3).alias("stop"))


def fetch_quarters(ticker: str, quarters: dict[int, list[int]], fetch) -> tuple[DataFrame | None, list[tuple[int, int, str]]]:
    """(all quarters' rows under each other, requests that failed as (year, quarter, error)).

    ``fetch`` (ticker, start, stop, interval) gives a table a request; one that fails loses only its own quarter.
    """
    parts, failed = [], []
    for year, asked in quarters.items():
        for q in asked:
            start = date(year, 3 * q - 2, 1)
            stop = date(year + (q == 4), (3 * q) % 12 + 1, 1)
            try:
                parts.append(normalise(fetch(ticker, start, stop, "1h"), ticker))
            except Exception as e:  # a request that fails must not lose the others
                failed.append((year, q, f"{type(e).__name__}: {e}"))
    return (reduce(lambda a, b: a.unionByName(b), parts) if parts else None), failed


class _Window(InputPartition):
    def __init__(self, ticker: str, start: str, stop: str):
        self.ticker, self.start, self.stop = ticker, start, stop


class VendorReader(DataSourceReader):
    """One partition a request window. ``fetch`` (ticker, start, stop) -> rows is an importable name, ``module:function``.

    A request that fails gives no rows, and a warning in the worker's log; option ``strict`` makes it fail the read.
    """

    def __init__(self, options: dict):
        self.options = options

    def partitions(self):
        years = [int(y) for y in self.options.get("years", "").split(",") if y]
        starts = [date(y, m, 1) for y in years for m in (1, 4, 7, 10)]
        stops = [date(s.year + (s.month > 9), (s.month + 2) % 12 + 1, 1) for s in starts]
        return [_Window(t, str(a), str(b)) for t in self.options.get("tickers", "").split(",") if t for a, b in zip(starts, stops)]

    def read(self, partition):
        import importlib

        module, _, name = self.options["fetch"].partition(":")
        try:
            rows = list(getattr(importlib.import_module(module), name)(partition.ticker, partition.start, partition.stop))
        except Exception as e:
            if self.options.get("strict", "").lower() == "true":
                raise
            warnings.warn(f"{partition.ticker} {partition.start}: {e}", stacklevel=1)
            rows = []
        for row in rows:
            yield (partition.ticker, *row)


class VendorSource(DataSource):
    """``spark.read.format("tidemark_vendor")`` with options tickers, years and fetch."""

    @classmethod
    def name(cls):
        return "tidemark_vendor"

    def schema(self):
        return "ticker string, datetime timestamp, open double, high double, low double, close double, volume double"

    def reader(self, schema):
        return VendorReader(self.options)
