"""The market store: bars as Parquet, extended past each ticker's last bar by loads that a log commits."""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Callable
from datetime import datetime, timezone

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema
from . import vendor

#: (ticker, start, end, interval) -> vendor frame; the network lives behind it
Fetch = Callable[[str, datetime | None, datetime | None, str], DataFrame]


def newer_than(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows of ``incoming`` strictly after their ticker's last stored bar; unknown tickers come whole.

    The marks are one row a ticker and join by broadcast only while Spark finds them small.
    """
    marks = stored.groupBy(F.col("ticker").alias("_ticker")).agg(F.max("datetime").alias("_last"))
    joined = incoming.join(marks, F.col("ticker") == F.col("_ticker"), "left")
    return joined.filter(F.col("_last").isNull() | (F.col("datetime") > F.col("_last"))).drop("_ticker", "_last")


def appended(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """stored and those bars of incoming whose (ticker, datetime) it lacks, each once."""
    fresh = incoming.dropDuplicates(schema.KEY).join(stored.select(*schema.KEY), schema.KEY, "left_anti")
    return stored.unionByName(fresh)


def capitalised(bars: DataFrame) -> DataFrame:
    return bars.select("datetime", *(F.col(c).alias(c.capitalize()) for c in schema.PRICES))


_renaming = threading.Lock()  # a local file system looks before it renames, so threads of one process take turns


class Log:
    """Numbered commits, each a JSON file that is renamed into place once; the second of two writers of a number fails.

    Where the file system renames atomically without replacing (HDFS and its like) that holds between processes.
    """

    ROWS = "version long, kind string, name string, ticker string, interval string, at timestamp, columns string"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        hadoop = spark._jvm.org.apache.hadoop.fs
        self.path, self.conf = hadoop.Path, spark._jsc.hadoopConfiguration()
        self.files = self.path(root).getFileSystem(self.conf)
        self.files.mkdirs(self.path(root))
        self.context = hadoop.FileContext.getFileContext(self.path(root).toUri(), self.conf)
        self.keep = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        self.keep[0] = spark._jvm.org.apache.hadoop.fs.Options.Rename.NONE

    def entries(self) -> list[Row]:
        """All commits in order; one row a load."""
        names = [f.getPath().getName() for f in self.files.listStatus(self.path(self.root))]
        paths = [f"{self.root}/{n}" for n in names if n.endswith(".json") and n[:-5].isdigit()]
        return self.spark.read.schema(self.ROWS).json(paths).orderBy("version").collect() if paths else []

    def put(self, version: int, **entry) -> bool:
        """Whether the commit took this number."""
        at = self.path(f"{self.root}/_{uuid.uuid4().hex}")
        out = self.files.create(at, True)
        out.write(bytearray(json.dumps({"version": version, "at": datetime.now(timezone.utc).isoformat(), **entry}).encode()))
        out.close()
        try:
            with _renaming:
                self.context.rename(at, self.path(f"{self.root}/{version:012d}.json"), self.keep)
            return True
        except Py4JJavaError as e:
            self.files.delete(at, False)
            if "FileAlreadyExists" not in e.java_exception.getClass().getName():
                raise
            return False


class MarketStore:
    """Bars as Parquet below ``root``/prices, in a folder for each load, and a log of the loads below ``root``/log.

    A load writes its folder, then commits it by one rename; a folder without a commit (a load that was killed) is never
    read, and ``vacuum`` deletes it. A load decides what is new from the commits that it has read. If another one has been
    first, it takes the next number, or where that was a load of the same ticker, decides again. So two loads of a
    ticker at once leave each bar once. The log has the columns too: ``add_column`` is a commit, older bars are null there.

    Prices are partitioned by load and ticker, so that a scan of some tickers reads only their files.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.log = Log(spark, f"{self.root}/log")
        self.log.files.mkdirs(self.log.path(f"{self.root}/prices"))
        if not self.log.entries():
            self.log.put(0, kind="columns", columns=schema.BARS.json())

    def kind(self, entries: list[Row] | None = None) -> T.StructType:
        """The columns of bars, as the last commit of columns has them."""
        last = [e for e in entries or self.log.entries() if e.kind == "columns"][-1]
        return T.StructType.fromJson(json.loads(last.columns))

    def tickers(self) -> DataFrame:
        rows = [(e.ticker, e.interval, e.at) for e in self.log.entries() if e.kind == "load"]
        loads = self.spark.createDataFrame(rows, "ticker string, interval string, at timestamp")
        last = loads.groupBy("ticker").agg(F.max_by("interval", "at").alias("interval"), F.min("at").alias("first_added"), F.max("at").alias("last_updated"))
        return last.select("ticker", F.coalesce("interval", F.lit("1h")).alias("interval"), "first_added", "last_updated")

    def _prices(self, entries: list[Row], tickers: list[str] | None = None) -> DataFrame:
        kind = self.kind(entries)
        loads = [e.name for e in entries if e.kind == "load" and (tickers is None or e.ticker in tickers)]
        if not loads:
            return self.spark.createDataFrame([], kind)
        out = self.spark.read.schema(T.StructType([*kind, T.StructField("load", T.StringType())])).parquet(f"{self.root}/prices")
        out = out.filter(F.col("load").isin(loads)).drop("load").select(*kind.fieldNames())
        return out if tickers is None else out.filter(F.col("ticker").isin(tickers))

    def prices(self, tickers: list[str] | None = None, start=None, end=None) -> DataFrame:
        """Bars of some tickers in [start, end); filters reach the partitions and the files."""
        out = self._prices(self.log.entries(), tickers)
        if start is not None:
            out = out.filter(F.col("datetime") >= F.lit(start))
        return out if end is None else out.filter(F.col("datetime") < F.lit(end))

    def get_data(self, ticker: str) -> DataFrame:
        """One ticker in order of time, with capitalised names; an unknown one has no rows."""
        return capitalised(self.prices([ticker])).orderBy("datetime")

    def add_column(self, name: str, kind: str) -> None:
        """A further column of bars from now on."""
        while True:
            entries = self.log.entries()
            have = self.kind(entries)
            if name in have.fieldNames():
                return
            added = T.StructType([*have, *T.StructType.fromDDL(f"`{name}` {kind}")])
            if self.log.put(entries[-1].version + 1, kind="columns", columns=added.json()):
                return

    def write(self, bars: DataFrame) -> str:
        """Writes a load's folder and gives its name; nobody reads it before its commit."""
        name = uuid.uuid4().hex
        bars.write.partitionBy("ticker").parquet(f"{self.root}/prices/load={name}")
        return name

    def _load(self, ticker: str, interval: str, fresh: Callable[[DataFrame], DataFrame]) -> None:
        """Commits what ``fresh`` finds new against the ticker's stored bars."""
        while True:
            read = self.log.entries()
            name, version = self.write(fresh(self._prices(read, [ticker]))), read[-1].version + 1
            while not self.log.put(version, kind="load", name=name, ticker=ticker, interval=interval):
                now = self.log.entries()
                if any(e.ticker == ticker for e in now if e.version > read[-1].version):
                    self._delete(name)
                    break
                version = now[-1].version + 1
            else:
                return

    def _delete(self, name: str) -> None:
        self.log.files.delete(self.log.path(f"{self.root}/prices/load={name}"), True)

    def vacuum(self) -> list[str]:
        """Deletes the folders of loads that were never committed; call it while no load runs."""
        known = {e.name for e in self.log.entries()}
        found = [f.getPath().getName().removeprefix("load=") for f in self.log.files.listStatus(self.log.path(f"{self.root}/prices"))]
        gone = [n for n in found if n not in known]
        for name in gone:
            self._delete(name)
        return gone

    def _shaped(self, got: DataFrame, ticker: str) -> DataFrame:
        more = [f for f in self.kind() if f.name not in schema.BARS.fieldNames()]
        return schema.normalise(got, ticker, T.StructType(more))

    def add_ticker(self, ticker: str, fetch: Fetch, start: datetime | None = None, interval: str = "1h", quarters: dict[int, list[int]] | None = None) -> list | None:
        """First load of a ticker, from ``start`` or 2020, or by ``quarters``; a known one is updated instead."""
        if quarters is not None:
            return self.add_quarters(ticker, fetch, quarters, interval)
        if any(e.ticker == ticker for e in self.log.entries()):
            return self.update_ticker(ticker, fetch)
        got = self._shaped(fetch(ticker, start or datetime(2020, 1, 1, tzinfo=timezone.utc), None, interval), ticker)
        return self._load(ticker, interval, lambda stored: newer_than(got, stored).dropDuplicates(schema.KEY))

    def add_quarters(self, ticker: str, fetch: Fetch, quarters: dict[int, list[int]], interval: str = "1h") -> list[tuple[int, int, str]]:
        """Loads the quarters asked for (year -> 1 to 4), request by request; gives those that failed. Bars that the store
        has already stay as they are."""
        got, failed = vendor.fetch_quarters(ticker, quarters, fetch)
        if got is not None:
            got = self._shaped(got, ticker).dropDuplicates(schema.KEY)
            self._load(ticker, interval, lambda stored: got.join(stored.select(*schema.KEY), schema.KEY, "left_anti").select(*got.columns))
        return failed

    def update_ticker(self, ticker: str, fetch: Fetch) -> None:
        """Appends what is newer than the ticker's last bar; a ticker without bars is loaded from the start."""
        entries = [e for e in self.log.entries() if e.ticker == ticker]
        if not entries:
            return self.add_ticker(ticker, fetch)
        interval = entries[-1].interval or "1h"
        last = self.prices([ticker]).agg(F.max("datetime")).first()[0]
        got = self._shaped(fetch(ticker, last, None, interval), ticker)
        return self._load(ticker, interval, lambda stored: newer_than(got, stored).dropDuplicates(schema.KEY))
