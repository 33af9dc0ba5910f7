"""Registered queries: one per operator, each over whole tables, with the SQL that should give the same rows."""

from __future__ import annotations

import tempfile
import uuid
from datetime import date, datetime, timezone

from pyspark.ml.classification import LogisticRegression
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import bsadf as adf
from .functions import labels, recursive, windows
from .functions.windows import by_time
from .operators import backtest, learning, panel, portfolio, search, splits
from .plans.ranges import Step, in_pieces, query
from .sources import bars as B
from .sources import store, universe, vendor
from .streaming import ingest
from .streaming import labels as stream_barriers

CUT = datetime(1996, 1, 1)
TICKERS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]

_BARS = """WITH bars AS (SELECT o_orderpriority AS ticker, o_orderdate AS datetime, arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high,
  min(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS close, count(*) AS volume FROM orders GROUP BY 1, 2)"""
_HOURS = """WITH hours AS (SELECT event_type AS ticker, date_trunc('hour', ts) AS datetime, first(value ORDER BY ts, event_id) AS open, max(value) AS high,
  min(value) AS low, last(value ORDER BY ts, event_id) AS close, count(*) AS volume FROM events GROUP BY 1, 2)"""
_W = "OVER (PARTITION BY ticker ORDER BY datetime"
_RET = _BARS + f""", rets AS (SELECT * FROM (SELECT datetime, ticker, close / lag(close) {_W}) - 1 AS ret FROM bars) WHERE ret IS NOT NULL),
full_days AS (SELECT datetime FROM rets GROUP BY datetime HAVING count(*) = (SELECT count(DISTINCT ticker) FROM rets)),
complete AS (SELECT rets.* FROM rets SEMI JOIN full_days USING (datetime))"""

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def register(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn

    return add


def _round(*columns: str, digits: int = 6):
    return [F.round(c, digits).alias(c) for c in columns]


def _scratch(spark: SparkSession) -> str:
    """A new folder below the shared one, or below the temporary one where none is set (local mode only)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{base or 'file://' + tempfile.gettempdir()}/tidemark-{uuid.uuid4().hex[:12]}"


# sources, scans, sinks


@register(_BARS + " SELECT * FROM bars")
def daily_bars(spark, d):
    return B.daily_bars(spark, d)


@register(_HOURS + " SELECT * FROM hours")
def hourly_bars(spark, d):
    return B.hourly_bars(spark, d)


@register(_BARS + " SELECT datetime, open AS Open, high AS High, low AS Low, close AS Close, volume AS Volume FROM bars WHERE ticker = '1-URGENT' ORDER BY datetime")
def scan_ticker(spark, d):
    return store.capitalised(B.daily_bars(spark, d).filter("ticker = '1-URGENT'")).orderBy("datetime")


@register(_BARS + " SELECT DISTINCT ticker FROM bars ORDER BY ticker")
def list_tickers(spark, d):
    return B.daily_bars(spark, d).select("ticker").distinct().orderBy("ticker")


@register(_BARS + " SELECT ticker, max(datetime) AS last FROM bars GROUP BY ticker")
def max_datetime(spark, d):
    return B.daily_bars(spark, d).groupBy("ticker").agg(F.max("datetime").alias("last"))


@register(_BARS + " SELECT * FROM bars")
def ingest_append(spark, d):
    bars = B.daily_bars(spark, d)
    stored, incoming = bars.filter(F.col("datetime") < F.lit(CUT)), bars.filter(F.col("datetime") >= F.lit(datetime(1995, 12, 1)))
    return store.appended(stored, incoming)


@register(_BARS + """, marks AS (SELECT ticker, max(datetime) AS last FROM bars WHERE datetime < TIMESTAMP '1996-01-01' GROUP BY ticker)
SELECT bars.* FROM bars LEFT JOIN marks USING (ticker) WHERE last IS NULL OR datetime > last""")
def incremental_newer_than(spark, d):
    bars = B.daily_bars(spark, d)
    return store.newer_than(bars, bars.filter(F.col("datetime") < F.lit(CUT)))


@register("""SELECT DISTINCT o_orderpriority AS ticker, y::INT AS year, q::INT AS quarter, make_date(y, 3 * q - 2, 1)::VARCHAR AS start, (make_date(y, 3 * q - 2, 1) + INTERVAL 3 MONTH)::DATE::VARCHAR AS stop
FROM orders, range(2020, 2024) t(y), range(1, 5) u(q)""")
def quarter_windows(spark, d):
    tickers = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderpriority").alias("ticker")).distinct()
    got = vendor.quarter_windows(spark, tickers, [2020, 2021, 2022, 2023])
    return got.select("ticker", "year", "quarter", F.col("start").cast("string"), F.col("stop").cast("string"))


@register(_BARS + " SELECT bars.* FROM bars WHERE ticker IN ('1-URGENT', '5-LOW')")
def universe_semi(spark, d):
    return universe.chosen(B.daily_bars(spark, d), ["1-URGENT", "5-LOW", "ABSENT.AX"])


@register(_BARS + " SELECT ticker, datetime, low, high, least(open, close) AS body_low, greatest(open, close) AS body_high, open <= close AS is_up FROM bars")
def candle_view(spark, d):
    return B.candles(B.daily_bars(spark, d))


@register("""SELECT r_name AS region, n_name AS nation, count(*) AS orders, round(sum(o_totalprice), 2) AS total
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""")
def dim_fact_join(spark, d):
    t = {n: spark.read.parquet(f"{d}/{n}.parquet") for n in ("orders", "customer", "nation", "region")}
    # orders are added up by customer before they meet the dimensions
    sums = t["orders"].groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("t"))
    rows = sums.join(t["customer"], F.col("o_custkey") == F.col("c_custkey")).join(t["nation"], F.col("c_nationkey") == F.col("n_nationkey"))
    rows = rows.join(t["region"], F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupBy(F.col("r_name").alias("region"), F.col("n_name").alias("nation")).agg(F.sum("n").alias("orders"), F.round(F.sum("t"), 2).alias("total"))


def _source(bars):
    """A vendor whose frames are bars of the tables, with names as vendors have them."""

    def fetch(ticker, start, stop, interval):
        rows = bars.filter(F.col("ticker") == ticker)
        rows = rows if start is None else rows.filter(F.col("datetime") > F.lit(start))
        rows = rows if stop is None else rows.filter(F.col("datetime") < F.lit(stop))
        return rows.select(F.col("datetime").alias("Datetime"), *(F.col(c).alias(c.capitalize()) for c in ("open", "high", "low", "close", "volume")))

    return fetch


@register(_BARS + " SELECT ticker, datetime, open, high, low, close, volume::DOUBLE AS volume FROM bars WHERE ticker IN ('1-URGENT', '5-LOW') AND datetime > TIMESTAMP '1993-01-01'")
def store_loaded(spark, d):
    """Two tickers added to a new store from bars before 1996, then updated from all bars, and read back."""
    bars = B.daily_bars(spark, d)
    market = store.MarketStore(spark, _scratch(spark))
    for ticker in ("1-URGENT", "5-LOW"):
        market.add_ticker(ticker, _source(bars.filter(F.col("datetime") < F.lit(CUT))), datetime(1993, 1, 1))
        market.add_ticker(ticker, _source(bars))
    return market.prices().withColumn("datetime", F.col("datetime").cast("timestamp_ntz"))


@register(_BARS + " SELECT ticker, '1d' AS interval, true AS is_updated FROM bars WHERE ticker IN ('1-URGENT', '2-HIGH') GROUP BY ticker")
def store_tickers(spark, d):
    """The store's list of tickers: one row each, with the first interval and times of the first and the last load."""
    bars = B.daily_bars(spark, d)
    market = store.MarketStore(spark, _scratch(spark))
    for ticker in ("1-URGENT", "2-HIGH", "1-URGENT"):
        market.add_ticker(ticker, _source(bars), datetime(1997, 1, 1), "1d")
    return store.MarketStore(spark, market.root).tickers().select("ticker", "interval", (F.col("last_updated") >= F.col("first_added")).alias("is_updated"))


@register(_BARS + """ SELECT ticker, datetime, close, CASE WHEN ticker = '5-LOW' OR datetime >= TIMESTAMP '1996-01-01' THEN round(close * volume, 2) END AS turnover
FROM bars WHERE ticker IN ('1-URGENT', '5-LOW') AND datetime > TIMESTAMP '1993-01-01'""")
def store_recovered(spark, d):
    """A store in which a load was killed before its commit and made again, and a column was added between two loads."""
    bars = B.daily_bars(spark, d)
    root = _scratch(spark)
    store.MarketStore(spark, root).add_ticker("1-URGENT", _source(bars.filter(F.col("datetime") < F.lit(CUT))), datetime(1993, 1, 1))
    killed = store.MarketStore(spark, root)
    killed.write(bars.filter("ticker = '1-URGENT'").withColumn("datetime", F.col("datetime").cast("timestamp")))
    market = store.MarketStore(spark, root)
    market.add_column("turnover", "double")
    rich = bars.withColumn("turnover", F.round(F.col("close") * F.col("volume"), 2))

    def fetch(ticker, start, stop, interval):
        rows = rich.filter((F.col("ticker") == ticker) & (F.col("datetime") > F.lit(start)))
        return rows.select(F.col("datetime").alias("Datetime"), *(F.col(c).alias(c.capitalize()) for c in ("open", "high", "low", "close", "volume", "turnover")))

    market.update_ticker("1-URGENT", fetch)
    market.add_ticker("5-LOW", fetch, datetime(1993, 1, 1))
    market.vacuum()
    return store.MarketStore(spark, root).prices().select("ticker", F.col("datetime").cast("timestamp_ntz").alias("datetime"), "close", "turnover")


@register(_BARS + """ SELECT ticker, datetime, open, high, low, close, volume::DOUBLE AS volume, (SELECT '1995Q2') AS failed FROM bars
WHERE ticker = '3-MEDIUM' AND (year(datetime) = 1994 AND quarter(datetime) IN (1, 2, 4) OR year(datetime) = 1995 AND quarter(datetime) = 1)""")
def store_quarters(spark, d):
    """A ticker loaded by quarters, one of which is asked for twice and one of which fails."""
    fetch = _source(B.daily_bars(spark, d).withColumn("datetime", F.col("datetime") + F.expr("INTERVAL 1 SECOND")))

    def flaky(ticker, start, stop, interval):
        if start == date(1995, 4, 1):
            raise OSError("no answer")
        return fetch(ticker, start, stop, interval)

    market = store.MarketStore(spark, _scratch(spark))
    market.add_ticker("3-MEDIUM", flaky, quarters={1994: [1, 2]})
    failed = market.add_ticker("3-MEDIUM", flaky, quarters={1994: [2, 4], 1995: [1, 2]})
    names = ",".join(f"{y}Q{q}" for y, q, _ in failed)
    return market.prices().withColumns({"datetime": (F.col("datetime") - F.expr("INTERVAL 1 SECOND")).cast("timestamp_ntz"), "failed": F.lit(names)})


_MEMBERS = "WITH members(index_name, ticker) AS (VALUES " + ", ".join(f"('{name}', '{t}')" for name, symbols in universe.INDICES.items() for t in symbols) + ")"


@register(_MEMBERS + """, listed AS (SELECT ticker, row_number() OVER (ORDER BY ticker) - 1 AS k, count(*) OVER () AS n FROM members WHERE index_name = 'asx200'),
traded AS (SELECT ticker, o_totalprice FROM orders JOIN listed ON k = o_custkey % n)
SELECT index_name, count(DISTINCT ticker)::INT AS members, min(ticker) AS first, max(ticker) AS last, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM traded JOIN members USING (ticker) GROUP BY index_name""")
def index_members(spark, d):
    """Orders of the members of each index; a customer trades the member of its number in the largest index."""
    members = universe.members(spark)
    listed = members.filter("index_name = 'asx200'").select("ticker", (F.row_number().over(Window.orderBy("ticker")) - 1).alias("k"))  # as many rows as the index has
    sums = spark.read.parquet(f"{d}/orders.parquet").groupBy((F.col("o_custkey") % len(universe.ASX200)).alias("k")).agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("t"))
    traded = sums.join(listed, "k")
    parts = [universe.chosen(traded, symbols).withColumn("index_name", F.lit(name)) for name, symbols in universe.INDICES.items()]
    whole = parts[0].union(parts[1]).union(parts[2]).union(parts[3]).groupBy("index_name")
    return whole.agg(F.count_distinct("ticker").cast("int").alias("members"), F.min("ticker").alias("first"), F.max("ticker").alias("last"), F.sum("n").alias("orders"), F.round(F.sum("t"), 2).alias("total"))


def month_starts(ticker: str, start: str, stop: str):
    """A vendor that knows a bar for the first of each month; one of its symbols is always down."""
    if ticker == "DOWN":
        raise OSError("no answer")
    first = date.fromisoformat(start)
    for month in range(first.month, first.month + 3):
        value = float(first.year * 100 + month)
        yield (datetime(first.year, month, 1, tzinfo=timezone.utc), value, value + 1, value - 1, value, 100.0)


@register("""SELECT ticker, make_timestamp(y, m, 1, 0, 0, 0) AS datetime, (y * 100 + m)::DOUBLE AS open, (y * 100 + m + 1)::DOUBLE AS high, (y * 100 + m - 1)::DOUBLE AS low, (y * 100 + m)::DOUBLE AS close, 100.0::DOUBLE AS volume
FROM (VALUES ('A.AX'), ('B.AX')) t(ticker), range(2022, 2024) u(y), range(1, 13) v(m)""")
def vendor_read(spark, d):
    """Two years of three symbols through the data source, one request a quarter; the symbol that is down has no rows."""
    spark.dataSource.register(vendor.VendorSource)
    got = spark.read.format("tidemark_vendor").options(tickers="A.AX,DOWN,B.AX", years="2022,2023", fetch="tidemark.queries:month_starts").load()
    return got.withColumn("datetime", F.col("datetime").cast("timestamp_ntz"))


@register(_BARS + """, c(name) AS (VALUES ('open'), ('high'), ('low'), ('close'), ('volume'), ('signal')) SELECT ticker, name, count(*) AS bars, true AS is_refused, false AS whole_is_refused FROM bars, c GROUP BY ticker, name""")
def required_columns(spark, d):
    """Each ticker's bars that a backtest would read, and whether it is refused without one of its columns before any is read."""
    signals, rows = backtest.sma_cross().signals(B.daily_bars(spark, d)), []

    def refused(table) -> bool:
        try:
            backtest.backtest(table)
        except ValueError:
            return True
        return False

    whole = refused(signals)
    rows = [(name, refused(signals.drop(name)), whole) for name in ("open", "high", "low", "close", "volume", "signal")]
    checked = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.lit(r).alias("is_refused"), F.lit(w).alias("whole_is_refused")) for n, r, w in rows)))
    counts = signals.groupBy("ticker").agg(F.count("*").alias("bars"))
    return counts.select("ticker", "bars", checked.alias("c")).select("ticker", "c.name", "bars", "c.is_refused", "c.whole_is_refused")


# bars and projections

_MERGED = _HOURS + """, ranked AS (SELECT *, row_number() OVER (PARTITION BY ticker, datetime::DATE ORDER BY datetime DESC) AS r, count(*) OVER (PARTITION BY ticker, datetime::DATE) AS n,
  lead(high) OVER w AS h2, lead(low) OVER w AS l2, lead(close) OVER w AS c2, lead(volume) OVER w AS v2 FROM hours WINDOW w AS (PARTITION BY ticker, datetime::DATE ORDER BY datetime))
SELECT ticker, datetime, open, CASE WHEN r = 2 THEN greatest(high, h2) ELSE high END AS high, CASE WHEN r = 2 THEN least(low, l2) ELSE low END AS low,
  CASE WHEN r = 2 THEN c2 ELSE close END AS close, CASE WHEN r = 2 THEN volume + v2 ELSE volume END AS volume FROM ranked WHERE r > 1 OR n = 1"""


@register(_MERGED)
def merge_last_hour(spark, d):
    return B.merge_last_hour(B.hourly_bars(spark, d))


@register(_HOURS + " SELECT * FROM hours WHERE strftime(datetime, '%H:%M') BETWEEN '11:00' AND '16:00'")
def session_hours(spark, d):
    return B.session_hours(B.hourly_bars(spark, d), "11:00", "16:00")


@register(_BARS + f" SELECT ticker, datetime, CASE WHEN count(close) {_W} ROWS 9 PRECEDING) = 10 THEN round(avg(close) {_W} ROWS 9 PRECEDING), 4) END AS mean10, round(high / low, 6) AS spread FROM bars")
def pipe_indicator(spark, d):
    both = recursive.native(lambda close, high, low: (windows.sma(close, 10), F.col(high) / F.col(low)))
    out = recursive.pipe_indicator(B.daily_bars(spark, d), both, {"close": "close", "high": "high", "low": "low"}, ["mean10", "spread"])
    return out.select("ticker", "datetime", *_round("mean10", digits=4), *_round("spread"))


_PANEL = _BARS + """, grid AS (SELECT * FROM (SELECT DISTINCT datetime FROM bars), (SELECT DISTINCT ticker FROM bars)),
wide AS (SELECT g.datetime, g.ticker, last_value(close IGNORE NULLS) OVER w AS close, last_value(volume IGNORE NULLS) OVER w AS volume
  FROM grid g LEFT JOIN bars USING (datetime, ticker) WINDOW w AS (PARTITION BY g.ticker ORDER BY g.datetime ROWS UNBOUNDED PRECEDING)), panel AS (SELECT * FROM wide WHERE close IS NOT NULL AND volume IS NOT NULL)"""


@register(_PANEL + " SELECT * FROM panel")
def panel_build(spark, d):
    bars = B.daily_bars(spark, d)
    frames = {t: bars.filter(F.col("ticker") == t).select("datetime", "close", "volume") for t in TICKERS}
    return panel.align(panel.union_assets(frames))


@register(_PANEL + " SELECT *, CASE WHEN datetime >= TIMESTAMP '1996-01-01' THEN 'test' ELSE 'train' END AS role FROM panel")
def cutoff_split(spark, d):
    return panel.cutoff_split(panel.align(B.daily_bars(spark, d).select("datetime", "ticker", "close", "volume")), CUT)


# windows


@register(_BARS + f" SELECT ticker, datetime, CASE WHEN count(close) {_W} ROWS 19 PRECEDING) = 20 THEN round(avg(close) {_W} ROWS 19 PRECEDING), 4) END AS sma FROM bars")
def sma(spark, d):
    return B.daily_bars(spark, d).select("ticker", "datetime", windows.sma("close", 20).alias("sma")).withColumn("sma", F.round("sma", 4))


_SIGNALS = _BARS + f""", means AS (SELECT ticker, datetime, close, CASE WHEN count(close) {_W} ROWS 9 PRECEDING) = 10 THEN avg(close) {_W} ROWS 9 PRECEDING) END AS a,
  CASE WHEN count(close) {_W} ROWS 19 PRECEDING) = 20 THEN avg(close) {_W} ROWS 19 PRECEDING) END AS b FROM bars),
signals AS (SELECT ticker, datetime, close, CASE WHEN lag(a) {_W}) < lag(b) {_W}) AND a > b THEN 1 WHEN lag(b) {_W}) < lag(a) {_W}) AND b > a THEN -1 ELSE 0 END AS signal FROM means)"""


@register(_SIGNALS + " SELECT ticker, datetime, signal FROM signals")
def sma_cross_signal(spark, d):
    return backtest.sma_cross().signals(B.daily_bars(spark, d)).select("ticker", "datetime", "signal")


@register(_BARS + f""", m AS (SELECT ticker, datetime, close, volume, CASE WHEN count(close) {_W} ROWS 9 PRECEDING) = 10 THEN avg(close) {_W} ROWS 9 PRECEDING) END AS mean10 FROM bars)
SELECT ticker, datetime, round(mean10, 4) AS mean10, CASE WHEN volume > 3 THEN -1 WHEN close > mean10 THEN 1 WHEN close < mean10 THEN -1 ELSE 0 END AS signal FROM m""")
def factory_signals(spark, d):
    """A strategy made from an indicator and two rules, the first of which goes before the second."""

    def mean10(close):
        return windows.sma(close, 10)

    rules = [(F.lit(False), F.col("volume") > 3), (F.col("close") > F.col("mean10"), F.col("close") < F.col("mean10"))]
    return backtest.StrategyFactory([mean10], rules=rules).signals(B.daily_bars(spark, d)).select("ticker", "datetime", *_round("mean10", digits=4), "signal")


@register(_BARS + f" SELECT ticker, datetime, CASE WHEN count(close) {_W} ROWS 19 PRECEDING) = 20 THEN round(stddev_samp(close) {_W} ROWS 19 PRECEDING), 4) END AS std FROM bars")
def rolling_std(spark, d):
    return B.daily_bars(spark, d).select("ticker", "datetime", F.round(windows.rolling_std("close", 20), 4).alias("std"))


@register(_BARS + f" SELECT ticker, datetime, round(close / lag(close) {_W}) - 1, 6) AS change FROM bars")
def pct_change(spark, d):
    return B.daily_bars(spark, d).select("ticker", "datetime", F.round(windows.pct_change("close"), 6).alias("change"))


@register(_BARS + f" SELECT ticker, datetime, (lead(close) {_W}) > close)::INT AS up FROM bars")
def next_up_label(spark, d):
    return B.daily_bars(spark, d).select("ticker", "datetime", windows.next_up("close").alias("up"))


def _mid(n: int) -> str:
    return f"CASE WHEN count(*) {_W} ROWS {n - 1} PRECEDING) = {n} THEN (max(high) {_W} ROWS {n - 1} PRECEDING) + min(low) {_W} ROWS {n - 1} PRECEDING)) / 2 END"


@register(_BARS + f""", lines AS (SELECT ticker, datetime, {_mid(9)} AS tenkan, {_mid(26)} AS kijun, {_mid(52)} AS span_b FROM bars), spans AS (SELECT *, (tenkan + kijun) / 2 AS span_a FROM lines)
SELECT ticker, datetime, round(tenkan, 4) AS tenkan, round(kijun, 4) AS kijun, round(span_a, 4) AS span_a, round(span_b, 4) AS span_b,
  round(lag(span_a, 26) {_W}), 4) AS senkou_a, round(lag(span_b, 26) {_W}), 4) AS senkou_b, NULL::DOUBLE AS chikou FROM spans""")
def ichimoku(spark, d):
    out = windows.with_ichimoku(B.daily_bars(spark, d))
    return out.select("ticker", "datetime", *_round("tenkan", "kijun", "span_a", "span_b", "senkou_a", "senkou_b", "chikou", digits=4))


@register(_BARS + f""", terms AS (SELECT *, ln(high / close) * ln(high / open) + ln(low / close) * ln(low / open) AS x FROM bars)
SELECT ticker, datetime, CASE WHEN count(x) {_W} ROWS 29 PRECEDING) = 30 THEN round(sqrt(sum(x) {_W} ROWS 29 PRECEDING) / 30), 6) END AS volatility FROM terms""")
def rogers_satchell(spark, d):
    return B.daily_bars(spark, d).select("ticker", "datetime", F.round(windows.rogers_satchell(30), 6).alias("volatility"))


_FRAC = "WITH RECURSIVE " + _BARS.removeprefix("WITH ") + """, w(k, x) AS (SELECT 0, 1.0::DOUBLE UNION ALL SELECT k + 1, -x * (0.4::DOUBLE - k) / (k + 1) FROM w WHERE abs(-x * (0.4::DOUBLE - k) / (k + 1)) >= 0.001),
n AS (SELECT count(*) AS n FROM w), b AS (SELECT ticker, datetime, close, row_number() OVER (PARTITION BY ticker ORDER BY datetime) AS i FROM bars)
SELECT b.ticker, b.datetime, CASE WHEN b.i >= n.n THEN round((SELECT sum(w.x * c.close) FROM b c, w WHERE c.ticker = b.ticker AND c.i = b.i - n.n + 1 + w.k), 3) END AS frac_diff FROM b, n"""


@register(_FRAC)
def frac_diff(spark, d):
    out = windows.frac_diff(B.daily_bars(spark, d), "close", 0.4, 1e-3)
    return out.select("ticker", "datetime", *_round("frac_diff", digits=3))


@register(_FRAC.replace("0.001", "0.00001").partition("SELECT b.ticker")[0] + """, l AS (SELECT list(x ORDER BY k) AS x, count(*) AS n FROM w),
sums AS (SELECT b.ticker, b.datetime, sum(x[c.i - b.i + n] * c.close) AS s FROM l, b JOIN b c ON c.ticker = b.ticker AND c.i <= b.i AND c.i > b.i - (SELECT n FROM l) WHERE b.i >= n GROUP BY ALL)
SELECT ticker, datetime, round(s, 3) AS frac_diff FROM b LEFT JOIN sums USING (ticker, datetime)""")
def frac_diff_long(spark, d):
    """The same down to weights of 1e-5: 1,458 of them."""
    out = windows.frac_diff(B.daily_bars(spark, d), "close", 0.4)
    return out.select("ticker", "datetime", *_round("frac_diff", digits=3))


def _seeded(n: int, select: str, body: str) -> str:
    return "WITH RECURSIVE " + _BARS.removeprefix("WITH ") + f", b AS (SELECT ticker, datetime, close, close - lag(close) {_W}) AS move, row_number() {_W}) AS i FROM bars), " + body.format(n=n) + select


@register(_seeded(20, " SELECT b.ticker, b.datetime, round(v, 4) AS ema FROM b LEFT JOIN r USING (ticker, i)", """
r(ticker, i, v) AS (SELECT ticker, {n}::BIGINT, avg(close) FROM b WHERE i <= {n} GROUP BY ticker HAVING count(*) = {n}
  UNION ALL SELECT b.ticker, b.i, r.v + (b.close - r.v) * 2.0 / ({n} + 1) FROM r JOIN b ON b.ticker = r.ticker AND b.i = r.i + 1)"""))
def ema(spark, d):
    return recursive.ema(B.daily_bars(spark, d).select("ticker", "datetime", "close"), "close", 20).select("ticker", "datetime", *_round("ema", digits=4))


@register(_seeded(14, " SELECT b.ticker, b.datetime, round(CASE WHEN u + e > 0 THEN 100 * u / (u + e) WHEN u IS NOT NULL THEN 0 END, 4) AS rsi FROM b LEFT JOIN r USING (ticker, i)", """
r(ticker, i, u, e) AS (SELECT ticker, {n}::BIGINT + 1, avg(greatest(move, 0)), avg(greatest(-move, 0)) FROM b WHERE i BETWEEN 2 AND {n} + 1 GROUP BY ticker HAVING count(*) = {n}
  UNION ALL SELECT b.ticker, b.i, r.u + (greatest(b.move, 0) - r.u) / {n}, r.e + (greatest(-b.move, 0) - r.e) / {n} FROM r JOIN b ON b.ticker = r.ticker AND b.i = r.i + 1)"""))
def rsi(spark, d):
    return recursive.rsi(B.daily_bars(spark, d).select("ticker", "datetime", "close"), "close", 14).select("ticker", "datetime", *_round("rsi", digits=4))


# labels and weights

_TREND_W = [5, 10, 20, 40, 80, 120]


def _trend_sql() -> str:
    cols = []
    for n in _TREND_W:
        f = f"OVER (PARTITION BY ticker ORDER BY datetime ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING)"
        cols.append(f"CASE WHEN n > {n} AND count(close) {f} = {n} THEN regr_slope(close, i) {f} / nullif(sqrt(greatest(regr_syy(close, i) {f} - regr_slope(close, i) {f} * regr_sxy(close, i) {f}, 0) / {n - 2} / regr_sxx(close, i) {f}), 0) END AS t{n}")
    best = f"t{_TREND_W[0]}"
    for n in _TREND_W[1:]:
        best = f"CASE WHEN ({best}) IS NULL OR abs(t{n}) > abs({best}) THEN t{n} ELSE {best} END"
    return _BARS + f", b AS (SELECT ticker, datetime, close, row_number() {_W})::DOUBLE AS i, count(*) OVER (PARTITION BY ticker) AS n FROM bars), t AS (SELECT ticker, datetime, {', '.join(cols)} FROM b) SELECT ticker, datetime, round({best}, 4) AS trend_t FROM t"


@register(_trend_sql())
def trend_scan(spark, d):
    return windows.trend_scan(B.daily_bars(spark, d), "close", _TREND_W).select("ticker", "datetime", *_round("trend_t", digits=4))


_BARRIER = _BARS + """, path AS (SELECT ticker, datetime, close, 0.6 * close AS sl, close + 0.5 * (close - 0.6 * close) AS tp, list({'at': datetime, 'p': close}) OVER w AS ahead
  FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY datetime ROWS BETWEEN CURRENT ROW AND 10 FOLLOWING)),
hits AS (SELECT *, list_filter(ahead, lambda x: x.p <= sl OR x.p >= tp)[1] AS hit FROM path),
barrier AS (SELECT ticker, datetime, close, CASE WHEN hit IS NOT NULL THEN CASE WHEN hit.p <= sl THEN 0 ELSE 2 END WHEN len(ahead) = 11 THEN 1 END::INT AS label,
  CASE WHEN hit IS NOT NULL THEN hit.at WHEN len(ahead) = 11 THEN ahead[11].at END AS t1 FROM hits)"""


def _barrier(spark, d):
    return labels.triple_barrier(B.daily_bars(spark, d).withColumn("sl", 0.6 * F.col("close")), "close", "sl", 0.5, 10)


@register(_BARRIER + " SELECT ticker, datetime, label, t1 FROM barrier")
def triple_barrier(spark, d):
    return _barrier(spark, d).select("ticker", "datetime", "label", "t1")


@register(_BARRIER + """, e AS (SELECT ticker, datetime AS t0, t1, row_number() OVER (PARTITION BY ticker ORDER BY datetime) - 1 AS s FROM barrier WHERE t1 IS NOT NULL),
f AS (SELECT a.ticker, a.t0, a.t1, a.s, count(b.s) AS e FROM e a JOIN e b ON a.ticker = b.ticker AND b.t0 <= a.t1 GROUP BY ALL),
c AS (SELECT b.ticker, b.s, count(*) AS c FROM f b JOIN f a ON a.ticker = b.ticker AND a.s <= b.s AND b.s < a.e GROUP BY ALL)
SELECT f.ticker, f.t0, f.t1, round(sum(1.0 / c.c) / any_value(f.e - f.s), 6) AS weight FROM f JOIN c ON c.ticker = f.ticker AND c.s >= f.s AND c.s < f.e GROUP BY f.ticker, f.t0, f.t1""")
def sample_weights(spark, d):
    events = _barrier(spark, d).select("ticker", F.col("datetime").alias("t0"), "t1")
    return labels.sample_weights(events).select("ticker", "t0", "t1", *_round("weight"))


_MONTHS = _BARS + ", months AS (SELECT ticker, date_trunc('month', datetime)::TIMESTAMP AS datetime, ln(avg(close)) AS close FROM bars GROUP BY 1, 2)"


def _months(spark, d):
    month = F.date_trunc("month", "datetime").cast("timestamp_ntz")
    return B.daily_bars(spark, d).groupBy("ticker", month.alias("datetime")).agg(F.ln(F.avg("close")).alias("close"))


_DESIGN = _MONTHS + f""", dy AS (SELECT ticker, datetime, lag(close) {_W}) AS y_lagged, close - lag(close) {_W}) AS dy FROM months),
lags AS (SELECT *, lag(dy) {_W}) AS dy_lag_1 FROM dy), design AS (SELECT *, row_number() {_W}) - 1 AS trend FROM lags WHERE dy_lag_1 IS NOT NULL)"""


@register(_DESIGN + " SELECT ticker, datetime, round(y_lagged, 6) AS y_lagged, round(dy, 6) AS dy, round(dy_lag_1, 6) AS dy_lag_1, trend FROM design")
def adf_design(spark, d):
    return adf.adf_design(_months(spark, d)).select("ticker", "datetime", *_round("y_lagged", "dy", "dy_lag_1"), "trend")


@register(_DESIGN + """, m AS (SELECT e.ticker, e.datetime, e.trend AS t, s.trend AS s, count(*) AS n, sum(r.y_lagged * r.y_lagged) AS a, sum(r.y_lagged * r.dy_lag_1) AS b, sum(r.y_lagged * r.trend) AS c,
  sum(r.dy_lag_1 * r.dy_lag_1) AS e, sum(r.dy_lag_1 * r.trend) AS f, sum(r.trend * r.trend) AS i, sum(r.y_lagged * r.dy) AS u, sum(r.dy_lag_1 * r.dy) AS v, sum(r.trend * r.dy) AS w, sum(r.dy * r.dy) AS yy
  FROM design e JOIN design s ON e.ticker = s.ticker AND s.trend <= e.trend - 19 JOIN design r ON r.ticker = e.ticker AND r.trend BETWEEN s.trend AND e.trend WHERE e.trend >= 20 GROUP BY ALL),
k AS (SELECT *, a * (e * i - f * f) - b * (b * i - f * c) + c * (b * f - e * c) AS det FROM m),
g AS (SELECT *, ((e * i - f * f) * u + (c * f - b * i) * v + (b * f - c * e) * w) / det AS b0, ((c * f - b * i) * u + (a * i - c * c) * v + (b * c - a * f) * w) / det AS b1,
  ((b * f - c * e) * u + (b * c - a * f) * v + (a * e - b * b) * w) / det AS b2, (e * i - f * f) / det AS v0 FROM k),
z AS (SELECT *, sqrt((yy - b0 * u - b1 * v - b2 * w) / (n - 3) * v0) AS sd FROM g)
SELECT ticker, datetime, round(max(b0 / sd), 3) AS bsadf FROM z GROUP BY ticker, datetime""")
def bsadf(spark, d):
    return adf.bsadf(_months(spark, d), "close", "linear", 1, 20).select("ticker", "datetime", *_round("bsadf", digits=3))


_PRE = ["y_lagged * y_lagged", "y_lagged * dy_lag_1", "y_lagged * trend", "dy_lag_1 * dy_lag_1", "dy_lag_1 * trend", "trend * trend", "y_lagged * dy", "dy_lag_1 * dy", "trend * dy", "dy * dy"]
_DAILY = _BARS + f""", prices AS (SELECT ticker, datetime, ln(close) AS close FROM bars), dy AS (SELECT ticker, datetime, lag(close) {_W}) AS y_lagged, close - lag(close) {_W}) AS dy FROM prices),
lags AS (SELECT *, lag(dy) {_W}) AS dy_lag_1 FROM dy), design AS (SELECT *, row_number() {_W}) - 1 AS trend FROM lags WHERE dy_lag_1 IS NOT NULL),
cum AS (SELECT ticker, datetime, trend, {", ".join(f"sum({x}) {_W}) AS c{k}" for k, x in enumerate(_PRE))}, {", ".join(f"coalesce(sum({x}) {_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p{k}" for k, x in enumerate(_PRE))} FROM design),
m AS (SELECT e.ticker, e.datetime, e.trend - s.trend + 1 AS n, {", ".join(f"e.c{k} - s.p{k} AS {x}" for k, x in enumerate(["a", "b", "c", "e", "f", "i", "u", "v", "w", "yy"]))} FROM cum e JOIN cum s ON e.ticker = s.ticker AND s.trend <= e.trend - 119 WHERE e.trend >= 120),
k AS (SELECT *, a * (e * i - f * f) - b * (b * i - f * c) + c * (b * f - e * c) AS det FROM m),
g AS (SELECT *, ((e * i - f * f) * u + (c * f - b * i) * v + (b * f - c * e) * w) / det AS b0, ((c * f - b * i) * u + (a * i - c * c) * v + (b * c - a * f) * w) / det AS b1,
  ((b * f - c * e) * u + (b * c - a * f) * v + (a * e - b * b) * w) / det AS b2, (e * i - f * f) / det AS v0 FROM k),
z AS (SELECT *, sqrt((yy - b0 * u - b1 * v - b2 * w) / (n - 3) * v0) AS sd FROM g)
SELECT ticker, datetime, round(max(b0 / sd), 3) AS bsadf FROM z GROUP BY ticker, datetime"""


@register(_DAILY)
def bsadf_daily(spark, d):
    """Windows of 120 daily bars or more, every start and every end."""
    rows = B.daily_bars(spark, d).select("ticker", "datetime", F.ln("close").alias("close"))
    return adf.bsadf(rows, "close", "linear", 1, 120, block=256).select("ticker", "datetime", *_round("bsadf", digits=3))


_SETTINGS = [("quadratic", [1], False, 0.0), ("linear", [1, 3], True, 0.5), ("sm_poly_1", [1], False, 0.5), ("sm_poly_2", [1], False, 0.0), ("sm_exp", [1], False, 0.5), ("sm_power", [1], False, 0.0)]


def _sadf_sql(name: str, model: str, lags: list[int], const: bool, phi: float, least: int) -> str:
    """One setting over all windows of the months: sums of products, from which all regressors but the first are eliminated in turn."""
    level = "close" if model == "sm_poly_1" else "ln(close)"
    z = {"sm_exp": ["t", "1.0"], "sm_power": ["ln(greatest(t, 1))", "1.0"], "sm_poly_1": ["t * t", "1.0", "t"], "sm_poly_2": ["t * t", "1.0", "t"]}.get(model)
    z = z + [level] if z else ["y1", *(f"d{k}" for k in lags), *(["1.0"] if const else []), "t", *(["t * t"] if model == "quadratic" else []), "dy"]
    pairs = [(i, j) for i in range(len(z)) for j in range(i, len(z))]
    get = lambda i, j: f"m{min(i, j)}_{max(i, j)}"
    out = f"""{name}_d AS (SELECT ticker, datetime, close, lag(close) {_W}) AS y1, close - lag(close) {_W}) AS dy FROM months), {name}_l AS (SELECT *, row_number() {_W}) - {max(lags) + 2} AS t, {", ".join(f"lag(dy, {k}) {_W}) AS d{k}" for k in lags)} FROM {name}_d),
{name}_z AS (SELECT ticker, datetime, t, {", ".join(f"({x})::DOUBLE AS z{i}" for i, x in enumerate(z))} FROM (SELECT ticker, datetime, close, y1, dy, t::DOUBLE AS t, {", ".join(f"d{k}" for k in lags)} FROM {name}_l WHERE t >= 0)),
{name}_m0 AS (SELECT e.ticker, e.datetime, s.t AS s, count(*) AS n, {", ".join(f"sum(r.z{i} * r.z{j}) AS {get(i, j)}" for i, j in pairs)}
  FROM {name}_z e JOIN {name}_z s ON e.ticker = s.ticker AND s.t <= e.t - {least - 1} JOIN {name}_z r ON r.ticker = e.ticker AND r.t BETWEEN s.t AND e.t WHERE e.t >= {least} GROUP BY ALL),"""
    for p in range(1, len(z) - 1):
        left = [(i, j) for i, j in pairs if i not in range(1, p + 1) and j not in range(1, p + 1)]
        out += f"""\n{name}_m{p} AS (SELECT ticker, datetime, s, n, {", ".join(f"{get(i, j)} - {get(i, p)} * {get(p, j)} / {get(p, p)} AS {get(i, j)}" for i, j in left)} FROM {name}_m{p - 1}),"""
    k = len(z) - 1
    stat = f"{get(0, k)} / {get(0, 0)} / sqrt(({get(k, k)} - {get(0, k)} * {get(0, k)} / {get(0, 0)}) / (n - {k}) / {get(0, 0)})"
    stat = f"abs({stat})" if model.startswith("sm") else stat
    return out + f"""\n{name} AS (SELECT ticker, datetime, '{model}' AS model, max({stat} / pow(n, {phi})) AS v FROM {name}_m{k - 1} GROUP BY ticker, datetime)"""


@register(_MONTHS + ", " + ",\n".join(_sadf_sql(f"q{i}", *x, 20) for i, x in enumerate(_SETTINGS)) + " SELECT ticker, datetime, model, round(v, 3) AS bsadf FROM (" + " UNION ALL ".join(f"SELECT * FROM q{i}" for i in range(len(_SETTINGS))) + ")")
def bsadf_models(spark, d):
    """The other models: a quadratic trend, several lags with a constant, and the four sub- and supermartingale tests, some weighted by length."""
    rows = _months(spark, d)
    parts = [adf.bsadf(rows, "close", model, lags, 20, const, phi).withColumn("model", F.lit(model)) for model, lags, const, phi in _SETTINGS]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out.select("ticker", "datetime", "model", *_round("bsadf", digits=3))


# splits


_FOLDS = _BARRIER + """, ranks AS (SELECT datetime, row_number() OVER (ORDER BY datetime) - 1 AS r FROM (SELECT DISTINCT datetime FROM bars)), n AS (SELECT count(*) AS n FROM ranks),
edges AS (SELECT k, k * (n // 5) AS a, CASE WHEN k < 4 THEN (k + 1) * (n // 5) - 1 ELSE n - 1 END AS b, n FROM range(5) t(k), n),
folds AS (SELECT k::INT AS fold, x.datetime AS lo, y.datetime AS hi, z.datetime AS rest FROM edges JOIN ranks x ON x.r = a JOIN ranks y ON y.r = b JOIN ranks z ON z.r = least(b + floor(n * 0.01)::BIGINT, n - 1)),
roles AS (SELECT ticker, datetime, label, close, fold, CASE WHEN datetime BETWEEN lo AND hi THEN 'test' WHEN datetime > hi AND datetime <= rest THEN 'embargo' WHEN datetime <= hi AND coalesce(t1 >= lo, false) THEN 'purged' ELSE 'train' END AS role FROM barrier, folds)"""


@register(_FOLDS + " SELECT ticker, datetime, fold, role FROM roles WHERE role IN ('train', 'test')")
def purged_kfold(spark, d):
    return splits.purged_kfold(_barrier(spark, d).select("ticker", "datetime", "t1"), 5, "t1", 0.01).filter("role in ('train', 'test')").select("ticker", "datetime", "fold", "role")


@register(_BARS + """, p AS (SELECT ticker, datetime, row_number() OVER (ORDER BY datetime, ticker) - 1 AS i FROM bars), n AS (SELECT count(*) AS n FROM bars),
b AS (SELECT *, least(i // (n // 5), 4) AS block FROM p, n), c AS (SELECT x AS p1, y AS p2, (row_number() OVER (ORDER BY x, y) - 1)::INT AS split FROM range(5) s(x), range(5) t(y) WHERE x < y)
SELECT ticker, datetime, split, CASE WHEN block IN (p1, p2) THEN 'test' ELSE 'train' END AS role FROM b, c""")
def cpcv_splits(spark, d):
    return splits.combinatorial(B.daily_bars(spark, d).select("ticker", "datetime"), 5, 2).select("ticker", "datetime", "split", "role")


@register(_BARS + """, r AS (SELECT datetime, row_number() OVER (ORDER BY datetime) - 1 AS r FROM (SELECT DISTINCT datetime FROM bars)), s AS (SELECT k FROM range(0, ((SELECT count(*) FROM r) - 126) // 63) t(k))
SELECT datetime, k::INT AS split, CASE WHEN r - k * 63 < 126 THEN 'train' ELSE 'test' END AS role FROM r, s WHERE r >= k * 63 AND r < k * 63 + 189""")
def walk_forward(spark, d):
    return splits.walk_forward(splits.time_ranks(B.daily_bars(spark, d))).select("datetime", "split", "role")


@register(_BARS + """, n AS (SELECT count(DISTINCT datetime) AS n, least(500, count(DISTINCT datetime)) AS w FROM bars), t AS (SELECT DISTINCT ticker FROM bars),
p AS (SELECT s::INT AS subsample, ticker, row_number() OVER (PARTITION BY s ORDER BY md5('0:' || s || ':' || ticker), ticker) AS r, ('0x' || substr(md5('0:' || s), 1, 8))::BIGINT % (n - w + 1) AS start, w FROM range(100) u(s), t, n)
SELECT subsample, ticker, start::INT AS first_rank, (start + w - 1)::INT AS last_rank FROM p WHERE r <= 3""")
def randomised_cv(spark, d):
    rows = B.daily_bars(spark, d)
    return splits.randomised(spark, [r[0] for r in rows.select("ticker").distinct().collect()], rows.select("datetime").distinct().count(), 100, 3, 500)


@register(_BARS + """, r AS (SELECT datetime, row_number() OVER (ORDER BY datetime) - 1 AS p, count(*) OVER () AS n FROM (SELECT DISTINCT datetime FROM bars)),
c AS (SELECT x AS p1, y AS p2, (row_number() OVER (ORDER BY x, y) - 1)::INT AS split FROM range(6) s(x), range(6) t(y) WHERE x < y),
e AS (SELECT r.*, c.split, least(p // (n // 6), 5) AS block, p1, p2 FROM r, c),
z AS (SELECT datetime, split, CASE WHEN block IN (p1, p2) THEN 'test' WHEN list_contains(list_transform([p1, p2], lambda b: (p < b * (n // 6) AND p >= b * (n // 6) - 10) OR (b < 5 AND p >= (b + 1) * (n // 6) AND p < (b + 1) * (n // 6) + 5)), true) THEN 'purged' ELSE 'train' END AS role FROM e)
SELECT * FROM z""")
def cpcv_purged(spark, d):
    """Combinatorial splits of the times with their limits applied: ten times before and five after each test block leave."""
    times = B.daily_bars(spark, d).select("datetime").distinct().withColumn("ticker", F.lit(""))
    return splits.combinatorial(times, 6, 2, 10, 5, canonical=True).select("datetime", "split", "role")


# learning

_PREDICTED = _FOLDS + f""", guess AS (SELECT r.*, (label = 2)::INT AS y, b.move FROM roles r JOIN (SELECT ticker, datetime, close / lag(close) {_W}) - 1 AS move FROM bars) b USING (ticker, datetime) WHERE role = 'test' AND label IS NOT NULL AND move IS NOT NULL),
trials AS (SELECT guess.*, trial::INT AS trial, (move < 0.1 * trial)::INT AS p FROM guess, range(3) t(trial)),
f1s AS (SELECT trial, fold, round(coalesce(2.0 * sum((y = 1 AND p = 1)::INT) / nullif(2 * sum((y = 1 AND p = 1)::INT) + sum((y <> p)::INT), 0), 0), 6) AS f1 FROM trials GROUP BY trial, fold)"""


def _trials(spark, d):
    rows = _barrier(spark, d).withColumns({"move": windows.pct_change("close"), "y": (F.col("label") == 2).cast("int")})
    test = splits.purged_kfold(rows, 5, "t1", 0.01).filter("role = 'test' and label is not null and move is not null")
    guess = test.withColumn("trial", F.explode(F.array(*map(F.lit, range(3))))).withColumn("p", (F.col("move") < 0.1 * F.col("trial")).cast("int"))
    return learning.f1(guess, "y", "p", ["trial", "fold"]).withColumn("f1", F.round("f1", 6))


@register(_PREDICTED + " SELECT * FROM f1s")
def f1_score(spark, d):
    return _trials(spark, d)


@register(_PREDICTED + " SELECT trial, round(avg(f1), 5) AS score FROM f1s GROUP BY trial")
def cv_score(spark, d):
    return _trials(spark, d).groupBy("trial").agg(F.round(F.avg("f1"), 5).alias("score"))


_FACTORS = [0.6, 0.9, 1.2]
_SEARCH = _FOLDS + """, known AS (SELECT fold, role, close, (label = 2)::INT AS y FROM roles WHERE label IS NOT NULL), means AS (SELECT fold, avg(close) AS m FROM known WHERE role = 'train' GROUP BY fold),
tries AS (SELECT fold, trial::INT AS trial, y, (close < m * [0.6, 0.9, 1.2][trial + 1])::INT AS p FROM known JOIN means USING (fold), range(3) t(trial) WHERE role = 'test'),
trials AS (SELECT trial, fold, coalesce(2.0 * sum((y = 1 AND p = 1)::INT) / nullif(2 * sum((y = 1 AND p = 1)::INT) + sum((y <> p)::INT), 0), 0) AS score FROM tries GROUP BY trial, fold)"""


def _search(spark, d, **settings):
    rows = _barrier(spark, d).filter("label is not null").withColumn("y", (F.col("label") == 2).cast("int"))
    folds = splits.purged_kfold(_barrier(spark, d), 5, "t1", 0.01).filter("label is not null").withColumn("y", (F.col("label") == 2).cast("int"))
    return learning.Search(lambda s: learning.BelowMean(**s), {"factor": _FACTORS}, learning.metric("f1"), **settings), folds, rows


@register(_SEARCH + " SELECT [0.6, 0.9, 1.2][trial + 1]::VARCHAR AS factor, fold, round(score, 6) AS score, 'complete' AS state FROM trials")
def search_trials(spark, d):
    """Every trial of a search over a rule's settings, with purged folds; stopped after one trial and taken up again."""
    path = f"{_scratch(spark)}/study"
    first, folds, _ = _search(spark, d, n_trials=1, path=path)
    first.run(folds, "y")
    search, folds, _ = _search(spark, d, n_trials=50, path=path)
    return search.run(folds, "y").select(F.element_at("params", "factor").alias("factor"), "fold", F.round("score", 6).alias("score"), "state")


@register(_SEARCH + """, best AS (SELECT trial, avg(score) AS s FROM trials GROUP BY trial ORDER BY s DESC LIMIT 1), whole AS (SELECT close, (label = 2)::INT AS y, datetime FROM barrier WHERE label IS NOT NULL),
held AS (SELECT y, (close < (SELECT avg(close) FROM whole WHERE datetime < TIMESTAMP '1996-01-01') * [0.6, 0.9, 1.2][(SELECT trial FROM best) + 1])::INT AS p FROM whole WHERE datetime >= TIMESTAMP '1996-01-01')
SELECT [0.6, 0.9, 1.2][(SELECT trial FROM best) + 1]::VARCHAR AS factor, 'rule' AS kind, round(2.0 * sum((y = 1 AND p = 1)::INT) / (2 * sum((y = 1 AND p = 1)::INT) + sum((y <> p)::INT)), 6) AS score FROM held""")
def best_trial(spark, d):
    """The engine's run: search, the best setting learned again on all rows before 1996, scored after it, stored with a tag."""
    search, folds, rows = _search(spark, d)
    path = _scratch(spark)
    engine = learning.ModelEngine(search, path, {"kind": "rule"})
    engine.run(folds, rows.filter(F.col("datetime") < F.lit(CUT)), rows.filter(F.col("datetime") >= F.lit(CUT)), "y")
    assert engine.load().getOrDefault("level") == engine.model.getOrDefault("level")
    return spark.read.parquet(f"{path}/runs").select(F.element_at("params", "factor").alias("factor"), F.element_at("tags", "kind").alias("kind"), F.round("score", 6).alias("score"))


_TRIALS, _STARTUP, _JOBS, _LOW, _HIGH = 12, 4, 2, 0.2, 1.8


def _study_sql() -> str:
    """The study replayed by a recursion over trials that carries all factors and scores so far."""
    number = lambda *parts: "('0x' || substr(md5('42:' || " + " || ':' || ".join(parts) + "), 1, 8))::BIGINT / 4294967296.0::DOUBLE"
    score = "(SELECT avg(s) FROM (SELECT fold, coalesce(2.0::DOUBLE * count(*) FILTER (y = 1 AND close < m * {x}) / nullif(2 * count(*) FILTER (y = 1 AND close < m * {x}) + count(*) FILTER ((y = 1) <> (close < m * {x})), 0), 0) AS s FROM held GROUP BY fold))"
    low, high = f"{_LOW}::DOUBLE", f"{_HIGH}::DOUBLE"
    width = lambda c: f"(({high} - {low}) / 8 / sqrt(len({c}) + 1))"
    logistic = lambda x: f"(1 / (1 + exp(-({x}))))"

    def density(x, c):
        p, s = logistic(f"({x} - z) / {width(c)}"), width(c)
        mass = f"{logistic(f'({high} - z) / {s}')} - {logistic(f'({low} - z) / {s}')}"
        return f"((1 / ({high} - {low}) + coalesce(list_sum(list_transform({c}, lambda z: {p} * (1 - {p}) / {s} / ({mass}))), 0)) / (len({c}) + 1))"

    u, v, s = number("t", "'factor'", "k", "'part'"), number("t", "'factor'", "k", "'place'"), width("good")
    a, b = logistic(f"({low} - d.c) / {s}"), logistic(f"({high} - d.c) / {s}")
    drawn = f"list_transform(range(0, 24), lambda k: struct_pack(k := k, v := {v}, c := good[floor({u} * (len(good) + 1))::BIGINT + 1]))"  # beyond the list: no centre, the even part
    drawn = f"list_transform({drawn}, lambda d: struct_pack(k := d.k, c := d.c, v := d.v, p := least(1 - 1e-15, greatest(1e-15, {a} + d.v * ({b} - {a})))))"
    drawn = f"list_transform({drawn}, lambda d: struct_pack(k := d.k, x := CASE WHEN d.c IS NULL THEN {low} + d.v * ({high} - {low}) ELSE least({high}, greatest({low}, d.c + {s} * ln(d.p / (1 - d.p)))) END))"
    return _FOLDS + f""", known AS (SELECT fold, role, close, (label = 2)::INT AS y FROM roles WHERE label IS NOT NULL), means AS (SELECT fold, avg(close) AS m FROM known WHERE role = 'train' GROUP BY fold),
held AS MATERIALIZED (SELECT fold, close, m, y FROM known JOIN means USING (fold) WHERE role = 'test'),
study(t, xs, scores) AS (
  SELECT 0, [x], [{score.format(x='x')}] FROM (SELECT {low} + ({number("0", "'factor'", "'start'")}) * ({high} - {low}) AS x)
  UNION ALL
  SELECT t, list_append(xs, x), list_append(scores, {score.format(x='x')}) FROM (
    SELECT t, xs, scores, CASE WHEN len(good) + len(bad) < {_STARTUP} THEN {low} + ({number("t", "'factor'", "'start'")}) * ({high} - {low})
      ELSE list_sort(list_transform({drawn},
        lambda d: struct_pack(gain := ln({density("d.x", "bad")}) - ln({density("d.x", "good")}), k := d.k, x := d.x)))[1].x END AS x
    FROM (SELECT t, xs, scores, ranked[: greatest(1, (len(ranked) + 3) // 4)] AS good, ranked[greatest(1, (len(ranked) + 3) // 4) + 1 :] AS bad
      FROM (SELECT t + 1 AS t, xs, scores, list_transform(list_sort(list_transform(range(1, t + 3 - {_JOBS}), lambda i: struct_pack(s := -scores[i], i := i, x := xs[i]))), lambda r: r.x) AS ranked FROM study WHERE t + 1 < {_TRIALS}))))
SELECT i::INT AS trial, round(xs[i + 1], 9) AS factor, CASE WHEN i + 1 - {_JOBS} >= {_STARTUP} THEN 'parzen' ELSE 'start' END AS origin, round(scores[i + 1], 6) AS score FROM study, range({_TRIALS}) r(i) WHERE t = {_TRIALS} - 1"""


@register(_study_sql().replace("WITH bars", "WITH RECURSIVE bars", 1))
def study_trials(spark, d):
    """A search over a range, two trials at a time: stopped after five, taken up again from its table, past its start by densities."""
    path = _scratch(spark)
    folds = splits.purged_kfold(_barrier(spark, d), 5, "t1", 0.01).filter("label is not null").withColumn("y", (F.col("label") == 2).cast("int"))
    made = lambda n: search.Study(lambda t: learning.BelowMean(factor=t.suggest_float("factor", _LOW, _HIGH)), learning.metric("f1"), n, startup=_STARTUP, jobs=_JOBS, prune=False, path=path)
    made(5).run(folds, "y")
    trials = made(_TRIALS).run(folds, "y")
    return trials.groupBy("trial").agg(*(F.round(F.first(F.element_at("inner", "factor")), 9).alias("factor"), F.first(F.element_at("origin", "factor")).alias("origin"), F.round(F.avg("score"), 6).alias("score")))


@register(_BARS + f""", s AS (SELECT ticker, close / (close + open) AS p, (lead(close) {_W}) > close)::INT AS y FROM bars), k AS (SELECT * FROM s WHERE y IS NOT NULL),
u AS (SELECT ticker, p, y, rank() OVER (PARTITION BY ticker ORDER BY p) + (count(*) OVER (PARTITION BY ticker, p) - 1) / 2.0 AS r FROM k)
SELECT ticker, round(2.0 * sum((y = 1 AND p >= 0.5)::INT) / (2 * sum((y = 1 AND p >= 0.5)::INT) + sum((y <> (p >= 0.5)::INT)::INT)), 6) AS f1, round(-avg(CASE WHEN y = 1 THEN ln(p) ELSE ln(1 - p) END), 6) AS log_loss,
  round((sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)), 6) AS auc FROM u GROUP BY ticker""")
def probability_scores(spark, d):
    rows = B.daily_bars(spark, d).select("ticker", (F.col("close") / (F.col("close") + F.col("open"))).alias("p"), windows.next_up("close").alias("y")).filter("y is not null")
    rows = rows.withColumn("guess", (F.col("p") >= 0.5).cast("int"))
    keys = ["ticker"]
    out = learning.f1(rows, "y", "guess", keys).join(learning.log_loss(rows, "y", "p", keys), keys).join(learning.auc(rows, "y", "p", keys), keys)
    return out.select("ticker", *_round("f1", "log_loss", "auc"))


@register(_BARS + f""", p AS (SELECT ticker, datetime, open / (open + close) AS a, close / (open + close) AS b, volume FROM bars), h AS (SELECT *, CASE WHEN volume > 1 THEN -(a * ln(a) + b * ln(b)) END AS h FROM p)
SELECT ticker, datetime, round(coalesce(last_value(h IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY datetime ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  first_value(h IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY datetime ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS h FROM h""")
def oof_entropy_fill(spark, d):
    rows = B.daily_bars(spark, d).withColumn("h", F.when(F.col("volume") > 1, learning.entropy(F.array("open", "close"))))
    return learning.fill_gaps(rows, "h", ["datetime"], ["ticker"]).select("ticker", "datetime", *_round("h"))


def _samples(spark, d):
    rows = _barrier(spark, d).withColumns({"move": windows.pct_change("close"), "gap": F.col("close") / windows.sma("close", 10) - 1, "y": (F.col("label") == 2).cast("double")})
    meta = (F.lead("close").over(by_time()) > F.col("close")).cast("double")
    return rows.withColumn("meta", meta).filter("label is not null and move is not null and gap is not null and meta is not null")


def _classifier():
    return learning.PrimarySecondary(LogisticRegression(maxIter=10), LogisticRegression(maxIter=10), ["move", "gap"], ["gap"], n_splits=3, t1="t1", label="y", meta_label="meta")


@register()
def meta_label_fit(spark, d):
    model = _classifier().fit(_samples(spark, d))
    rows = [(stage, i, float(v)) for stage, m in (("primary", model.primary_model), ("secondary", model.secondary_model)) for i, v in enumerate([m.intercept, *m.coefficients.toArray()])]
    return spark.createDataFrame(rows, "stage string, place int, weight double")


@register(_BARRIER + f""", s AS (SELECT ticker, datetime, label, row_number() {_W}) AS i, lead(close) {_W}) AS nxt FROM barrier)
SELECT ticker, datetime, true AS entropy_fits, true AS decision_fits, true AS proba_fits FROM s WHERE label IS NOT NULL AND i >= 10 AND nxt IS NOT NULL AND datetime >= TIMESTAMP '1996-01-01'""")
def meta_label_checked(spark, d):
    """The two-stage model, saved and loaded: whether its columns follow from one another and from predict and predict_proba."""
    organiser, path = learning.AssetOrganiser(_classifier(), _samples(spark, d), CUT).prepare(), f"{_scratch(spark)}/model"
    organiser.model.save(path)
    rows = learning.PrimarySecondaryModel.load(path)
    got = rows.predict_proba(rows.predict(organiser.test()))
    p = F.col("primary_proba")
    entropy = -(F.when(p > 0, p * F.ln(p)).otherwise(0.0) + F.when(p < 1, (1 - p) * F.ln(1 - p)).otherwise(0.0))
    return got.select(
        "ticker", "datetime", (F.abs(entropy - F.col("primary_entropy")) < 1e-9).alias("entropy_fits"),
        ((F.col("prediction") == F.col("final_decision")) & (F.col("final_decision") == (F.col("secondary_proba") > 0.5).cast("double"))).alias("decision_fits"),
        (F.abs(F.element_at("probability", 2) - F.col("secondary_proba")) < 1e-9).alias("proba_fits"),
    )


@register("SELECT place::INT AS place, true AS is_small FROM range(3) t(place)")
def logistic_optimal(spark, d):
    """Whether the gradient of the primary model's likelihood vanishes: by intercept and features, as a share of their size."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    rows = _samples(spark, d)
    model = LogisticRegression(maxIter=200, tol=1e-12, labelCol="y").fit(VectorAssembler(inputCols=["move", "gap"], outputCol="features").transform(rows))
    scored = model.transform(VectorAssembler(inputCols=["move", "gap"], outputCol="features").transform(rows))
    off = F.element_at(vector_to_array("probability"), 2) - F.col("y")
    sums = [F.abs(F.sum(off * x)) / F.sum(F.abs(x)) for x in (F.lit(1.0), F.col("move"), F.col("gap"))]
    return scored.agg(F.array(*sums).alias("g")).select(F.posexplode("g").alias("place", "g")).select("place", (F.col("g") < 1e-4).alias("is_small"))


@register()
def meta_label_transform(spark, d):
    organiser = learning.AssetOrganiser(_classifier(), _samples(spark, d), CUT).prepare()
    return organiser.test().select("ticker", "datetime", "primary_pred", "primary_proba", "primary_entropy", "secondary_proba", "final_decision")


# backtest


@register(_SIGNALS + f""", s AS (SELECT *, coalesce(last_value(CASE WHEN signal <> 0 THEN (signal > 0)::INT END IGNORE NULLS) {_W} ROWS UNBOUNDED PRECEDING), 0) AS position FROM signals),
g AS (SELECT *, coalesce(lag(position) {_W}), 0) * (close - coalesce(lag(close) {_W}), close)) - abs(position - coalesce(lag(position) {_W}), 0)) * close * 0.001 AS pnl FROM s)
SELECT ticker, datetime, position, round(pnl, 6) + 0.0 AS pnl, round(sum(pnl) {_W} ROWS UNBOUNDED PRECEDING), 6) + 0.0 AS equity FROM g""")
def signal_pnl(spark, d):
    got = backtest.signal_pnl(backtest.sma_cross().signals(B.daily_bars(spark, d)), 1, 0.001)
    return got.select("ticker", "datetime", "position", (F.round("pnl", 6) + 0.0).alias("pnl"), (F.round("equity", 6) + 0.0).alias("equity"))


def _accounts(fee: float = 3.0, rate: float = 0.001, cash: float = 1e7, on_close: bool = False, finalize: bool = True, exit_mode: str = "close", margin: float = 1.0) -> str:
    """The broker as a recursion over each ticker's bars: a row (ticker, i, tm, c, equity, held, its closed trade) a bar."""
    price, side = ("c", "signal") if on_close else ("o", "before")
    able = "" if exit_mode == "close" else " AND able > 0"
    return "WITH RECURSIVE " + _SIGNALS.removeprefix("WITH ") + f""",
b AS (SELECT ticker, datetime AS tm, open AS o, close AS c, signal, coalesce(lag(signal) {_W}), 0) AS before, row_number() {_W}) - 1 AS i, count(*) OVER (PARTITION BY ticker) AS n FROM bars JOIN signals USING (ticker, datetime, close)),
r(ticker, i, tm, c, n, cash, units, entry, entry_price, entry_cost, broke, held, t_entry, t_units, t_entry_price, t_exit_price, t_pnl) AS (
  SELECT ticker, -1::BIGINT, min(tm), 0.0::DOUBLE, any_value(n), {cash}::DOUBLE, 0.0::DOUBLE, NULL::TIMESTAMP, 0.0::DOUBLE, 0.0::DOUBLE, false, 0.0::DOUBLE, NULL::TIMESTAMP, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE FROM b GROUP BY ticker
  UNION ALL SELECT ticker, i, tm, c, n, CASE WHEN ends THEN cash1 + (units1 * c - ({fee} + {rate} * units1 * c)) ELSE cash1 END, CASE WHEN ends THEN 0 ELSE units1 END, entry1, price1, cost1, broke1, units1,
    CASE WHEN sells THEN entry WHEN ends THEN entry1 END, CASE WHEN sells THEN units WHEN ends THEN units1 END, CASE WHEN sells THEN entry_price WHEN ends THEN price1 END, CASE WHEN sells THEN p WHEN ends THEN c END,
    CASE WHEN sells THEN units * (p - entry_price) - ({fee} + {rate} * units * p) - entry_cost WHEN ends THEN units1 * (c - price1) - ({fee} + {rate} * units1 * c) - cost1 END
  FROM (SELECT *, units1 > 0 AND (broke1 OR {finalize} AND i = n - 1) AS ends FROM (SELECT *, broke OR units1 > 0 AND cash1 + units1 * c <= 0 AS broke1
    FROM (SELECT *, CASE WHEN buys THEN able WHEN sells THEN 0 ELSE units END AS units1, CASE WHEN buys THEN cash - (able * p + ({fee} + {rate} * able * p)) WHEN sells THEN cash + (units * p - ({fee} + {rate} * units * p)) ELSE cash END AS cash1,
      CASE WHEN buys THEN tm ELSE entry END AS entry1, CASE WHEN buys THEN p ELSE entry_price END AS price1, CASE WHEN buys THEN {fee} + {rate} * able * p ELSE entry_cost END AS cost1
    FROM (SELECT *, NOT broke AND side > 0 AND units = 0 AND able > 0 AS buys, NOT broke AND side < 0 AND units > 0{able} AS sells
    FROM (SELECT r.ticker, b.i, b.tm, b.c, b.n, b.{price} AS p, b.{side} AS side, r.cash, r.units, r.entry, r.entry_price, r.entry_cost, r.broke, floor(greatest(0, r.cash - {fee}) / {margin} / (b.{price} * (1 + {rate}))) AS able FROM r JOIN b ON b.ticker = r.ticker AND b.i = r.i + 1))))))
, runs AS (SELECT *, cash + units * c AS equity FROM r WHERE i >= 0),
trades AS (SELECT ticker, t_entry AS entry, tm AS exit, t_units::BIGINT AS units, t_entry_price AS entry_price, t_exit_price AS exit_price, t_pnl AS pnl FROM runs WHERE t_units IS NOT NULL)"""


def _runs(spark, d, **settings):
    return backtest.backtest(backtest.sma_cross().signals(B.daily_bars(spark, d)), backtest.Broker(cash=10_000_000.0, **{"commission": (3.0, 0.001), **settings}))


_TRADES = " SELECT ticker, entry, exit, units, entry_price, exit_price, printf('%.5e', pnl) AS pnl FROM trades"


def _digits(column):
    """Six digits of a double; what lies beyond doubles as SQL prints it."""
    return F.when(F.isnan(column), "-nan").when(F.abs(column) == float("inf"), F.when(F.col(column) > 0, "inf").otherwise("-inf")).otherwise(F.format_string("%.5e", column))


def _trades(runs):
    """Trades with their units as a long: null where 64 bits do not hold them (SQL fails there)."""
    out = runs.select("ticker", F.explode("trades").alias("t")).select("ticker", "t.*")
    return out.withColumns({"entry": F.col("entry").cast("timestamp_ntz"), "exit": F.col("exit").cast("timestamp_ntz"), "units": F.col("units").try_cast("long"), "pnl": _digits("pnl")})


@register(_accounts() + _TRADES)
def broker_fold(spark, d):
    return _trades(_runs(spark, d))


@register(_accounts(fee=0.0, rate=0.002, on_close=True, finalize=False) + _TRADES)
def broker_on_close(spark, d):
    """Fills at the signal's own close, a rate only, nothing closed at the end."""
    return _trades(_runs(spark, d, commission=0.002, trade_on_close=True, finalize=False))


@register(_accounts(exit_mode="order") + _TRADES)
def broker_exit_by_order(spark, d):
    """A sell is an order of its own, which a fully invested account cannot pay for."""
    return _trades(_runs(spark, d, exit_mode="order"))


@register(_accounts(margin=0.5) + _TRADES)
def broker_margin(spark, d):
    return _trades(_runs(spark, d, margin=0.5))


@register(_accounts() + " SELECT ticker, tm AS datetime, printf('%.5e', equity) AS equity, held AS units FROM runs")
def equity_curve(spark, d):
    out = _runs(spark, d).select("ticker", F.explode("equity").alias("e")).select("ticker", "e.*")
    return out.select("ticker", F.col("datetime").cast("timestamp_ntz").alias("datetime"), _digits("equity").alias("equity"), "units")


_SIX = "printf('%.5e', value)"
_METRICS = _accounts() + """, bar AS (SELECT *, equity / lag(equity) OVER w - 1 AS ret, ln(equity) - ln(lag(equity) OVER w) AS a, ln(c) - ln(lag(c) OVER w) AS b, 1 - equity / max(equity) OVER (PARTITION BY ticker ORDER BY i) AS fall,
  lag(tm) OVER w AS was, coalesce(lead(tm) OVER w, tm) AS nxt FROM runs WINDOW w AS (PARTITION BY ticker ORDER BY i)),
whole AS (SELECT ticker, epoch(max(tm)) - epoch(min(tm)) AS lasted, 100 * avg((held > 0)::INT) AS exposed, arg_max(equity, i) AS final, max(equity) AS peak, arg_min(c, i) AS c0, arg_max(c, i) AS c1,
  CASE WHEN avg((isodow(tm) >= 6)::INT) > 0.2 THEN 365 ELSE 252 END AS per, exp(avg(ln(1 + ret))) - 1 AS m, var_samp(ret) AS v, sqrt(avg(CASE WHEN ret < 0 THEN ret * ret WHEN ret >= 0 THEN 0 END)) AS down, covar_samp(a, b) / var_samp(b) AS beta, max(fall) AS worst FROM bar GROUP BY ticker),
spell AS (SELECT ticker, max(fall) AS deep, epoch(max(nxt)) - epoch(coalesce(min(was), min(tm))) AS lasted FROM (SELECT *, sum((fall <= 0)::INT) OVER (PARTITION BY ticker ORDER BY i) AS k FROM bar) WHERE fall > 0 GROUP BY ticker, k),
spells AS (SELECT ticker, avg(deep) AS deep, max(lasted) AS longest, avg(lasted) AS usual FROM spell GROUP BY ticker),
deal AS (SELECT *, pnl / (units * entry_price) AS gain, epoch(exit) - epoch(entry) AS lasted FROM trades),
deals AS (SELECT ticker, count(*)::DOUBLE AS n, avg((pnl > 0)::INT) AS win, max(gain) AS best, min(gain) AS least, exp(avg(ln(1 + gain))) - 1 AS usual, max(lasted) AS longest, avg(lasted) AS lasted, avg(gain) AS expect,
  sum(pnl) FILTER (pnl > 0) / nullif(-sum(pnl) FILTER (pnl < 0), 0) AS factor, sqrt(count(*)) * avg(pnl) / stddev_samp(pnl) AS sqn, avg(pnl) FILTER (pnl > 0) / -avg(pnl) FILTER (pnl < 0) AS ratio FROM deal GROUP BY ticker),
yearly AS (SELECT *, power(1 + m, per) - 1 AS annual, sqrt(power(v + power(1 + m, 2), per) - power(1 + m, 2 * per)) AS spread, 100 * (final / 1e7 - 1) AS ret, 100 * (c1 / c0 - 1) AS hold FROM whole),
metrics AS (SELECT y.ticker, y.lasted::DOUBLE AS "Duration", exposed::DOUBLE AS "Exposure Time [%]", final AS "Equity Final [$]", peak AS "Equity Peak [$]", ret AS "Return [%]", hold AS "Buy & Hold Return [%]", 100 * annual AS "Return (Ann.) [%]",
  100 * spread AS "Volatility (Ann.) [%]", 100 * (power(final / 1e7, 365.25 * 86400 / y.lasted) - 1) AS "CAGR [%]", annual / nullif(spread, 0) AS "Sharpe Ratio", annual / nullif(down * sqrt(per), 0) AS "Sortino Ratio",
  annual / nullif(worst, 0) AS "Calmar Ratio", ret - beta * hold AS "Alpha [%]", beta AS "Beta", -100 * worst AS "Max. Drawdown [%]", -100 * s.deep AS "Avg. Drawdown [%]", s.longest::DOUBLE AS "Max. Drawdown Duration", s.usual::DOUBLE AS "Avg. Drawdown Duration",
  coalesce(n, 0) AS "# Trades", 100 * win AS "Win Rate [%]", 100 * best AS "Best Trade [%]", 100 * least AS "Worst Trade [%]", 100 * d.usual AS "Avg. Trade [%]", d.longest::DOUBLE AS "Max. Trade Duration", d.lasted::DOUBLE AS "Avg. Trade Duration",
  factor AS "Profit Factor", 100 * expect AS "Expectancy [%]", sqn AS "SQN", win - (1 - win) / ratio AS "Kelly Criterion" FROM yearly y LEFT JOIN spells s USING (ticker) LEFT JOIN deals d USING (ticker)),
named AS (UNPIVOT metrics ON COLUMNS(* EXCLUDE (ticker)) INTO NAME metric VALUE value)"""


@register(_METRICS + f" SELECT ticker, metric, {_SIX} AS value FROM named WHERE isfinite(value)")
def run_metrics(spark, d):
    """Every metric of every ticker's run, six digits of each."""
    got = _runs(spark, d).select("ticker", F.explode("metrics").alias("metric", "value"))
    return got.withColumn("value", F.format_string("%.5e", "value"))


@register(_METRICS + f" SELECT metric, {_SIX} AS value, n FROM (SELECT metric, avg(value) AS value, count(*) AS n FROM named WHERE isfinite(value) AND ticker IN ('1-URGENT', '2-HIGH') GROUP BY metric)")
def batch_saved(spark, d):
    """A batch over a table a symbol, one of which fails: saved, read back and averaged."""
    bars, path = B.daily_bars(spark, d), f"{_scratch(spark)}/results"
    frames = {t: bars.filter(F.col("ticker") == t).drop("ticker") for t in TICKERS[:2]}
    frames["BROKEN"] = frames["1-URGENT"].limit(30).withColumn("close", F.lit(None).cast("double"))
    batch = backtest.BatchBacktester(path)
    batch.run(frames, backtest.sma_cross, broker=backtest.Broker(cash=10_000_000.0, commission=(3.0, 0.001)), n1=10, n2=20)
    stored = batch.load(spark, batch.save(date(2024, 1, 31)))
    named = stored.select("ticker", F.explode(F.from_json("metrics", "map<string,string>")).alias("metric", "value"))
    good = named.filter("ticker <> 'BROKEN'").select("metric", F.col("value").try_cast("double").alias("value"))
    return good.groupBy("metric").agg(F.format_string("%.5e", F.avg("value")).alias("value"), F.count("*").alias("n"))


_STATS = _BARS + """, stats AS (SELECT ticker, count(*)::DOUBLE AS bars, sum((close > open)::INT)::DOUBLE AS rises, CASE WHEN ticker <> '5-LOW' THEN max(volume)::DOUBLE END AS busiest FROM bars GROUP BY ticker)"""


def _stats(spark, d):
    rows = B.daily_bars(spark, d).groupBy("ticker").agg(F.count("*").cast("double").alias("bars"), F.sum((F.col("close") > F.col("open")).cast("int")).cast("double").alias("rises"), F.max("volume").cast("double").alias("busiest"))
    named = F.create_map(F.lit("Bars"), F.col("bars"), F.lit("Rises"), F.col("rises"), F.lit("Busiest"), F.when(F.col("ticker") != "5-LOW", F.col("busiest")).otherwise(F.lit(float("nan"))))
    return rows.select("ticker", F.lit(None).cast("string").alias("error"), F.map_filter(named, lambda k, v: ~F.isnan(v)).alias("metrics"))


@register(_STATS + """ SELECT metric, round(avg(value), 6) AS value, count(*) AS n FROM (SELECT 'Bars' AS metric, bars AS value FROM stats UNION ALL SELECT 'Rises', rises FROM stats UNION ALL SELECT 'Busiest', busiest FROM stats)
WHERE value IS NOT NULL GROUP BY metric""")
def avg_metrics(spark, d):
    return backtest.average_metrics(_stats(spark, d)).select("metric", *_round("value"), "n")


@register(_STATS + """ SELECT ticker, '2024-01-31_Counts' AS batch_run_name, '{"Bars":' || bars || ',"Rises":' || rises || CASE WHEN busiest IS NULL THEN '' ELSE ',"Busiest":' || busiest END || '}' AS metrics FROM stats""")
def results_json(spark, d):
    return backtest.result_rows(_stats(spark, d), "2024-01-31_Counts")


@register(_STATS + """ SELECT ticker, '2024-01-31_Counts' AS batch_run_name, bars AS "Bars", rises AS "Rises", busiest AS "Busiest" FROM stats""")
def results_flatten(spark, d):
    name = backtest.batch_name("Counts", date(2024, 1, 31))
    return backtest.flatten_results(results_json(spark, d).withColumn("batch_run_name", name), ["Bars", "Rises", "Busiest"])


@register(_STATS + " SELECT ticker, CASE WHEN rises % 2 = 0 THEN '2024-01-31_Even' ELSE '2024-01-31_Odd' END AS batch_run_name FROM stats WHERE rises % 2 = 0")
def results_filter(spark, d):
    rows = _stats(spark, d).select("ticker", F.when(F.element_at("metrics", "Rises") % 2 == 0, "2024-01-31_Even").otherwise("2024-01-31_Odd").alias("batch_run_name"))
    return rows.filter(F.col("batch_run_name").isin(["2024-01-31_Even"]))


# portfolios


def _returns(spark, d):
    return portfolio.complete(panel.returns_long(B.daily_bars(spark, d)))


@register(_RET + " SELECT datetime, " + ", ".join(f"round(any_value(CASE WHEN ticker = '{t}' THEN ret END), 6) AS r{t[0]}" for t in TICKERS) + " FROM complete GROUP BY datetime")
def returns_matrix(spark, d):
    wide = panel.returns_matrix(panel.returns_long(B.daily_bars(spark, d)), TICKERS)
    return wide.select("datetime", *(F.round(f"`{t}`", 6).alias(f"r{t[0]}") for t in TICKERS))


@register(_RET + " SELECT datetime, round(avg(ret), 6) AS ret FROM complete GROUP BY datetime")
def equal_weight(spark, d):
    return portfolio.equal_weight(_returns(spark, d)).select("datetime", *_round("ret"))


@register(_RET + """, e AS (SELECT 'EqualWeighted' AS strategy, datetime, avg(ret) AS ret FROM complete GROUP BY datetime),
x AS (SELECT *, sum(ret) OVER (ORDER BY datetime) AS cum, avg(ret) OVER () AS m, row_number() OVER (ORDER BY ret, datetime) AS r, count(*) OVER () AS n FROM e), y AS (SELECT *, greatest(max(cum) OVER (ORDER BY datetime), 0) - cum AS fall FROM x)
SELECT strategy, round(avg(ret) * 252, 4) AS annual_mean, round(stddev_samp(ret) * sqrt(252), 4) AS annual_std, round(avg(ret) / stddev_samp(ret) * sqrt(252), 4) AS annual_sharpe, round(max(fall), 4) AS max_drawdown,
  round(avg(ret) / sqrt(sum(power(least(ret - m, 0), 2)) / (count(*) - 1)) * sqrt(252), 4) AS annual_sortino, round(avg(ret) / -avg(CASE WHEN r <= ceil(n * (1 - 0.95::DOUBLE)) THEN ret END), 4) AS cvar_ratio FROM y GROUP BY strategy""")
def portfolio_measures(spark, d):
    got = portfolio.measures(portfolio.equal_weight(_returns(spark, d)).withColumn("strategy", F.lit("EqualWeighted")), ["strategy"])
    return got.select("strategy", *_round("annual_mean", "annual_std", "annual_sharpe", "max_drawdown", "annual_sortino", "cvar_ratio", digits=4))


def _lab(spark, d):
    return portfolio.StrategyLab(panel.returns_long(B.daily_bars(spark, d)), {"EqualWeighted": {"estimator": "equal"}, "MeanRisk": {"estimator": "mean_variance", "grid": [{"risk_aversion": 1.0}, {"risk_aversion": 2.0}]}})


def portfolio_grid(spark, d):
    """The mean score of each setting of the grid over the test windows."""
    return _lab(spark, d).search().select("strategy", "param", F.round("score", 4).alias("score"))


@register(_RET + """, r AS (SELECT datetime, row_number() OVER (ORDER BY datetime) - 1 AS r FROM (SELECT DISTINCT datetime FROM complete)), s AS (SELECT k FROM range(0, ((SELECT count(*) FROM r) - 126) // 63) t(k))
SELECT 'EqualWeighted' AS strategy, k::INT AS split, datetime, round(avg(ret), 6) AS ret FROM complete JOIN r USING (datetime), s WHERE r >= k * 63 + 126 AND r < k * 63 + 189 GROUP BY k, datetime""")
def walk_forward_returns(spark, d):
    """The search's winner over its walk-forward windows."""
    lab = portfolio.StrategyLab(panel.returns_long(B.daily_bars(spark, d)), {"EqualWeighted": {"estimator": "equal"}})
    lab.search()
    return lab.journey().select("strategy", "split", "datetime", *_round("ret"))


_SPLITS = _RET + """, r AS (SELECT datetime, row_number() OVER (ORDER BY datetime) - 1 AS r FROM (SELECT DISTINCT datetime FROM complete)), s AS (SELECT k::INT AS split FROM range(0, greatest(0, ((SELECT count(*) FROM r) - 126) // 63)) t(k))"""


@register(_SPLITS + """, e AS (SELECT split, datetime, avg(ret) AS ret FROM complete JOIN r USING (datetime), s WHERE r >= split * 63 + 126 AND r < split * 63 + 189 GROUP BY split, datetime)
SELECT 'EqualWeighted' AS strategy, round(avg(m), 4) AS score, 1 / (SELECT count(DISTINCT ticker) FROM complete) AS weight FROM (SELECT split, avg(ret) / stddev_samp(ret) * sqrt(252) AS m FROM e GROUP BY split) HAVING count(*) > 0""")
def portfolio_search(spark, d):
    """The search over equal weights, and the weights learned again on all returns."""
    lab = portfolio.StrategyLab(panel.returns_long(B.daily_bars(spark, d)), {"EqualWeighted": {"estimator": "equal"}})
    found = lab.search().select("strategy", F.round("score", 4).alias("score"))
    return found.join(lab.refitted().groupBy("strategy").agg(F.avg("weight").alias("weight")), "strategy")


_ROBUST = _RET + """, r AS (SELECT datetime, row_number() OVER (ORDER BY datetime) - 1 AS p, count(*) OVER () AS n FROM (SELECT DISTINCT datetime FROM complete))"""


def _robust(spark, d):
    lab = portfolio.StrategyLab(panel.returns_long(B.daily_bars(spark, d)), {})
    lab.best = {"EqualWeighted": {"estimator": "equal"}}
    return lab


@register(_ROBUST + """, c AS (SELECT x AS p1, y AS p2, (row_number() OVER (ORDER BY x, y) - 1)::INT AS split FROM range(5) s(x), range(5) t(y) WHERE x < y)
SELECT split, datetime, round(avg(ret), 6) AS ret FROM complete JOIN r USING (datetime), c WHERE least(p // (n // 5), 4) IN (p1, p2) GROUP BY split, datetime""")
def combinatorial_returns(spark, d):
    """Equal weights over all choices of two of five blocks of times, ten times next to each left out of training."""
    return _robust(spark, d).combinatorial(5, 2).select("split", "datetime", *_round("ret"))


@register(_ROBUST + """, t AS (SELECT DISTINCT ticker FROM complete), w AS (SELECT any_value(n) AS n, least(260, any_value(n)) AS w FROM r),
p AS (SELECT s::INT AS subsample, ticker, row_number() OVER (PARTITION BY s ORDER BY md5('3:' || s || ':' || ticker), ticker) AS k, ('0x' || substr(md5('3:' || s), 1, 8))::BIGINT % (n - w + 1) AS start, w FROM range(8) u(s), t, w),
z AS (SELECT subsample, r.p - start AS local, w, c.datetime, ret FROM p JOIN complete c USING (ticker) JOIN r USING (datetime) WHERE k <= 3 AND r.p BETWEEN start AND start + w - 1)
SELECT subsample, split::INT AS split, datetime, round(avg(ret), 6) AS ret FROM z, range(10) v(split) WHERE split < (w - 126) // 63 AND local >= 126 + 63 * split AND local < 189 + 63 * split GROUP BY ALL""")
def randomised_returns(spark, d):
    """Equal weights walked forward on eight drawn sets of three assets and windows of 260 times."""
    return _robust(spark, d).randomised(8, 3, 260, 3).select("subsample", "split", "datetime", *_round("ret"))


#: Weights in SQL by moving weight between the pair of assets that gains most, 400 times; v has the settings' risk and pull.
_WEIGHTS = "WITH RECURSIVE " + _SPLITS.removeprefix("WITH ") + """, names AS (SELECT ticker, row_number() OVER (ORDER BY ticker) AS i FROM (SELECT DISTINCT ticker FROM complete)),
past AS MATERIALIZED (SELECT split, i, datetime, ret FROM complete JOIN names USING (ticker) JOIN r USING (datetime), s WHERE r >= split * 63 AND r < split * 63 + 126),
pairs AS (SELECT a.split, a.i, b.i AS j, covar_samp(a.ret, b.ret) AS c, avg(a.ret) AS m FROM past a JOIN past b USING (split, datetime) GROUP BY ALL),
lines AS (SELECT split, i, list(c ORDER BY j) AS c, any_value(m) AS m FROM pairs GROUP BY split, i),
cov AS MATERIALIZED (SELECT split, list(c ORDER BY i) AS c, list(m ORDER BY i) AS m, count(*)::INT AS n FROM lines GROUP BY split),
v(p, risk, pull) AS (VALUES (0, 1.0::DOUBLE, 0.0::DOUBLE), (1, 1.0::DOUBLE, 1.0::DOUBLE), (2, 2.0::DOUBLE, 1.0::DOUBLE)),
steps(split, p, k, w) AS (
  SELECT split, p, 0, list_transform(range(n), lambda x: 1.0::DOUBLE / n) FROM cov, v
  UNION ALL
  SELECT split, p, k + 1, list_transform(range(1, n + 1), lambda x: w[x] + CASE WHEN x = lo THEN t WHEN x = hi THEN -t ELSE 0 END) FROM (
    SELECT *, CASE WHEN hi = lo THEN 0 ELSE least(w[hi], greatest(0, (g[hi] - g[lo]) / (2 * risk * (c[hi][hi] + c[lo][lo] - 2 * c[hi][lo])))) END AS t FROM (
      SELECT *, list_sort(list_transform(list_filter(range(1, n + 1), lambda x: w[x] > 0), lambda x: struct_pack(g := -g[x], x := x)))[1].x AS hi, list_sort(list_transform(range(1, n + 1), lambda x: struct_pack(g := g[x], x := x)))[1].x AS lo FROM (
        SELECT split, p, k, w, c, m, n, risk, pull, list_transform(range(1, n + 1), lambda x: 2 * risk * list_dot_product(c[x], w) - pull * m[x]) AS g FROM steps JOIN cov USING (split) JOIN v USING (p) WHERE k < 400)))),
weights AS MATERIALIZED (SELECT split, p, ticker, w[i] AS weight FROM steps, names WHERE k = 400)"""


_GRID = _WEIGHTS + """, tested AS (SELECT split, p, datetime, sum(ret * weight) AS ret FROM complete JOIN r USING (datetime) JOIN weights USING (ticker) WHERE r >= split * 63 + 126 AND r < split * 63 + 189 GROUP BY ALL),
even AS (SELECT split, datetime, avg(ret) AS ret FROM complete JOIN r USING (datetime), s WHERE r >= split * 63 + 126 AND r < split * 63 + 189 GROUP BY ALL),
scores AS (SELECT 'MeanRisk' AS strategy, p - 1 AS param, split, avg(ret) / stddev_samp(ret) * sqrt(252) AS m FROM tested WHERE p > 0 GROUP BY ALL UNION ALL SELECT 'EqualWeighted', 0, split, avg(ret) / stddev_samp(ret) * sqrt(252) FROM even GROUP BY split)
SELECT strategy, param, round(avg(m), 4) AS score FROM scores GROUP BY strategy, param"""
register(_GRID)(portfolio_grid)


@register(_WEIGHTS + " SELECT split, p AS param, ticker, round(weight, 5) + 0.0 AS weight FROM weights")
def mean_variance_weights(spark, d):
    """Every window's weights of three settings: the least variance, and two risk aversions."""
    split = portfolio.split_returns(_returns(spark, d))
    got = portfolio.learned(split, [{}, {"risk_aversion": 1.0}, {"risk_aversion": 2.0}])
    return got.select("split", "param", "ticker", (F.round("weight", 5) + 0.0).alias("weight"))


@register(_SPLITS + " SELECT split, p::INT AS param, true AS feasible, true AS optimal FROM s, range(3) t(p)")
def mean_variance_optimal(spark, d):
    """Whether every window's weights of three mean-variance settings meet the conditions of an optimum."""
    returns = _returns(spark, d)
    return portfolio.optimal(portfolio.split_returns(returns), [{}, {"risk_aversion": 1.0}, {"risk_aversion": 2.0}])


@register(_SPLITS + " SELECT split, p::INT AS param, true AS feasible, true AS optimal FROM s, range(8) t(p)")
def frontier_optimal(spark, d):
    """The same for the least variance at each return of the frontier."""
    return portfolio.optimal(portfolio.split_returns(_returns(spark, d)), [{"min_return": r} for r in portfolio.levels()], slack=1e-3)


@register(_RET + """, e AS (SELECT datetime, avg(ret) AS ret FROM complete GROUP BY datetime), c AS (SELECT datetime, sum(ret) OVER (ORDER BY datetime) AS c FROM e)
SELECT 'EqualWeighted' AS strategy, datetime, round(c, 6) AS cumulative, round(greatest(max(c) OVER (ORDER BY datetime), 0) - c, 6) + 0.0 AS drawdown FROM c""")
def portfolio_curves(spark, d):
    got = portfolio.curves(portfolio.equal_weight(_returns(spark, d)).withColumn("strategy", F.lit("EqualWeighted")), ["strategy"])
    return got.select("strategy", "datetime", *_round("cumulative"), (F.round("drawdown", 6) + 0.0).alias("drawdown"))


@register(_RET + """, levels AS (SELECT i::INT AS point, (0.025 + i * (0.2 - 0.025) / 7) / 252 AS level FROM range(8) t(i)), means AS (SELECT ticker, avg(ret) AS m FROM complete GROUP BY ticker)
SELECT point, round(level, 12) AS level, count(*) FILTER (m >= level)::INT AS reached, round(max(m), 6) AS best FROM levels, means GROUP BY point, level""")
def frontier_levels(spark, d):
    """The least returns of a frontier, and how many assets' mean returns reach each."""
    means = _returns(spark, d).groupBy("ticker").agg(F.avg("ret").alias("m"))
    steps = F.explode(F.array(*(F.struct(F.lit(k).alias("point"), F.lit(r).alias("level")) for k, r in enumerate(portfolio.levels()))))
    rows = means.select("m", steps.alias("s")).select("m", "s.point", "s.level").groupBy("point", "level")
    got = rows.agg(F.count(F.when(F.col("m") >= F.col("level"), 1)).cast("int").alias("reached"), F.max("m").alias("best"))
    return got.select("point", F.round("level", 12).alias("level"), "reached", *_round("best"))


@register(_SPLITS + """, e AS (SELECT split, datetime, avg(ret) AS ret FROM complete JOIN r USING (datetime), s WHERE r >= split * 63 + 126 AND r < split * 63 + 189 GROUP BY split, datetime),
q AS (SELECT split, datetime, ret FROM complete JOIN r USING (datetime), s WHERE ticker = '1-URGENT' AND r >= split * 63 + 126 AND r < split * 63 + 189)
SELECT strategy, split, round(avg(ret) * 252, 4) AS annual_mean, round(stddev_samp(ret) * sqrt(252), 4) AS annual_std FROM (SELECT 'EqualWeighted' AS strategy, * FROM e UNION ALL SELECT 'Single', * FROM q) GROUP BY strategy, split""")
def portfolio_population(spark, d):
    """The journey of equal weights and one further portfolio, measured together."""
    lab = _lab(spark, d)
    lab.best = {"EqualWeighted": {"estimator": "equal"}}
    single = portfolio.split_returns(lab.returns).filter("role = 'test' and ticker = '1-URGENT'").select(F.lit("Single").alias("strategy"), "split", "datetime", "ret")
    got = portfolio.measures(lab.population(single), ["strategy", "split"])
    return got.select("strategy", "split", *_round("annual_mean", "annual_std", digits=4))


@register()
def frontier(spark, d):
    lab = _lab(spark, d)
    lab.best = {"MeanRisk": {"estimator": "mean_variance"}}
    return lab.frontier("MeanRisk")


# transformers, streams and plans


@register("WITH RECURSIVE " + _BARS.removeprefix("WITH ") + """, w(k, x) AS (SELECT 0, 1.0::DOUBLE UNION ALL SELECT k + 1, -x * (0.4::DOUBLE - k) / (k + 1) FROM w WHERE abs(-x * (0.4::DOUBLE - k) / (k + 1)) >= 0.01),
n AS (SELECT count(*) AS n FROM w), b AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY datetime) AS i FROM bars),
f AS (SELECT b.ticker, b.datetime, sum(w.x * c.open) AS o, sum(w.x * c.close) AS c FROM b, n, w JOIN b c ON true WHERE b.i >= n.n AND c.ticker = b.ticker AND c.i = b.i - n.n + 1 + w.k GROUP BY ALL)
SELECT b.ticker, b.datetime, round(f.o, 3) AS open_frac_diff, round(f.c, 3) AS close_frac_diff FROM b LEFT JOIN f USING (ticker, datetime)""")
def transform_columns(spark, d):
    """A transformer over several columns, saved and read again, in a pipeline."""
    from pyspark.ml import Pipeline, PipelineModel

    rows, path = B.daily_bars(spark, d), f"{_scratch(spark)}/pipeline"
    Pipeline(stages=[learning.FractionalDiff(inputCols=["open", "close"], threshold=1e-2)]).fit(rows).write().save(path)
    return PipelineModel.load(path).transform(rows).select("ticker", "datetime", *_round("open_frac_diff", "close_frac_diff", digits=3))


@register(f"WITH x AS ({_trend_sql()}), y AS ({_BARRIER} SELECT ticker, datetime, label, t1 FROM barrier) SELECT * FROM x JOIN y USING (ticker, datetime)")
def transform_stages(spark, d):
    """Trend scanning and barrier labels as stages of one pipeline."""
    from pyspark.ml import Pipeline

    rows = B.daily_bars(spark, d).withColumn("sl", 0.6 * F.col("close"))
    out = Pipeline(stages=[learning.TrendScanning(windows=_TREND_W), learning.TripleBarrier(stopCol="sl", multiple=0.5, horizon=10)]).fit(rows).transform(rows)
    return out.select("ticker", "datetime", *_round("trend_t", digits=4), "label", "t1")


@register(_accounts(on_close=True, finalize=False) + " SELECT ticker, tm AS datetime, units::BIGINT AS units, printf('%.5e', cash) AS cash FROM runs")
def stream_accounts(spark, d):
    """An account a ticker, kept as the state of a stream of signals."""
    at = _scratch(spark)
    rows = backtest.sma_cross().signals(B.daily_bars(spark, d)).withColumn("datetime", F.col("datetime").cast("timestamp"))
    rows.select("ticker", "datetime", "close", "signal").write.parquet(f"{at}/in")
    ingest.run_once(ingest.position_state(ingest.read(spark, f"{at}/in"), 1e7, (3.0, 0.001)), f"{at}/out", f"{at}/state")
    return spark.read.parquet(f"{at}/out").select("ticker", F.col("datetime").cast("timestamp_ntz").alias("datetime"), "units", F.format_string("%.5e", "cash").alias("cash"))



@register(_BARS + " SELECT ticker, datetime, close, volume FROM bars")
def stream_ingest(spark, d):
    """Daily bars, written twice, streamed back with each (ticker, datetime) once."""
    at = _scratch(spark)
    bars = B.daily_bars(spark, d).select("ticker", F.col("datetime").cast("timestamp"), "close", "volume")
    bars.union(bars).write.parquet(f"{at}/in")
    ingest.run_once(ingest.unique_bars(ingest.read(spark, f"{at}/in"), "10000 days"), f"{at}/out", f"{at}/state")
    return spark.read.parquet(f"{at}/out").select("ticker", F.col("datetime").cast("timestamp_ntz"), "close", "volume")


@register(_HOURS + ", late AS (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 HOUR AS mark FROM events) SELECT hours.* FROM hours, late WHERE datetime + INTERVAL 1 HOUR <= mark")
def stream_hourly(spark, d):
    """Ticks streamed into hour bars; hours that the watermark has not closed are still open."""
    at = _scratch(spark)
    ticks = ingest.read(spark, f"{d}/event[s].parquet")  # a pattern, as the table may be a single file
    ingest.run_once(ingest.hourly(ticks, "event_type", "ts", "value", ["ts", "event_id"]), f"{at}/out", f"{at}/state")
    return spark.read.parquet(f"{at}/out").withColumn("datetime", F.col("datetime").cast("timestamp_ntz"))


@register(_HOURS + ", bars AS (SELECT * FROM hours)" + _BARRIER.removeprefix(_BARS) + " SELECT ticker, datetime, label, t1 FROM barrier WHERE t1 <= (SELECT max(datetime) FROM bars) - INTERVAL 90 MINUTE")
def stream_labels(spark, d):
    """Barrier labels of hour bars that come as a stream; what the watermark has not decided is still open."""
    at = _scratch(spark)
    bars = B.hourly_bars(spark, d).select("ticker", F.col("datetime").cast("timestamp"), "close", (0.6 * F.col("close")).alias("sl"))
    bars.write.parquet(f"{at}/in")
    with stream_barriers.timers(spark):
        found = stream_barriers.triple_barrier(ingest.read(spark, f"{at}/in"), "close", "sl", 0.5, 10, "90 minutes")
        ingest.run_once(found, f"{at}/out", f"{at}/state")
    return spark.read.parquet(f"{at}/out").select("ticker", *(F.col(c).cast("timestamp_ntz").alias(c) for c in ("datetime", "t1")), "label")


@register(_BARS + f", m AS (SELECT ticker, datetime, CASE WHEN count(close) {_W} ROWS 19 PRECEDING) = 20 THEN round(avg(close) {_W} ROWS 19 PRECEDING), 4) END AS sma FROM bars) SELECT * FROM m WHERE ticker IN ('1-URGENT', '2-HIGH') AND datetime >= TIMESTAMP '1996-01-01' AND datetime < TIMESTAMP '1997-01-01'")
def padded_range(spark, d):
    """A year of two tickers' means, computed from only the bars that they depend on."""
    step = Step(lambda b: b.select("ticker", "datetime", F.round(windows.sma("close", 20), 4).alias("sma")), lookback=19)
    return query(B.daily_bars(spark, d), [step], ["1-URGENT", "2-HIGH"], CUT, datetime(1997, 1, 1))


@register(_BARS + f" SELECT ticker, datetime, CASE WHEN count(close) {_W} ROWS 19 PRECEDING) = 20 THEN round(avg(close) {_W} ROWS 19 PRECEDING), 4) END AS sma FROM bars")
def split_series(spark, d):
    """The same means with each series cut into overlapping pieces, as a very long one would be."""
    step = Step(lambda b: b.withColumn("sma", F.round(windows.sma("close", 20), 4)), lookback=19)
    return in_pieces(B.daily_bars(spark, d), step, size=250).select("ticker", "datetime", "sma")
