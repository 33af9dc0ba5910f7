"""Barrier labels of a stream against the batch labels."""

from datetime import timedelta

import pytest


from tidemark.functions import labels
from tidemark.streaming import ingest
from tidemark.streaming import labels as streamed

from .test_market import DAY, walk


@pytest.mark.parametrize("horizon", [1, 5])
def test_labels_over_several_runs_with_late_and_unordered_rows(spark, tmp_path, horizon):
    path = f"file://{tmp_path}"
    x = {t: walk(80, seed) for t, seed in (("A", 1), ("B", 2))}
    rows = [(t, DAY + timedelta(hours=i), c, None if i % 9 == 4 else 0.995 * c) for t, v in x.items() for i, c in enumerate(v)]
    kinds = "ticker string, datetime timestamp, close double, sl double"
    by = lambda test: [r for r in rows if test(int((r[1] - DAY).total_seconds() // 3600))]
    # hour 31 comes within the delay of two hours, hour 20 long after the watermark has passed it, hour 50 twice
    parts = [by(lambda i: i <= 32 and i not in (20, 31)), by(lambda i: i == 31) + by(lambda i: 33 <= i <= 60), by(lambda i: i == 20 or i == 50) + by(lambda i: i > 60)]
    got = []
    for part in parts:
        spark.createDataFrame(part[::-1], kinds).repartition(3).write.mode("append").parquet(f"{path}/in")
        with streamed.timers(spark):
            found = streamed.triple_barrier(ingest.read(spark, f"{path}/in"), "close", "sl", 1.0, horizon, "2 hours")
            ingest.run_once(found, f"{path}/out", f"{path}/state")
        got.append({(r.ticker, r.datetime): (r.label, r.t1) for r in spark.read.parquet(f"{path}/out").collect()})
    known = spark.createDataFrame([r for r in rows if r[1] != DAY + timedelta(hours=20)], kinds)
    batch = {(r.ticker, r.datetime): (r.label, r.t1) for r in labels.triple_barrier(known, "close", "sl", 1.0, horizon).filter("label is not null").collect()}
    for last, out in zip((32, 60, 79), got):
        assert out == {k: v for k, v in batch.items() if v[1] <= DAY + timedelta(hours=last - 2)}
    assert {v[0] for v in got[-1].values()} >= ({0, 2} if horizon == 5 else {1}) and all(len(a) < len(b) for a, b in zip(got, got[1:]))


def test_bars_without_a_price_are_left_out(spark, tmp_path):
    path = f"file://{tmp_path}"
    rows = [("A", DAY + timedelta(hours=i), None if i == 2 else 10.0, 1.0) for i in range(9)]
    spark.createDataFrame(rows, "ticker string, datetime timestamp, close double, sl double").write.parquet(f"{path}/in")
    with streamed.timers(spark):
        ingest.run_once(streamed.triple_barrier(ingest.read(spark, f"{path}/in"), horizon=3, delay="1 hour"), f"{path}/out", f"{path}/state")
    got = {r.datetime: (r.label, r.t1) for r in spark.read.parquet(f"{path}/out").collect()}
    at = lambda i: DAY + timedelta(hours=i)
    assert got == {at(0): (1, at(4)), at(1): (1, at(5)), at(3): (1, at(6)), at(4): (1, at(7))}
