"""Every registered query against its SQL on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from tidemark import queries


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.sql(f"create view {f.split('.')[0]} as select * from '{sf}/{f}'")
    return con


def plain(frame: pd.DataFrame) -> list:
    out = frame[sorted(frame.columns)].copy()
    for c in out:
        if str(out[c].dtype).startswith("datetime"):
            out[c] = out[c].astype("datetime64[us]").astype(str)
        elif out[c].dtype.kind in "fiu":
            out[c] = out[c].astype(float).round(5) + 0.0
    return sorted(map(tuple, out.astype(object).where(out.notna(), None).astype(str).values.tolist()))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sf, db, name):
    got = queries.QUERIES[name](spark, sf).toPandas()
    if name not in queries.ORACLE:
        assert len(got) or name in ("frontier", "portfolio_grid")  # fewer complete days here than one training window
        return
    want = db.sql(queries.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


def test_entry_without_the_other_subpackage(monkeypatch):
    import sys

    for name in [n for n in sys.modules if n.startswith("tidemark.llm") or n in ("corpus_pipeline", "__spark_entry__")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "tidemark.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    import __spark_entry__ as entry

    assert entry.llm is None and set(entry.queries()) == set(queries.QUERIES)
    monkeypatch.delitem(sys.modules, "__spark_entry__")


def test_entry_does_not_hide_a_broken_subpackage(monkeypatch, tmp_path):
    import sys

    (tmp_path / "corpus_pipeline.py").write_text("import a_module_that_is_not_there\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    for name in [n for n in sys.modules if n in ("corpus_pipeline", "__spark_entry__")]:
        monkeypatch.delitem(sys.modules, name)
    with pytest.raises(ModuleNotFoundError, match="a_module_that_is_not_there"):
        import __spark_entry__  # noqa: F401
    sys.modules.pop("__spark_entry__", None)


def test_code_is_shipped_once(spark):
    import zipfile

    import __spark_entry__ as entry

    for _ in range(2):
        entry.queries()["list_tickers"](spark, "/root/testdata/sf0.001").collect()
    names = zipfile.ZipFile(spark.sparkContext._tidemark_code).namelist()
    assert "tidemark/__init__.py" in names and "tidemark/functions/windows.py" in names


def test_plans_push_filters_and_columns(spark, sf):
    plan = queries.scan_ticker(spark, sf)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(o_orderpriority), EqualTo(o_orderpriority,1-URGENT)]" in plan
    chain = queries.ichimoku(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert chain.count("Exchange hashpartitioning(ticker") <= 1
