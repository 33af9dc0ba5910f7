import os

import duckdb
import pytest
import xxhash

from tidemark.llm import oracles
from tidemark.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_against_sql(spark, sf, name):
    db = duckdb.connect()
    for f in os.listdir(sf):
        db.sql(f"create view {f.split('.')[0]} as select * from '{sf}/{f}'")
    got, want = QUERIES[name](spark, sf), db.sql(ORACLE[name])
    assert sorted(got.columns) == sorted(want.columns)
    at = [want.columns.index(c) for c in got.columns]
    assert sorted(map(tuple, got.collect()), key=str) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=str)


def test_xxh64_in_sql():
    texts = ["", "a", "abcd", "abcdefgh", "abcdefghijk", "xyz" * 11, "h\u00e9\u00e9 " * 30, "q" * 32, "w" * 39]
    db = duckdb.connect()
    db.execute("create table kinds as select unnest(?) as s", [texts])
    got = dict(db.sql(f"WITH RECURSIVE {oracles.xxh64('kinds')} SELECT s, h FROM hashed").fetchall())
    assert got == {t: xxhash.xxh64_intdigest(t.encode(), 42) for t in texts}
