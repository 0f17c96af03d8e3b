"""Every registered query against its SQL counterpart on the smallest data."""

import datetime as dt
import math

import duckdb
import pytest

from sluice import plans

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
QUERIES, SQL = plans.queries(), plans.oracle_sql()


@pytest.fixture(scope="module")
def db(data_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    return v


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return a == pytest.approx(b, rel=1e-9, abs=2e-6)
    return a == b


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data_dir, db, name):
    got = QUERIES[name](spark, data_dir)
    rows = [tuple(map(plain, r)) for r in got.collect()]
    assert rows, "a query that returns nothing checks nothing"
    if name not in SQL:
        return
    cursor = db.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    wanted = [tuple(map(plain, r)) for r in cursor.fetchall()]
    assert sorted(names) == sorted(got.columns)
    place = [got.columns.index(n) for n in names]
    left = sorted((tuple(r[i] for i in place) for r in rows), key=_sort_key)
    right = sorted(wanted, key=_sort_key)
    assert len(left) == len(right)
    for a, b in zip(left, right):
        assert all(same(x, y) for x, y in zip(a, b)), (a, b)


def _sort_key(row):
    return tuple((v is None, str(type(v)) if v is None else "", repr(round(v, 4)) if isinstance(v, float) else repr(v)) for v in row)


def test_every_survey_line_has_a_query():
    wanted = {f"A{i}" for i in range(1, 11)} | {f"B{i}" for i in range(1, 8)} | {f"C{i}" for i in range(1, 20)}
    wanted |= {f"D{i}" for i in range(1, 23)} | {f"E{i}" for i in range(1, 12)} | {f"F{i}" for i in range(1, 12)}
    wanted |= {f"G{i}" for i in range(1, 11)} | {f"H{i}" for i in range(1, 7)} | {f"I{i}" for i in range(1, 15)}
    wanted |= {f"J{i}" for i in range(1, 9)} | {f"K{i}" for i in range(1, 10)} | {f"L{i}" for i in range(1, 5)}
    assert wanted - set(plans.survey_ids().values()) == set()
