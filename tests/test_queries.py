"""Every query that has an oracle against DuckDB over the smallest tables."""

import duckdb
import pytest

from nomenspark import corpus, plans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in corpus.BASE:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return tuple(plain(x) for x in v) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", plans.oracle_sql())
def test_query_equals_oracle(spark, duck, name):
    df = plans.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(x) for x in r) for r in df.select(*columns).collect()), key=repr)
    out = duck.execute(plans.oracle_sql()[name])
    at = [c[0] for c in out.description]
    want = sorted((tuple(plain(r[at.index(c)]) for c in columns) for r in out.fetchall()), key=repr)
    assert sorted(at) == columns and got == want


def test_derived_tables_agree(spark, duck):
    for name in corpus.TABLES:
        got = sorted(map(tuple, corpus.table(spark, SF, name).collect()), key=repr)
        assert got == sorted(duck.execute(corpus.with_tables(name) + f"SELECT * FROM {name}").fetchall(), key=repr), name


def test_interval_lift_against_two_points(spark):
    rows = plans.queries()["u2_lift_intervals"](spark, SF).collect()
    assert {r.status for r in rows} >= {"success", "partial", "no_chain", "split"}
    assert all((r.lo is not None and r.lo <= r.hi) == (r.status == "success") for r in rows)
    assert all((r.fraction == 0.5) == (r.status == "partial") for r in rows)
