"""Every registered query that has SQL gives that SQL's rows."""
import math

import duckdb
import pytest

from evigrid import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if hasattr(v, "asDict"):
        return plain(tuple(v))
    if isinstance(v, float):
        return None if math.isnan(v) else int(v) if v.is_integer() else round(v, 8)
    if hasattr(v, "isoformat"):
        return str(v)[:19]
    if type(v).__name__ == "Decimal":
        return plain(float(v))
    return v


@pytest.fixture(scope="session")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{data}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_equals_sql(spark, duck, data, name):
    df = registry.QUERIES[name](spark, data)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in cols)) for r in df.collect())
    cur = duck.execute(registry.ORACLE[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == sorted(repr(tuple(plain(r[i]) for i in at)) for r in cur.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_runs(spark, data, name):
    assert registry.QUERIES[name](spark, data).count() > 0


def test_entry_imports():
    import __spark_entry__ as e

    assert "review_flow" in e.queries() and set(e.oracle_sql()) <= set(e.queries())
