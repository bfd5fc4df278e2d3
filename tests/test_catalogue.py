"""Every query with SQL gives the same rows as DuckDB."""

import duckdb
import pytest

from claimloom.plans import catalogue, kernel, records, relations, terms, upkeep  # noqa: F401  (the others add their queries to the catalogue)

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS FROM '{sf}/{t}.parquet'")
    return c


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(map(str, ([None if x != x else (round(x, 6) if isinstance(x, float) else x) for x in r] for r in frame.astype(object).itertuples(index=False, name=None))))


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_same_as_sql(spark, sf, duck, name):
    mine, theirs = catalogue.QUERIES[name](spark, sf).toPandas(), duck.sql(catalogue.SQL[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert len(mine) == len(theirs)
    plain = lambda f: rows(f.map(lambda x: float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x))
    assert plain(mine) == plain(theirs)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
