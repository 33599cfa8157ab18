"""Every registered query with SQL gives DuckDB's rows and types."""

import duckdb
import pytest

from stowage import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def tidy(rows):
    rounded = [tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in rows]
    return sorted(rounded, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_matches_sql(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = [tuple(r) for r in df.select(*cols).collect()]
    listed = ", ".join(f'"{c}"' for c in cols)
    q = con.execute(f"select {listed} from ({catalog.ORACLES[name]})")
    assert [TYPES[dict(df.dtypes)[c]] for c in cols] == [str(x[1]) for x in q.description]
    assert tidy(got) == tidy(q.fetchall())


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)
