"""Every query that has SQL gives the SQL's rows; the others give rows with a stable schema."""

import math

import duckdb
import pytest

from weirgate.queries import ORACLE_SQL, QUERIES


def plain(df):
    df = df[sorted(df.columns)].astype(object)

    def value(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "NULL"
        return v if isinstance(v, (bool, int)) else round(v, 6) if isinstance(v, float) else str(v)

    return sorted(df.columns), sorted((tuple(map(value, r)) for r in df.itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    for t in "events documents pages conversations".split():
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, duck, name):
    got = QUERIES[name](spark, small).toPandas()
    if name in ORACLE_SQL:
        assert plain(got) == plain(duck.sql(ORACLE_SQL[name]).df())
    else:
        assert len(got.columns) > 1
