import re

import duckdb
import pytest

from tsqlspark import queries as Q

SF = "/root/testdata/sf0.001"


def _plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_against_duckdb(spark, name):
    sql = Q.oracle_sql()[name]
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in Q.TABLES:
        if re.search(rf"\b{t}\b", sql):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = Q.queries()[name](spark, SF)
    names = sorted(df.columns)
    mine = sorted(repr(tuple(map(_plain, r))) for r in df.select(*[f"`{n}`" for n in names]).collect())
    theirs = sorted(repr(tuple(map(_plain, r))) for r in con.sql(f"SELECT {', '.join(names)} FROM ({sql})").fetchall())
    assert mine == theirs
