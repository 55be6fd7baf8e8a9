"""Every registered query of the library against its SQL twin, on the smallest tables."""

import duckdb
import pytest

from textloom.plans.catalog import FLAGSHIP, ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def _shown(v):
    if isinstance(v, float):
        return f"{v:.8g}"
    if isinstance(v, list | tuple):
        return [_shown(x) for x in v]
    return str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    rows = df.collect()
    assert len(set(df.columns)) == len(df.columns)
    if name in ORACLE_SQL:
        cur = duck.execute(ORACLE_SQL[name])
        columns = [c[0] for c in cur.description]
        assert sorted(df.columns) == sorted(columns)
        want = sorted([str([_shown(r[columns.index(c)]) for c in sorted(columns)]) for r in cur.fetchall()])
        assert sorted(str([_shown(r[c]) for c in sorted(columns)]) for r in rows) == want


def test_flagship_is_registered():
    assert FLAGSHIP in QUERIES
