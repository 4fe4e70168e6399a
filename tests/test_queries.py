"""Every registered query of the panel library runs; those with SQL give what DuckDB gives."""

import math
import os

import pytest

from panelweave.plans.registry import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if hasattr(v, "isoformat"):
        return v.isoformat()[:19].replace("T00:00:00", "")
    if isinstance(v, bool):
        return v
    return float(v) if isinstance(v, (int, float)) or hasattr(v, "as_integer_ratio") else v


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in found), key=str)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = df.columns, [tuple(r) for r in df.collect()]
    if name in SQL:
        cur = duck.execute(SQL[name])
        want = rows([d[0] for d in cur.description], cur.fetchall())
        have = rows(*got)
        assert have[0] == want[0]
        assert len(have[1]) == len(want[1])
        for a, b in zip(have[1], want[1]):
            assert a == pytest.approx(b, rel=1e-6, abs=2e-6) if all(isinstance(x, float) for x in a) else all(x == y or (isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-6, abs_tol=2e-6)) for x, y in zip(a, b))


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(QUERIES)
