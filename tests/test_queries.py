"""Each registered query against its SQL, on the small tables."""

import math
import os
from decimal import Decimal

import duckdb
import pytest

from quire import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, Decimal):
        return float(x)
    if isinstance(x, float) and math.isfinite(x):
        return round(x, 6)
    return [plain(y) for y in x] if isinstance(x, list) else x


def rows(names, data):
    at = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted((repr([plain(r[i]) for i in at]) for r in data))


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_as_sql(spark, db, name):
    df = registry.QUERIES[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cursor = db.execute(registry.ORACLE_SQL[name])
    want = rows([d[0] for d in cursor.description], cursor.fetchall())
    assert got[0] == want[0]
    assert got[1] == want[1]
    assert got[1]


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0
