"""Every registered query of the library against its DuckDB SQL on the smallest tables."""

import os

import duckdb
import pytest

from vellum import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if x is None:
        return "null"
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, (int, float)) or type(x).__name__ == "Decimal":
        return f"{float(x):.6g}"
    return "[" + ",".join(map(plain, x)) + "]" if isinstance(x, (list, tuple)) else str(x)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_oracle(name, spark, sf, duck):
    df = catalog.queries()[name](spark, sf)
    columns = sorted(df.columns)
    found = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    assert name in catalog.oracle_sql()
    result = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    assert found == sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall())
