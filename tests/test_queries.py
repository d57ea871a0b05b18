"""Every core query on the small tables, against SQL where there is some."""

from __future__ import annotations

from pathlib import Path

import pytest

from fluxloom.plans import registry

duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def sql(sf_dir):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for f in Path(sf_dir).glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def rows(columns, records):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    plain = lambda v: round(float(v), 3) if isinstance(v, (int, float)) and not isinstance(v, bool) else v if v is None else str(v)
    return sorted((tuple(plain(r[k]) for k in order) for r in records), key=str)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_against_sql(spark, sf_dir, sql, name):
    df = registry.QUERIES[name](spark, sf_dir)
    want = sql.sql(registry.ORACLE_SQL[name])
    got, ref = rows(df.columns, [tuple(r) for r in df.collect()]), rows(want.columns, want.fetchall())
    assert sorted(df.columns) == sorted(want.columns) and len(got) == len(ref)
    for a, b in zip(got, ref):
        assert all(x == y or (isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 2e-3 + 1e-9 * abs(y)) for x, y in zip(a, b)), (a, b)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs(spark, sf_dir, name):
    df = registry.QUERIES[name](spark, sf_dir)
    assert df.columns and df.count() >= 0
