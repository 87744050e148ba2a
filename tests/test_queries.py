"""Each query of the registry against its DuckDB SQL on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from fluvial.plans import registry
from tests.conftest import SF


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return c


def plain(rows):
    def cell(v):
        if isinstance(v, float):
            return None if math.isnan(v) else v + 0.0
        return str(v) if v is not None and not isinstance(v, (int, bool, str)) else v

    return sorted((tuple(cell(v) for v in r) for r in rows), key=lambda r: repr([f"{v:.9g}" if isinstance(v, float) else v for v in r]))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    got = df.collect()
    if name not in registry.ORACLE:
        assert got
        return
    cur = con.execute(registry.ORACLE[name])
    columns = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(columns)
    want = cur.fetchall()
    got = [tuple(r[c] for c in columns) for r in got]
    assert len(got) == len(want)
    a, b = plain(got), plain(want)
    assert all(x == y or all(p == q or isinstance(p, float) and isinstance(q, float) and abs(p - q) <= 1e-9 * max(1, abs(q)) for p, q in zip(x, y)) for x, y in zip(a, b))


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and "kge" in df.columns
