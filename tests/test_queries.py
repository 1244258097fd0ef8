"""Every query of the library against its SQL in DuckDB, over the smallest tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

from plumeria.plans.catalog import ORACLE_SQL, QUERIES

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="the driver's tables aren't here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in SF.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    """A value that compares the same from either engine."""
    if value is None:
        return ("", "null")
    if isinstance(value, bool):
        return ("b", value)
    if isinstance(value, (list, tuple)):
        return ("l", tuple(map(plain, value)))
    if isinstance(value, str):
        return ("s", value)
    if hasattr(value, "isoformat"):
        return ("t", value.isoformat())
    if isinstance(value, float) and math.isnan(value):
        return ("n", "nan")
    return ("n", round(float(value), 6))


def rows(columns, found):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(plain(row[i]) for i in order) for row in found), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    found = QUERIES[name](spark, str(SF))
    got = rows(found.columns, found.collect())
    if name not in ORACLE_SQL:
        assert got
        return
    cursor = duck.execute(ORACLE_SQL[name])
    columns = [x[0] for x in cursor.description]
    assert sorted(found.columns) == sorted(columns)
    want = rows(columns, cursor.fetchall())
    assert len(got) == len(want)
    near = [a for a, b in zip(got, want, strict=True) if a != b]
    assert not near or all(
        x[1] == y[1] or isinstance(x[1], float) and isinstance(y[1], float) and abs(x[1] - y[1]) <= 2e-6 * max(1, abs(y[1]))
        for a, b in zip(got, want, strict=True)
        for x, y in zip(a, b, strict=True)
    )
