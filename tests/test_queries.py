"""Every query of the engine against its SQL in DuckDB, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from tomeforge.plans import registry

SF = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not SF.exists(), reason="the driver's tables aren't here")


def plain(x):
    if isinstance(x, float):
        return f"{x:.6g}"
    return "null" if x is None else f"{float(x):.6g}" if type(x).__name__ == "Decimal" else str(x)


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(v[i]) for i in order) for v in values)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    found = registry.queries()[name](spark, str(SF))
    got = rows(found.columns, found.collect())
    if sql := registry.oracle_sql().get(name):
        answer = duck.execute(sql)
        names = [d[0] for d in answer.description]
        assert sorted(names) == sorted(found.columns)
        assert got == rows(names, answer.fetchall())
    else:
        assert got


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_cross_engine_rest_does_not_import_llm():
    root = Path(registry.__file__).resolve().parents[1]
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "tomeforge.llm" not in path.read_text()
