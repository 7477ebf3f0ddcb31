"""Every registered query that has SQL gives the rows that DuckDB gives."""

import math
from pathlib import Path

import duckdb
import pytest

from quire.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    if isinstance(x, bool) or x is None:
        return str(x)
    if isinstance(x, (int, float)) or hasattr(x, "as_tuple"):
        return "nan" if isinstance(x, float) and math.isnan(x) else f"{float(x):.6f}"
    return x.isoformat() if hasattr(x, "isoformat") else str(x)


def rows(found, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(str(plain(r[k])) for k in order) for r in found)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_same_rows_as_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    result = duck.execute(catalogue.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.collect(), df.columns) == rows(result.fetchall(), columns)


def test_nothing_but_the_entry_knows_the_training_data_package():
    root = Path(catalogue.__file__).resolve().parents[1]
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert "quire.llm" not in f.read_text() and "from .llm" not in f.read_text() and "..llm" not in f.read_text()


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_queries_without_sql_run(spark, name):
    assert catalogue.queries()[name](spark, SF).count() > 0
