"""Every registered query runs; those with a SQL twin return its rows."""

import pytest

import __spark_entry__
from specblock.plans import registry
from tests.oracle import connect, rows_of, sql_rows


@pytest.fixture(scope="module")
def sf_dir():
    """Large enough that every query has rows: pairs of pixel images need two of them."""
    return "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_twin(name, spark, sf_dir, con):
    columns, rows = rows_of(registry.QUERIES[name](spark, sf_dir))
    assert rows, "a query over these tables has rows"
    assert rows == sql_rows(con, registry.ORACLE_SQL[name], columns)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs(name, spark, sf_dir):
    assert registry.QUERIES[name](spark, sf_dir).count() > 0


def test_contract(spark):
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0


def test_core_does_not_know_the_optional_package():
    import pathlib

    root = pathlib.Path(registry.__file__).parents[1]
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "specblock.llm" not in path.read_text(), path
