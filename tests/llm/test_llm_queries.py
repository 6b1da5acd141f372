"""The registered queries against their DuckDB SQL, and what guards them."""

import os

import pytest
from compare import compare, duck

import __spark_entry__ as entry
from bellwether.llm.oracle import ORACLE
from bellwether.llm.queries import QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, name):
    same, note = compare(spark, duck(SF_DIR), name, SF_DIR)
    assert same, note


def test_registry():
    numbers = {name.split("_")[0] for name in QUERIES}
    assert numbers == {f"op{n}" for n in range(1, 14)} and len(QUERIES) == 13
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
    assert set(ORACLE) <= set(entry.oracle_sql()) and set(ORACLE) <= set(QUERIES)
