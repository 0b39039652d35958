"""Every registered query against its SQL, on the smallest tables."""

import compare
import pytest

import __spark_entry__ as contract
from sensorloom.plans import catalog


@pytest.fixture(scope="module")
def duck(sf):
    return compare.connect(sf)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, sf, name):
    _, problem = compare.check(spark, duck, name, catalog.QUERIES[name], sf)
    assert problem is None, problem


def test_contract(spark):
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert contract.entry(spark).columns[0] == "key"


def test_inventory_is_covered():
    """Every operator id of the inventory is named by a query."""
    covered = {i for e in catalog.QUERIES.values() for i in e.operators.split()}
    skip = {"A": (5, 9), "B": (6, 24), "C": (11,), "F": (10,), "M": (4,)}
    last = {"A": 12, "B": 25, "C": 12, "D": 19, "E": 11, "F": 12, "G": 6, "H": 10, "I": 10, "J": 8, "K": 8, "L": 9, "M": 17}
    wanted = {f"{g}{i}" for g, n in last.items() for i in range(1, n + 1) if i not in skip.get(g, ())} | {"B5b"}
    assert wanted - covered == set()
