import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
import __spark_entry__ as entry
from compare import assert_same, connected

from panelspark.plans import PLANS

SMALL = "/root/testdata/sf0.001"
QUERIES = {k: v for plan in PLANS for k, v in plan.QUERIES.items()}
ORACLE = {k: v for plan in PLANS for k, v in plan.ORACLE.items()}


@pytest.fixture(scope="module")
def tables():
    return connected(SMALL)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, tables, name):
    assert_same(QUERIES[name](spark, SMALL), tables, ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_runs(spark, name):
    """Their results are compared with slow versions in test_by_force."""
    assert QUERIES[name](spark, SMALL).count() > 0


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_is_registered():
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())
