"""Every registered query against its SQL counterpart, at the smallest scale."""

import os
import subprocess
import sys

import pytest

from check import compare, connect
from evalweave.plans.catalog import ORACLES, QUERIES

# At the smallest scale no task has what these two queries look for.
EMPTY_AT_SMALLEST = {"task_intersection"}


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, sf_dir, name):
    if name in ORACLES:
        problem = compare(con, spark, sf_dir, QUERIES[name], ORACLES[name])
        assert problem is None or (problem == "no rows" and name in EMPTY_AT_SMALLEST)
    else:
        assert QUERIES[name](spark, sf_dir).count() > 0


def test_without_the_libraries_of_the_subpackage():
    """The other queries are there where a library that the training-data operators need is not."""
    code = "import sys; sys.modules['public_tokenizers'] = None; import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries())"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, check=True).stdout.split()
    assert out == [str(len(QUERIES)), "False"]


def test_contract(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
