"""Every registered query against its SQL oracle at the smallest scale."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), "..", "tools"))

import __spark_entry__ as entry
from check import compare, oracle_connection

ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def oracle(sf_dir):
    return oracle_connection(sf_dir)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_matches_oracle(spark, oracle, sf_dir, name):
    ok, message = compare(spark, oracle, entry.queries()[name], ORACLES.get(name), sf_dir)
    assert ok, message


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).columns == ["chain_id", "n_matches"]
