"""Every registered query against its SQL, on whole tables."""

from __future__ import annotations

import pytest
from compare import connect, differences

import __spark_entry__ as entry
from siltgate import catalog

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", catalog.queries())
def test_query_agrees_with_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF_DIR)
    assert differences(df, duck, entry.oracle_sql()[name]) == []


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
