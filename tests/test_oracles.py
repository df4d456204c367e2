"""Every registered query that has SQL against it, on the smallest tables.

Queries without SQL are covered by the property tests of their operators.
"""

import pytest

import __spark_entry__ as entry
from checks.compare import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return connect(SF)


@pytest.mark.parametrize("name", entry.oracle_sql())
def test_query(spark, connection, name):
    problem = compare(spark, connection, name, entry.queries()[name], entry.oracle_sql()[name], SF)
    # The smallest fixture grid has four rows, so a few windows are empty on both sides.
    assert problem is None or (problem == "no rows" and name in ("a8_clip_geometry", "a8_clip", "c4_inset_layers", "b10_sample_grid"))


def test_entry(spark):
    frame = entry.entry(spark)
    assert frame.columns == ["grid_id", "layer", "elevation", "cells", "share"]
    assert frame.count() == 7
