"""Every registered query against its SQL, on the smallest scale."""

from __future__ import annotations

from pathlib import Path

import check_oracle
import pytest

from quireflow.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    if not Path(SF).exists():
        pytest.skip("no test data")
    return check_oracle.duck(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    ok, note = check_oracle.compare(spark, con, SF, name)
    assert ok, note


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
