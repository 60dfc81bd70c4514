"""Every registered query of the catalogue against its SQL."""

from __future__ import annotations

import os

import oracle
import pytest

from weftwork.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables aren't there")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, con, name):
    assert oracle.mismatch(QUERIES[name](spark, SF), SQL[name], con) is None


def test_random_order_keeps_rows(spark):
    assert QUERIES["sort_random"](spark, SF).count() == 10
