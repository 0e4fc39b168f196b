"""The queries that SQL can express, against their SQL."""

import pytest

from compare import compare
from paperlake.llm.queries import ORACLES, QUERIES

from .conftest import SMALL


@pytest.mark.parametrize("name", list(ORACLES))
def test_query(spark, name):
    same, note = compare(spark, SMALL, name)
    assert same, note


def test_every_operator_has_one_query():
    numbers = sorted(int(name[2:].split("_")[0]) for name in QUERIES)
    assert numbers == list(range(1, 14)) and set(ORACLES) <= set(QUERIES)
