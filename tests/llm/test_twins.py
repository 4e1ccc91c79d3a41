"""Registered queries beside their SQL."""

import pytest

from layerweave.llm.queries import ORACLES, QUERIES
from tests.compare import compare, connect


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql_twin(spark, folder, name):
    expected = connect(folder).sql(ORACLES[name]).df()
    assert compare(QUERIES[name](spark, folder).toPandas(), expected) is None


def test_every_operator_is_registered():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
