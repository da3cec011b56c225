import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import oracle  # noqa: E402

from lodestream.llm import queries  # noqa: E402

QUERIES, ORACLES = queries.queries(), queries.oracles()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_its_oracle(spark, name):
    oracle.compare(spark, oracle.connect(), QUERIES[name], ORACLES[name])
