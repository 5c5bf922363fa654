"""Every query that SQL can express gives what its SQL gives; the others give rows."""

from __future__ import annotations

import pytest

from cairn.plans import answers, dialogue, ingest, relational, search, stateful, text
from tests.conftest import SF
from tests.oracle import assert_same

PLANS = (relational, text, answers, dialogue, stateful, search, ingest)
QUERIES = {name: q for plan in PLANS for name, q in plan.QUERIES.items()}
SQL = {name: q for plan in PLANS for name, q in plan.SQL.items()}


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, name):
    assert_same(QUERIES[name](spark, SF), SQL[name], SF)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
