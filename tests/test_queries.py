import os

import pytest
from oracle import SF, compare, database

from quillspark.plans import registry

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


@pytest.fixture(scope="module")
def db():
    return database()


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_agrees_with_sql(spark, db, name):
    compare(spark, registry.queries()[name], registry.oracle_sql()[name], db)


def test_context_for_finds_the_named_place_first(spark):
    rows = registry.queries()["graph_context_for"](spark, SF).collect()
    assert 0 < len(rows) <= 20 and rows[0].depth == 0


def test_the_flagship_is_registered():
    assert registry.FLAGSHIP in registry.queries()
