import os

import pytest
from oracle import SF

import __spark_entry__


def test_every_oracle_has_a_query():
    assert __spark_entry__.oracle_sql().keys() <= __spark_entry__.queries().keys()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
def test_entry_gives_the_ledger(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["context_id", "stage_no", "stage", "items_before", "items_after", "tokens_before", "tokens_after"] and df.count() > 0
