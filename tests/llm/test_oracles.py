import os

import pytest
from oracle import SF, compare, database

from quillspark.llm.oracles import ORACLES
from quillspark.llm.queries import QUERIES

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, name):
    compare(spark, QUERIES[name], ORACLES[name], database())


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLES.keys()))
def test_query_gives_a_row_for_each_row(spark, name):
    pages = name == "op4_html_text"
    df = QUERIES[name](spark, SF)
    n = spark.read.parquet(f"{SF}/{'pages' if pages else 'documents'}.parquet").count()
    key = "page_id" if pages else "doc_id"
    assert df.select(key).distinct().count() == n
