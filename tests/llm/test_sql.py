"""Queries that SQL can express, over the whole tables."""

import pytest

from loomline.llm import queries
from tests.llm.support import same_as_sql

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, name):
    assert same_as_sql(queries.QUERIES[name](spark, SF).toPandas(), queries.ORACLES[name], SF) is None


@pytest.mark.parametrize("name", ["op1_language_id", "op7_quality", "op8_pieces"])
def test_one_row_per_document(spark, name):
    assert queries.QUERIES[name](spark, SF).count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_pages_are_identified(spark):
    got = queries.QUERIES["language_of_pages"](spark, SF)
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    assert got.count() == pages.count() and got.where("accepted").count() > 0.9 * pages.count()
