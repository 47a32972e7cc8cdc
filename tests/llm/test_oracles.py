"""Queries that SQL can express, against that SQL over whole tables."""

import pytest
from oracle import compare

from quillspark.llm.oracle import ORACLE
from quillspark.llm.queries import QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, sf_dir, name):
    compare(spark, sf_dir, QUERIES[name], ORACLE[name])


def test_each_operator_has_its_query():
    assert {n.split("_")[0] for n in QUERIES} == {"pipeline", *(f"op{i}" for i in range(1, 14))}
