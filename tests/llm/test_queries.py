"""Registered queries against their SQL on the smallest tables; each operator on an empty table."""

import pytest

from commentguard.llm.queries import QUERIES
from commentguard.llm.sql import ORACLES
from tests.oracle_check import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    got, want, *_ = compare(spark, connect(SF), SF, name, QUERIES[name], ORACLES[name])
    assert got == want


@pytest.fixture(scope="module")
def empty_tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("empty")
    for name in ("documents", "pages", "benchmark", "labels"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables_give_no_rows(spark, empty_tables, name):
    assert QUERIES[name](spark, empty_tables).collect() == []


def test_each_operator_has_one_query():
    assert sorted(n.split("_")[0] for n in QUERIES) == sorted(f"op{k}" for k in range(1, 14))
