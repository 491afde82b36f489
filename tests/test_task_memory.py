"""Partitions grow with the rows, so that the memory of a task does not."""

from __future__ import annotations

import pytest

from readloom.operators import grouping
from readloom.plans import governance, record_queries


@pytest.fixture
def small_tables(spark, tmp_path):
    spark.range(300).selectExpr("id div 3 as l_orderkey", "cast(id % 3 + 1 as int) as l_linenumber", "id as l_partkey", "id % 7 as l_suppkey", "if(id % 2 = 0, 'R', 'N') as l_returnflag").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(100).selectExpr("id as o_orderkey", "cast(id as double) as o_totalprice").write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(5).selectExpr("id as r_regionkey").write.parquet(f"{tmp_path}/region.parquet")
    return str(tmp_path)


def test_order_checks_are_dealt_out(spark, small_tables, monkeypatch):
    monkeypatch.setattr(grouping, "TASK_ROWS", 10)
    found = record_queries.order_checks(spark, small_tables)
    assert found.rdd.getNumPartitions() == 30 and found.count() == found.filter("n = 3 and contiguous and sorted").count() == 100


def test_substitution_is_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(grouping, "TASK_ROWS", 10)
    rows = spark.range(60).selectExpr("id div 2 as unit", "id as v")
    found = governance.verified_substitution(rows, rows, rows.filter("unit % 2 = 0"), "unit")
    assert found.rdd.getNumPartitions() >= 12 and found.exceptAll(rows).isEmpty() and found.count() == 60
    with pytest.raises(ValueError, match="differs"):
        governance.verified_substitution(rows, rows.filter("v != 8"), rows.filter("unit % 2 = 0"), "unit")


def test_summary_of_a_pack_is_made_once(spark, small_tables, monkeypatch):
    monkeypatch.setattr(grouping, "TASK_ROWS", 10)
    written, own = [], record_queries.materialize
    monkeypatch.setattr(record_queries, "materialize", lambda df, tag: written.append(tag) or own(df, tag))
    found = record_queries.pack_plan(spark, small_tables).collect()
    assert written == ["supported"] and len(found) == 6
    assert record_queries.query_summary(spark, small_tables).rdd.getNumPartitions() == 30
