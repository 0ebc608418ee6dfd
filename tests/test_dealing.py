"""Queries that deal their rows by key once, before they are taken apart, shuffle nothing by that key again."""

import re

import pytest

import __spark_entry__ as entry

DEALT = {"harvest_by_rules": "doc_id", "table_grid": "table_id", "binarize_ladder": "page_id"}


@pytest.mark.parametrize("name", DEALT)
def test_dealt_once(spark, name):
    plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan
    assert not re.search(rf"hashpartitioning\({DEALT[name]}\W.*ENSURE_REQUIREMENTS", plan)
