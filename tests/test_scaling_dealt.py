"""Scaled pages meet their pixels where these are dealt by page."""

import re

import __spark_entry__ as entry


def test_pages_are_not_gathered_on_the_driver(spark):
    plan = entry.queries()["scaled_pages"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin [page_id" in plan and not re.search(r"BroadcastHashJoin \[page_id", plan)
    # pixels are dealt once, not by their targets or by a line's place
    assert not re.search(r"hashpartitioning\(page_id#\d+L?, (to_)?[yx]#", plan)
    assert not re.search(r"Exchange hashpartitioning\(\S*f#\d+\S*, [yx]#", plan)
