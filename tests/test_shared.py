"""Tables that loops keep."""

from pageloom.operators import shared


def test_kept_tables_are_not_gathered_on_the_driver(spark):
    big = shared.kept(spark.range(0, 200000).selectExpr("id div 1000 as page_id", "cast(id % 2 as int) as label"))
    few = big.selectExpr("page_id", "label as other").distinct().filter("other = 0")
    plan = big.join(few, "page_id")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert big.join(few, "page_id", "left_semi").count() == 200000
    shared.dropped(big)
