"""Words beside each other."""

import re

import __spark_entry__ as entry


def test_words_meet_their_neighbours_where_they_lie(spark, tmp_path):
    docs = [(1, "ab c  d e\n\nf"), (2, None), (None, "g h"), (3, "i j")]
    spark.createDataFrame([(i, t, len(t or "")) for i, t in docs], "doc_id long, text string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    df = entry.queries()["neighbour_boxes"](spark, str(tmp_path))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and not re.search(r"ENSURE_REQUIREMENTS|Join", plan)
    got = df.select("doc_id", "line_idx", "word_idx", "both_json").collect()
    assert sorted(map(tuple, got)) == [(1, 0, 0, "[0,0,40,20]"), (1, 0, 3, "[60,0,90,20]"), (3, 0, 0, "[0,0,30,20]")]
