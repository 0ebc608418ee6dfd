"""The trend of word sizes, by hand."""

from pageloom.operators import document


def trend(spark, *words):
    rows = spark.createDataFrame([(1, t, 0, w) for t, w in words], "doc_id int, t int, l int, r int")
    return [tuple(r)[1:] for r in document.trend(rows).collect()]


def test_halfway_values_are_lifted(spark):
    assert trend(spark, (0, 9), (128, 0)) == [(-0.070312, 1.0, True)]  # -0.0703125
    assert trend(spark, (0, 0), (128, 5)) == [(0.039063, 1.0, True)]  # 0.0390625


def test_one_size_and_one_height(spark):
    assert trend(spark, (0, 7), (24, 7), (72, 7)) == [(0.0, 1.0, True)]
    assert trend(spark, (24, 7), (24, 9)) == [] and trend(spark, (24, 7)) == []
