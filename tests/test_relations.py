"""How words and pixels are dealt to tasks."""

from pyspark.sql import functions as F

from pageloom.plans import relations


def tasks(df):
    return df.select(F.spark_partition_id().alias("p")).distinct().count()


def test_tasks_grow_with_the_input(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"a{i} b\nc", 6) for i in range(200)], "doc_id long, text string, n_chars long").unionByName(spark.createDataFrame([(200, None, None)], "doc_id long, text string, n_chars long"))
    monkeypatch.setattr(relations, "CHARACTERS", 100, raising=False)
    monkeypatch.setattr(relations, "PIXELS", 20 * relations.WIDTH * relations.HEIGHT, raising=False)
    assert tasks(relations.words(docs)) == 12  # 1200 characters
    assert 8 <= tasks(relations.page_rows(docs)) <= 11 and 8 <= tasks(relations.pixels(docs)) <= 11  # 201 pages
    assert relations.words(docs).count() == 600 and relations.pixels(docs).count() == 201 * relations.WIDTH * relations.HEIGHT
    assert relations.words(docs.limit(0)).count() == relations.pixels(docs.limit(0)).count() == 0


def test_words_of_texts_without_their_lengths(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"a{i} b\nc") for i in range(200)] + [(200, None)], "doc_id long, text string")
    monkeypatch.setattr(relations, "CHARACTERS", 100)
    assert tasks(relations.words(docs)) == 15  # 1490 characters
    assert relations.words(docs).count() == 600
