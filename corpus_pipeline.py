"""The corpus pipeline: language, toxicity, near duplicates, repeated passages, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows of ``docs``;
``run`` writes what a stage returns as Parquet and reads it again as the next
stage's ``docs``.  All stages but the last return the columns of documents.

Rows, in every stage: null ids, languages and sources are carried along as
they are; repeated rows are judged alike, each by itself, and are kept or go
together, but that repeated passages count once for rows of one id; ties in
near duplicates go to the smaller id; columns of other names than those of
documents are not carried, whatever their names; an empty table gives an empty
table.  Null and empty texts go in the first stage (they are in no language);
a later stage that is handed some keeps them, and packing gives them their
closing id alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.llm import common, langid, neardup, packing, queries, suffix, toxicity

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents in no language (null text, or no letter); the others get the language found.

    A very long text is judged as a whole.  No other row is rejected.
    """
    model = langid.fit(common.table(spark, sf_dir, "documents"))
    found = langid.identify(docs.select(*COLUMNS), model).filter("lang_pred <> 'und'")
    return found.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose toxicity is at least 0.5.

    A null or empty text has the score of no evidence, far below, and stays.
    """
    model = toxicity.fit(common.table(spark, sf_dir, "documents").select("doc_id", "text"), common.table(spark, sf_dir, "labels"))
    return toxicity.score(docs.select(*COLUMNS), model, "toxicity").filter("toxicity < 0.5").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near duplicates.

    A document without words, or without an id, is in no group and stays.
    Rows that share an id are one document and stay or go together.
    """
    own = docs.select(*COLUMNS)
    kept = neardup.components(own.filter("doc_id is not null"), words=5).filter("kept").select("doc_id").distinct()
    return own.join(kept, "doc_id", "left_semi").unionByName(own.filter("doc_id is null"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts bytes of 100-byte strings that occur earlier; a character cut in half goes as a whole.

    No row goes: a text that is repeated whole stays as an empty one; a null
    text becomes an empty one.
    """
    cut = suffix.cut(docs, "lang", "source", "n_chars", as_text=True)
    n_chars = F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(F.col("n_chars"))
    return cut.select("doc_id", F.col("kept").alias("text"), "lang", "source", n_chars.alias("n_chars"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 1024 tokens, each token exactly once."""
    return packing.pack(docs, queries.BYTE_BPE)


STAGES = [
    ("language ID", language),
    ("toxicity", toxic),
    ("MinHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = common.written(docs, f"stage{i}")
    return docs


ORACLE_SQL = None
