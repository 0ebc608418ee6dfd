"""The corpus pipeline, stage by stage."""

import re
import sys
from pathlib import Path

import numpy as np
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

import corpus_pipeline  # noqa: E402
from pageloom.llm import common, queries  # noqa: E402

SMALL = "/root/testdata/sf0.001"


def test_stages(spark):
    docs, states = spark.read.parquet(f"{SMALL}/documents.parquet"), []
    columns = set(docs.columns)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.written(stage(spark, docs, SMALL), "test")
        assert set(docs.columns) == columns, name
        states.append({r.doc_id: r.text for r in docs.collect()})
    language, toxic, near, passages = states
    source = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    assert language == {d: t for d, t in source.items() if t and re.search(r"[^\W\d_]", t)}
    assert set(toxic) <= set(language)
    groups = brute.components(toxic, 5)
    assert set(near) == {d for d, (_, c) in groups.items() if c == d}
    kept = brute.cut(near)
    assert passages == {d: k[3].decode("utf-8", "ignore") for d, k in kept.items()}

    exact = Tokenizer.from_file(queries.BYTE_BPE)
    total = sum(len(exact.encode(t, add_special_tokens=False).ids) + 1 for t in passages.values())
    pieces = corpus_pipeline.packed(spark, docs, SMALL).collect()
    assert sum(r.length for r in pieces) == total and {r.doc_id for r in pieces} == set(passages)
    assert np.unique([(r.sequence_id, r.offset) for r in pieces], axis=0).shape[0] == len(pieces)


def test_run(spark):
    assert corpus_pipeline.run(spark, SMALL).count() > 0


def test_awkward_rows(spark):
    """Null ids, null and empty texts, repeated rows and clashing columns, through each stage on its own."""
    clean = corpus_pipeline.toxic(spark, spark.read.parquet(f"{SMALL}/documents.parquet"), SMALL).filter("length(text) between 200 and 2000 and lang = 'en'")
    prose, other = (r.text for r in clean.orderBy("doc_id").limit(2).collect())
    rows = [(None, prose), (None, prose), (1, prose), (1, prose), (2, prose), (3, None), (4, ""), (None, None), (5, other)]
    docs = spark.createDataFrame([(i, t, None, None, None, "clash", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, kept string, n long")
    stages = dict(corpus_pipeline.STAGES)
    ids = lambda name: sorted((r.doc_id or 0, r.text or "") for r in stages[name](spark, docs, SMALL).collect())
    whole = sorted((i or 0, t or "") for i, t in rows)
    assert ids("language ID") == [x for x in whole if x[1]]
    assert ids("toxicity") == whole
    assert ids("MinHash near-dedup") == [x for x in whole if x[0] != 2]
    assert len(ids("suffix-array dedup")) == len(rows)
    assert sorted(r.doc_id or 0 for r in corpus_pipeline.packed(spark, docs, SMALL).collect()) == [i for i, _ in whole]
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SMALL).count() == 0, name
