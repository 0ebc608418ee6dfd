"""Cross-tokenizer alignment against a version by plain byte ranges."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from pageloom.llm import align, queries

SCHEMA = "doc_id long, text string, n_a string, pairs string"
BYTES = {c: b for b, c in align.byte_symbols().items()}


def texts():
    word = "pneumonoultramicroscopic"
    return [
        None, "", " ", "  two  blanks ", "a", "Hello, world!", "naïve façade — “quotes”", "日本語のテキスト 🙂🙂", "<s> <|endoftext|> </s> <0x41>", "x▁y", "tab\tand\nline\r\n\r\n end",
        word * 40, "the cat sat on the mat " * 30, "the cat sat on the mat " * 30, "\0 nul \x7f", "ﬁ ligature İstanbul ǅ", "don't we'll 12345 3.14", "  leading", "a  b   c    d\n\n\n  e", "é" * 300, "١٢٣ नमस्ते",
    ]


def brute(rows, a_path, b_path):
    a, b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
    a.encode_special_tokens = True
    out, held = [], defaultdict(int)
    for doc_id, text in rows:
        data = f" {text or ''}".encode()
        of_a = a.encode(f" {text or ''}", add_special_tokens=False).ids if text else []
        of_b = b.encode(text) if text else []
        bytes_a = [bytes(BYTES[c] for c in a.id_to_token(i)) for i in of_a]
        bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in of_b]
        if not text or b"".join(bytes_a) != data or b"".join(bytes_b) != data:
            out.append((doc_id, 0, 0, 0, Counter(), ""))
            continue
        ends = [np.cumsum([len(x) for x in side]).tolist() for side in (bytes_a, bytes_b)]
        shared = sorted(set(ends[0]) & set(ends[1]))
        groups, links = [], Counter()
        for lo, hi in zip([0, *shared], shared):
            own = [[i for i, e in zip(ids, side) if lo < e <= hi] for ids, side in zip((of_a, of_b), ends)]
            groups.append("|".join(",".join(map(str, x)) for x in own))
            links.update((i, j) for i in own[0] for j in own[1])
        for pair in links:
            held[pair] += 1
        out.append((doc_id, len(of_a), len(of_b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    most = defaultdict(int)
    for (i, _), n in held.items():
        most[i] = max(most[i], n)
    return sorted((d, n_a, n_b, g, sum(x.values()), sum(n for p, n in x.items() if held[p] == most[p[0]]), sum(n * held[p] for p, n in x.items()), sha) for d, n_a, n_b, g, x, sha in out)


@pytest.mark.parametrize(("head", "portion", "segments"), [(align.HEAD, align.PORTION, align.SEGMENTS), (20, 7, 3), (0, 1, 0)])
def test_against_byte_ranges(spark, monkeypatch, head, portion, segments):
    monkeypatch.setattr(align, "HEAD", head)
    monkeypatch.setattr(align, "PORTION", portion)
    monkeypatch.setattr(align, "SEGMENTS", segments)
    rows = list(enumerate(texts())) + [(3, "the same id twice"), (3, "the same id twice")]
    docs = spark.createDataFrame([(i, t, "clash", "clash") for i, t in rows], SCHEMA).repartition(3)
    got = align.align(docs, queries.BYTE_BPE, queries.PIECE_BPE)
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(tuple(r[c] for c in columns) for r in got.collect()) == brute(rows, queries.BYTE_BPE, queries.PIECE_BPE)


def test_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = align.align(docs, queries.BYTE_BPE, queries.PIECE_BPE)
    assert sorted(map(tuple, got.collect())) == brute([tuple(r) for r in docs.collect()], queries.BYTE_BPE, queries.PIECE_BPE)


def test_no_rows(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert align.align(docs, queries.BYTE_BPE, queries.PIECE_BPE).count() == 0
    nulls = spark.createDataFrame([(None, None), (None, "a b")], "doc_id long, text string")
    assert sorted(r.n_a for r in align.align(nulls, queries.BYTE_BPE, queries.PIECE_BPE).collect()) == [0, 2]


def test_segment_border_is_no_piece():
    """What Segments relies on: no piece of B holds a blank behind another character."""
    pieces = sentencepiece.SentencePieceProcessor(model_file=queries.PIECE_BPE)
    assert not any("▁" in x.lstrip("▁") for x in map(pieces.id_to_piece, range(pieces.get_piece_size())))
