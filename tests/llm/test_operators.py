"""The ten operators against plain versions, and on awkward rows."""

import hashlib
import random
import sys
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from pageloom.llm import ann, bpe, langid, media, neardup, packing, quality, queries, suffix, toxicity, warc  # noqa: E402

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, kept string, n long, tokens string"


def made() -> list[tuple]:
    """Awkward texts: null, empty, blank, short, very long, repeated, with repeats inside, not ASCII."""
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choices(words, k=n))
    one, passage = prose(60), prose(70)
    texts = [None, "", "   \n\t", "one", "Two Words", one, one, one + " end", one.upper(), "x" * 5000, "ab" * 3000, prose(20_000), passage + prose(40), prose(40) + passage + "ß", "日本語 ǅ ﬁ İ Σίσυφος 't 12 ½", "<|endoftext|> a", None, passage, "\0\0", "🙂" * 300]
    return [(i * 7 + 1, t, None if i % 3 else "en", None, None if t is None else len(t), "s", "k", i, None) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(made(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def texts():
    return {r[0]: r[1] for r in made()}


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def test_packing(docs, texts, empty):
    exact = Tokenizer.from_file(queries.BYTE_BPE)
    sequences, own = defaultdict(list), defaultdict(list)
    for r in packing.pack(docs, queries.BYTE_BPE).collect():
        sequences[r.sequence_id].append((r.offset, r.length))
        own[r.doc_id].append(r)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    for d, t in texts.items():
        ids, at = np.array([*exact.encode(t or "", add_special_tokens=False).ids, 0], "<u4"), 0
        for r in sorted(own[d], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    assert packing.pack(empty, queries.BYTE_BPE).count() == 0


def test_media(docs, texts, empty):
    got = by_id(media.digest(media.store(docs)))
    assert got.keys() == texts.keys()
    for d, t in texts.items():
        data = (t or "").encode()
        payload = data + b"\0" * (-len(data) % 64 if data else 64)
        r = got[d]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert media.digest(media.store(empty)).count() == 0
    clips = media.clips(media.store(docs)).collect()
    assert {c.doc_id for c in clips} == texts.keys() and all(c.end_ms >= c.start_ms for c in clips)


def test_bpe(docs, texts, empty):
    exact = Tokenizer.from_file(queries.WORD_BPE)
    exact.no_padding()
    exact.no_truncation()
    got = by_id(bpe.round_trip(docs, queries.WORD_BPE))
    for d, t in texts.items():
        ids = exact.encode(t or "", add_special_tokens=False).ids
        assert got[d].n_tokens == len(ids)
        assert got[d].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[d].decoded_sha256 == hashlib.sha256(exact.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.round_trip(empty, queries.WORD_BPE).count() == 0


def test_bpe_every_character():
    """Each code point alone, within a word, after a composed letter and before a letter."""
    exact, own = Tokenizer.from_file(queries.WORD_BPE), bpe.Merges(queries.WORD_BPE)
    exact.no_padding()
    exact.no_truncation()
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = [" ".join(form.format(c) for c in points[i : i + 512]) for form in ("{}", "a{}1", "é{}", "{}b") for i in range(0, len(points), 512)]
    ids, bounds = own.encode(texts)
    for k, e in enumerate(exact.encode_batch(texts, add_special_tokens=False)):
        assert ids[bounds[k] : bounds[k + 1]].tolist() == e.ids, texts[k][:40]


def test_warc(spark):
    html = {1: None, 2: "", 3: "<p>a</p>", 4: "<p>b</p>", 5: "<p>a</p>", 6: "<p>a</p>", 7: "é\n" * 9000}
    rows = [(p, None if p == 4 else f"http://www.x{p % 2}.org/a?b={p % 3}", h, "clash") for p, h in html.items()]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, archive string")
    got = by_id(warc.capture_histories(pages), "page_id")
    assert {p: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for p, r in got.items()} == brute.records(html)
    order = sorted(got.values(), key=lambda r: (r.key_range, r.position))
    assert order == sorted(order, key=lambda r: (r.url_key, r.captured, r.page_id))
    assert warc.capture_histories(pages.limit(0)).count() == 0


def test_warc_page_with_two_payloads(spark):
    """Each payload of a page_id is stored once, whatever other payloads the id has."""
    rows = [(1, "A"), (1, "B"), (2, "A"), (2, "A"), (3, "B"), (None, "A"), (None, "C")]
    got = warc.capture_histories(spark.createDataFrame([(p, "http://x.org/", h) for p, h in rows], "page_id long, url string, html string")).collect()
    sha = {h: brute.records({1: h})[1][1] for _, h in rows}
    found = sorted(((r.page_id or 0, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str)
    assert found == sorted([(1, sha["A"], "revisit", 2), (1, sha["B"], "revisit", 3), (2, sha["A"], "response", None), (2, sha["A"], "response", None), (3, sha["B"], "response", None), (0, sha["A"], "response", None), (0, sha["C"], "response", None)], key=str)


@pytest.mark.parametrize("hot", [suffix.HOT, 1])
def test_suffix(docs, texts, empty, monkeypatch, hot):
    monkeypatch.setattr(suffix, "HOT", hot)
    got = by_id(suffix.cut(docs))
    assert {d: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for d, r in got.items()} == brute.cut(texts)
    assert suffix.cut(empty).count() == 0


def test_suffix_on_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = by_id(suffix.cut(docs))
    assert {d: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for d, r in got.items()} == brute.cut({r.doc_id: r.text for r in docs.collect()})


@pytest.mark.parametrize("words", [2, 5])
def test_neardup(docs, texts, empty, words):
    got = by_id(neardup.components(docs, words=words))
    assert {d: (r.n_shingles, r.component_id) for d, r in got.items()} == brute.components(texts, words)
    assert all(r.kept == (r.component_id == r.doc_id) for r in got.values())
    assert neardup.components(empty).count() == 0


def test_neardup_on_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = by_id(neardup.components(docs, words=2))
    assert {d: (r.n_shingles, r.component_id) for d, r in got.items()} == brute.components({r.doc_id: r.text for r in docs.collect()}, 2)


def test_ann(spark):
    rows = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{MIDDLE}/embeddings.parquet").collect() if r.embedding and all(x is not None for x in r.embedding)}
    rows = {i: v for i, v in rows.items() if np.isfinite(v).all() and v.any()}
    ids = np.array(sorted(rows))
    vectors = np.stack([rows[i] for i in ids])
    found = defaultdict(list)
    for r in queries.op7_ann(spark, MIDDLE).collect():
        assert abs(r.score - np.linalg.norm(rows[r.query_id] - rows[r.vec_id])) < 1e-9
        found[r.query_id].append((r.rank, r.vec_id))
    hits = total = 0
    for q in ids[ids % 100 == 0]:
        d = np.linalg.norm(vectors - rows[q], axis=1)
        d[ids == q] = np.inf
        best = set(ids[np.lexsort((ids, d))[:10]].tolist())
        hits, total = hits + len(best & {v for _, v in found[q]}), total + len(best)
        assert sorted(k for k, _ in found[q]) == list(range(1, len(found[q]) + 1))
    assert hits / total >= 0.9


def test_ann_on_awkward_vectors(spark):
    rows = [(0, [0.0, 1.0]), (100, None), (200, [0.0, 0.0]), (1, [float("nan"), 1.0]), (2, [None, 1.0]), (3, [0.0, 1.0]), (4, [0.0, 2.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in ann.search(vectors).orderBy("rank").collect()] == [(0, 1, 3, 0.0), (0, 2, 4, 1.0)]
    assert ann.search(vectors.limit(0)).count() == 0


def test_language(spark, docs, empty):
    known = by_id(spark.read.parquet(f"{MIDDLE}/documents.parquet").filter("lang is not null"))
    got = by_id(queries.op8_langid(spark, MIDDLE))
    held = [r for r in got.values() if r.held_out and r.doc_id in known and r.lang_pred != "und"]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got.values())
    assert sum(r.lang_pred == known[r.doc_id].lang for r in held) / len(held) > 0.9
    model = langid.fit(spark.read.parquet(f"{SMALL}/documents.parquet"))
    odd = by_id(langid.identify(docs, model))
    assert [odd[d].lang_pred for d in (1, 8, 15)] == ["und"] * 3
    assert langid.identify(empty, model).count() == 0 and langid.identify(docs, langid.fit(empty)).filter("lang_pred <> 'und'").count() == 0


@pytest.mark.parametrize("query, column, least", [(queries.op6_quality, "quality", 0.75), (queries.op9_toxicity, "toxic", 0.75)])
def test_classifiers(spark, query, column, least):
    labels = {r.doc_id: r[column] for r in spark.read.parquet(f"{MIDDLE}/labels.parquet").collect() if r[column] is not None}
    got = [r for r in query(spark, MIDDLE).collect() if r.held_out and r.doc_id in labels]
    assert all(0 <= r.score <= 1 for r in got)
    assert brute.auc([r.score for r in got], [labels[r.doc_id] for r in got]) > least


def test_classifiers_on_awkward_rows(spark, docs, empty, texts):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for module in (quality, toxicity):
        model = module.fit(empty, labels)
        got = by_id(module.score(docs, model))
        assert got.keys() == texts.keys() and all(0 <= r.score <= 1 for r in got.values())
        assert module.score(empty, model).count() == 0


@pytest.mark.parametrize("module, column, caps, share", [(quality, "quality", ("GOOD", "POOR"), 0.85), (toxicity, "toxic", ("TOXIC", "ORDINARY"), 0.1)])
def test_scores_keep_the_base_rate(spark, monkeypatch, module, column, caps, share):
    """Where texts say nothing of their class, scores are the share of class 1 however few rows of a class are learned from."""
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(60)]
    rows = [(i, " ".join(rng.choices(words, k=12)), 70, int(rng.random() < share)) for i in range(3000)]
    docs = spark.createDataFrame(rows, f"doc_id long, text string, n_chars long, {column} int")
    for cap in caps:
        monkeypatch.setattr(module, cap, 200)
    plain = docs.select("doc_id", "text", "n_chars")
    scores = [r.score for r in module.score(plain, module.fit(plain, docs.select("doc_id", column))).collect()]
    assert abs(np.mean(scores) - share) < 0.07


def test_every_language_is_learned(spark):
    rng = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyz"
    vocabulary = {f"l{i:03}": ["".join(rng.choices(letters, k=7)) for _ in range(12)] for i in range(205)}
    rows = [(i * 1000 + j, " ".join(rng.choices(w, k=30)), x) for i, (x, w) in enumerate(vocabulary.items()) for j in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(2)
    model = langid.fit(docs)
    got = langid.identify(docs, model).collect()
    learned = {r.lang for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 5}
    assert len(learned) > 200 and all(r.lang_pred == r.lang for r in got if r.lang in learned)


def test_languages_in_groups(spark, docs, monkeypatch):
    model = langid.fit(spark.read.parquet(f"{SMALL}/documents.parquet"))
    whole = [(r.doc_id, r.lang_pred, r.score) for r in langid.identify(docs, model).collect()]
    monkeypatch.setattr(langid, "TOGETHER", 1)
    assert sorted((r.doc_id, r.lang_pred, r.score) for r in langid.identify(docs, model).collect()) == sorted(whole)


@pytest.mark.parametrize("bad", ["we know where you live", "1d10t-2 x@@x"])
def test_toxic_phrases_of_ordinary_words(bad):
    """Toxicity in the order of words, or in digits and signs, that no single word of letters gives away."""
    rng = random.Random(6)
    words = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(80)] + "we know where you live d t x".split()

    def text(label):
        own = rng.choices(words, k=50)
        own.insert(rng.randint(0, 50), bad if label else " ".join(rng.sample(bad.split(), 1)) if bad[0] == "w" else "d t 10 1 2 x x")
        return " ".join(own)

    rows = [(text(y), y, 1.0) for y in [0, 0, 1] * 200]
    rng.shuffle(rows)
    labels = [i % 2 for i in range(200)]
    scores = toxicity.score_texts(toxicity.fit_rows(rows), [text(y) for y in labels])
    assert brute.auc(scores.tolist(), labels) > 0.95


def test_warc_ids(spark):
    """Very large, negative and null ids, and runs of two entries."""
    rows = [(10**12, "http://a.org/1", "x"), (None, "http://a.org/1", "x"), (None, None, None), (-5, "http://a.org/1", "y"), (3, "http://b.org/", "x")]
    got = warc.capture_histories(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r.page_id is None, r.page_id or 0, r.record_type, r.refers_to) for r in got) == [(False, -5, "response", None), (False, 3, "revisit", 10**12), (False, 10**12, "response", None), (True, 0, "response", None), (True, 0, "response", None)]


def test_loser_tree():
    rng = random.Random(5)
    rows = [(rng.choice("abc"), "t", rng.choice([None, *range(50)]), i) for i in range(500)]
    runs = [sorted(rows[i::7], key=warc.place) for i in range(7)]
    blocks = sorted((run[i : i + 10] for run in runs for i in range(0, len(run), 10)), key=lambda b: warc.place(b[0]))
    assert [warc.place(r) for r in warc.merged(blocks)] == sorted(map(warc.place, rows))


def test_suffix_on_repeated_rows(spark):
    rng = random.Random(9)
    text, other = ("".join(rng.choices("abcdefgh ", k=400)) for _ in range(2))
    rows = [(1, text), (1, text), (2, other), (3, other), (3, other), (None, other)]
    got = sorted((r.doc_id or 0, r.n_removed) for r in suffix.cut(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    assert got == [(0, 0), (1, 0), (1, 0), (2, 0), (3, 400), (3, 400)]


def test_suffix_compares_what_can_be_equal(spark):
    """Copies of a whole text are not compared, nor contexts that have only an anchor's bytes in common."""
    rng = random.Random(11)
    own = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    text, phrase, passage = own(5000), own(60), own(120)
    rows = [(i, text) for i in range(20)] + [(20 + i, own(300) + phrase + own(300)) for i in range(20)]
    docs = spark.createDataFrame([*rows, (40, own(90) + passage + own(90)), (41, passage[5:] + own(90))], "doc_id long, text string")
    first = suffix.firsts(docs)
    assert {r.doc_id for r in first.collect()} == {0, *range(20, 42)}
    found = suffix.matched(suffix.listed(docs.join(first, "doc_id", "left_semi"))).filter("kind = 2").collect()
    assert found and {r.doc_id for r in found} == {40, 41}
    assert {r.doc_id: r.n_removed for r in suffix.cut(docs).collect() if r.n_removed} == {41: 115} | dict.fromkeys(range(1, 20), 5000)


def test_suffix_keeps_contexts_of_anchors_beyond_the_bound(spark, texts, docs, monkeypatch):
    monkeypatch.setattr(suffix, "HELD", 0)
    got = by_id(suffix.cut(docs))
    assert {d: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for d, r in got.items()} == brute.cut(texts)


def test_suffix_over_a_mebibyte(spark):
    rng = random.Random(10)
    long = "".join(rng.choices("abcdefghijklmnop", k=1 << 20)) + "".join(rng.choices("qrstuv", k=3000))
    rows = [(1, long), (2, "x" * 50 + long[(1 << 20) - 300 : (1 << 20) + 400] + "y" * 50)]
    got = by_id(suffix.cut(spark.createDataFrame(rows, "doc_id long, text string")))
    assert (got[1].n_removed, got[2].n_removed, bytes(got[2].kept)) == (0, 700, b"x" * 50 + b"y" * 50)


def test_ann_ties_and_far_vectors(spark):
    rows = [(0, [1e6, 1e6])] + [(i, [1e6 + (1 if i % 2 else -1), 1e6]) for i in range(1, 64)]
    found = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in found] == [(i, 1.0) for i in range(1, 11)]


def test_shortest_pack_first():
    assert packing.place({600: 1, 500: 1, 300: 1}, 1024)[-1] == (300, 0, 1, 1, 500)  # to the pack with the most room
    rng = random.Random(11)
    for _ in range(30):
        size = rng.choice([16, 100, 1024])
        histogram = {rng.randint(1, size): rng.randint(1, 40) for _ in range(rng.randint(1, 60))}
        filled, seen = defaultdict(int), defaultdict(int)
        for length, rank, count, first, offset in packing.place(histogram, size):
            assert rank == seen[length]
            seen[length] += count
            for sequence in range(first, first + count):
                assert filled[sequence] == offset
                filled[sequence] += length
        assert seen == histogram and max(filled.values()) <= size
        tokens = sum(k * n for k, n in histogram.items())
        assert len(filled) <= 2 * -(-tokens // size)  # no two sequences are half empty


def test_bpe_stream_at_its_window():
    exact, model = Tokenizer.from_file(queries.WORD_BPE), bpe.merges(queries.WORD_BPE)
    exact.no_truncation()
    rng, w = random.Random(12), model.window
    words = ["".join(rng.choices(letters, k=n)) for letters in ("ab", "etaoin", "abcdefghijklmnopqrstuvwxyz", "-=") for n in (1, w // 2, w - 1, w, w + 1, 2 * w, 3 * w + 5)]
    assert model.stream([x.encode() for x in words]) == [exact.encode(x, add_special_tokens=False).ids for x in words]


def test_bpe_in_portions(monkeypatch):
    exact, text = Tokenizer.from_file(queries.WORD_BPE), "it's  a ¼ café́ <|endoftext|> x" * 40
    monkeypatch.setattr(bpe, "PORTION", 7)
    ids, bounds = bpe.merges(queries.WORD_BPE).encode(["", text, "a"])
    assert ids[bounds[1] : bounds[2]].tolist() == exact.encode(text, add_special_tokens=False).ids


def test_cross_parsing():
    """Side-by-side parsing against one automaton after the other, and against the definition."""
    rng = random.Random(13)
    samples = {x: "".join(rng.choices(a, k=300)) for x, a in (("p", "abc "), ("q", "bcd "))}
    parser = langid.Parser(samples)
    texts = ["".join(rng.choices("abcdé ", k=n)) for n in (0, 1, 5, 200, 2 * langid.SEGMENT + 3)]

    def phrases(text, sample):
        n = at = 0
        while at < len(text):
            k = 1
            while at + k < len(text) + 1 and text[at : at + k] in sample:
                k += 1
            n, at = n + 1, at + max(k - 1, 1)
        return n

    parts = lambda t: [t[i : i + langid.SEGMENT] for i in range(0, len(t), langid.SEGMENT)]
    want = [[sum(phrases(p, samples[x]) for p in parts(t)) for x in "pq"] for t in texts]
    assert parser.phrases(texts).tolist() == want
    assert [[sum(langid.Automaton(samples[x]).parse(p) for p in parts(t)) for x in "pq"] for t in texts] == want


def test_neardup_in_long_lists(spark):
    """A large group of near copies, of which some are just too far from all others."""
    rng = random.Random(14)
    base = [f"w{i}" for i in range(120)]
    texts = {}
    for d in range(260):
        own = list(base)
        for at in rng.sample(range(120), rng.choice([0, 1, 2, 3, 4, 5, 6, 7, 8])):
            own[at] = rng.choice([f"v{rng.randint(0, 30)}", f"u{d}x{at}"])
        texts[d] = " ".join(own)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = by_id(neardup.components(docs, words=2))
    assert {d: (r.n_shingles, r.component_id) for d, r in got.items()} == brute.components(texts, 2)


def template_pages(n, own, base=100, seed=0):
    """Pages of one template with words of their own: too far apart for links, but in the same posting lists."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(base)]
    out = {}
    for d in range(n):
        k = own if isinstance(own, int) else rng.choice(own)
        page = words[:]
        for j in range(k):
            page.insert(rng.randrange(len(page)) if seed else len(page), f"u{d}x{j}")
        out[d] = " ".join(page)
    return out


@pytest.mark.parametrize(("own", "hot"), [(26, neardup.HOT), (18, 8), ((2, 9, 14, 20, 30), neardup.HOT), ((2, 9, 14, 20, 30), 8)])
def test_neardup_template_pages(spark, monkeypatch, own, hot):
    monkeypatch.setattr(neardup, "HOT", hot)
    texts = template_pages(150, own) | {1000 + d: t for d, t in template_pages(60, 4, seed=3).items()}
    got = by_id(neardup.components(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), words=2))
    assert {d: (r.n_shingles, r.component_id) for d, r in got.items()} == brute.components(texts, 2)


def test_neardup_work_on_template_pages(spark, monkeypatch):
    """Joined pairs grow in proportion with a group of pages that are alike but not linked."""
    made, count = {}, {}
    real_paired = neardup.paired

    def joined(placed, percent):
        lists = placed.groupBy("a", "element").count()
        made["pairs"] = made.get("pairs", 0) + sum(r["count"] ** 2 for r in lists.collect())
        return real_paired(placed, percent)

    monkeypatch.setattr(neardup, "paired", joined)
    for n in (200, 400, 800, 1600):
        made.clear()
        texts = template_pages(n, 26)
        got = neardup.components(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), words=2)
        assert got.filter("kept").count() == n
        count[n] = made["pairs"]
    assert all(count[2 * n] <= 2.2 * count[n] + 2000 for n in (200, 400, 800)), count


def test_neardup_hub_of_a_long_list_is_central(spark):
    """Of a template, an outlier that happens to be smallest, and a larger text that holds it, the template is the hub."""
    rows = [(1, e, True, 20, 400, 30, 10) for e in range(30)]
    rows += [(1, e, True, 10, 380, 90, 90) for e in range(28)]
    rows += [(1, e, True, 30, 900, 530, 0) for e in range(30)]
    hot = spark.createDataFrame(rows, "a long, element long, adds boolean, b long, n long, m int, h int")
    got = {tuple(r) for r in neardup.rehubbed(hot).collect()}
    assert got == {(20, 10), (20, 30)}
