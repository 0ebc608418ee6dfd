"""Edit operations and fields by rules, against plain versions and by hand."""

import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pageloom.operators import alignment, fields


def plain(read, true):
    """Full table, same order of steps back."""
    n, m = len(read), len(true)
    t = [[i + j if not i or not j else 0 for j in range(m + 1)] for i in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            t[i][j] = min(t[i - 1][j] + 1, t[i][j - 1] + 1, t[i - 1][j - 1] + (read[i - 1] != true[j - 1]))
    i, j, out, pairs = n, m, [0, 0, 0], Counter()
    while i or j:
        if i and j and t[i][j] == t[i - 1][j - 1] + (read[i - 1] != true[j - 1]):
            if read[i - 1] != true[j - 1]:
                out[0] += 1
                pairs[true[j - 1], read[i - 1]] += 1
            i, j = i - 1, j - 1
        elif i and t[i][j] == t[i - 1][j] + 1:
            out[1], i = out[1] + 1, i - 1
        else:
            out[2], j = out[2] + 1, j - 1
    return *out, pairs


def test_edits():
    rng = random.Random(6)
    assert alignment.edits("", "") == (0, 0, 0, Counter())
    assert alignment.edits("abc", "") == (0, 3, 0, Counter()) and alignment.edits("", "abc") == (0, 0, 3, Counter())
    assert alignment.edits("m0dem", "modern") == (2, 0, 1, Counter({("o", "0"): 1, ("n", "m"): 1}))
    for size in (3, 12, 40, 90):
        for _ in range(60):
            true = "".join(rng.choices("abcde", k=rng.randint(0, size)))
            read = "".join(c if rng.random() < 0.7 else rng.choice(["", c + "x", rng.choice("abcde")]) for c in true) if rng.random() < 0.7 else "".join(rng.choices("abcde", k=rng.randint(0, size)))
            assert alignment.edits(read, true) == plain(read, true), (read, true)


def test_long_strings_take_the_band(monkeypatch):
    rng = random.Random(7)
    for bits in (0, 1 << 28):
        monkeypatch.setattr(alignment, "BITS", bits)
        for _ in range(60):
            true, read = ("".join(rng.choices("abc\U0001f600", k=rng.randint(0, 30))) for _ in range(2))
            assert alignment.edits(read, true) == plain(read, true), (read, true)


def test_a_row_takes_little_time():
    rng = random.Random(8)
    true = "".join(rng.choices("abcdefghij", k=2000))
    read = "".join(rng.choice("xyz") if rng.random() < 0.2 else c for c in true)
    took = []
    for _ in range(3):
        began = time.process_time()
        assert sum(alignment.edits(read, true)[:3]) <= sum(a != b for a, b in zip(read, true, strict=True))
        took.append(time.process_time() - began)
    assert min(took) < 0.03


def test_a_small_file_is_many_tasks(spark):
    pairs = spark.createDataFrame([(i, f"a{i}", f"b{i}") for i in range(400)], "id long, read string, true string").coalesce(1)
    assert alignment.aligned(pairs, "id").select(F.spark_partition_id().alias("p")).distinct().count() == 4


def test_confusions(spark):
    rows = [(1, "he11o", "hello"), (2, "wor1d", "world"), (3, None, "a"), (4, "b", None), (5, None, None), (1, "he11o", "hello")]
    pairs = spark.createDataFrame([(*r, "clash") for r in rows], "id long, read string, true string, errors string")
    own = alignment.aligned(pairs, "id")
    assert sorted((r.id, r.errors, r.subs, r.ins, r.dels, r.length) for r in own.collect()) == [(1, 2, 2, 0, 0, 5), (1, 2, 2, 0, 0, 5), (2, 1, 1, 0, 0, 5), (3, 1, 0, 0, 1, 1), (4, 1, 0, 1, 0, 0), (5, 0, 0, 0, 0, 0)]
    assert [tuple(r) for r in alignment.confusions(own).collect()] == [("l", "1", 5)]
    assert alignment.aligned(pairs.limit(0), "id").count() == 0


def line(idx, *words, t=0):
    """Words of a line: text, or (text, shift of its band)."""
    out = []
    for k, w in enumerate(words):
        text, shift = w if isinstance(w, tuple) else (w, 0)
        out.append((1, idx, k, text, 100 * k, 30 * idx + shift, 100 * k + 90, 30 * idx + shift + 20, 90 - k))
    return out


def harvest(spark, words, rules=None):
    own = spark.createDataFrame(words, "doc_id long, line_idx int, word_idx int, text string, l int, t int, r int, b int, conf int")
    rules = fields.field_rules(spark, "german_invoice") if rules is None else rules
    return {r.key: (r.label, r.value, r.cents, (r.l, r.t, r.r, r.b), r.conf, r.checks) for r in fields.harvested_by(own, rules).collect()}


def test_invoice(spark):
    words = line(0, "Netto:", ("7,00", 15), "EUR", "100,00") + line(1, "USt.", "19%", "19,00") + line(2, "Summe") + line(3, "Gesamt:", "119,00", "120,00")
    words += line(4, "IBAN:", "DE89", "3704", "0044", "0532", "0130", "00", "-", "x") + line(5, "Re-Nr:", "A-17", "B2", "c!") + line(6, "Netto", "5,00")
    got = harvest(spark, words)
    assert got["netto"] == ("Netto:", "100,00", 10000, (300, 0, 390, 20), 87, ["arithmetic_ok"])  # the nearest amount is out of the label's band
    assert got["ust"][1:3] == ("19,00", 1900) and got["ust"][5] == ["arithmetic_ok"]
    assert got["brutto"][:3] == ("Gesamt:", "119,00", 11900)  # the first label has no value
    assert got["iban"] == ("IBAN:", "DE89370400440532013000", None, (100, 120, 690, 140), 84, ["iban_mod97_ok"])
    assert got["rechnungsnummer"][1] == "A-17B2" and "steuernummer" not in got
    wrong = harvest(spark, line(0, "Netto", "1,00") + line(1, "MwSt", "1,00") + line(2, "Total", "3,00") + line(3, "IBAN", "DE88370400440532013000"))
    assert all(x[5] == [] for x in wrong.values()) and len(wrong) == 4
    long = harvest(spark, line(0, "IBAN", "A" * 30, "BBBB", "C"))
    assert long["iban"][1] == "A" * 30 + "BBBB"


def test_own_rules(spark):
    rules = spark.createDataFrame([("due", "amount", "fällig"), ("who", "id", "kunde")], "key string, kind string, label string")
    got = harvest(spark, line(0, "fällig:", "$ 3.50") + line(1, "Kunde", "X"), rules)
    assert {k: v[1:3] for k, v in got.items()} == {"due": ("$ 3.50", 350), "who": ("X", None)}
    assert fields.field_rules(spark, None) is None and fields.field_rules(spark, "") is None
    with pytest.raises(ValueError):
        fields.field_rules(spark, "french_invoice")


def test_corrections(spark):
    lexicon = spark.createDataFrame([("glukose", 50), ("beginning", 40), ("ergebnis", 70), ("cart", 31), ("care", 90), ("card", 90)], "word string, weight long")
    tokens = ["Glukosc:", "(GLUK0SE)", "glukse", "ERGEBMIS,", "begimnimg", "begxmnimg", "Beginning", "carx", "cut", "—", "Ergebnis", "zzzzzzzz"]
    words = spark.createDataFrame([(1, i, t, "clash") for i, t in enumerate(tokens)], "doc_id long, word_idx int, text string, weight string")
    fixed = fields.corrected_words(words, lexicon, long=2)
    assert [r.fixed for r in fixed.orderBy("word_idx").collect()] == ["Glukose:", "(GLUK0SE)", "glukose", "ERGEBNIS,", "beginning", "begxmnimg", "Beginning", "card", "cut", "—", "Ergebnis", "zzzzzzzz"]
    audit = {(r["from"], r["to"], r.distance) for r in fields.corrections(fixed).collect()}
    assert audit == {("Glukosc:", "Glukose:", 1), ("glukse", "glukose", 1), ("ERGEBMIS,", "ERGEBNIS,", 1), ("begimnimg", "beginning", 2), ("carx", "card", 1)}
    strict = fields.corrected_words(words, lexicon)
    assert [r.fixed for r in strict.filter("word_idx = 4").collect()] == ["begimnimg"]
