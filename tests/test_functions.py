"""Token functions and the PGM reader on fixed vectors."""

import pytest
from pyspark.sql import functions as F

from pageloom.functions import tokens
from pageloom.sources import pgm


def values(spark, f, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("t"))).collect()]


def test_hardened(spark):
    assert values(spark, tokens.hardened, ["1.O50", "2S0,00", "Summe", "B8", "XK-250", None]) == ["1.050", "250,00", None, None, None, None]


def test_amounts(spark):
    assert values(spark, tokens.amount_cents, ["1.250,00", "1,250.00", "1250,00", "99", "€ 99,50", "-12,00", "x", "", None]) == [125000, 125000, 125000, 9900, 9950, -1200, None, None, None]


def test_page_numbers(spark):
    good = {"7": 7, "128": 128, "-42-": 42, "- 42 -": 42, "seite 3": 3, "Seite 3 von 12": 3, "page 12": 12, "page 12 of 30": 12, "12 / 30": 12}
    assert values(spark, tokens.page_number, list(good)) == list(good.values())
    assert values(spark, tokens.page_number, ["", "not a page number", "seite 3 von", "seite 3 vonx 12", None]) == [None] * 5


def test_iban(spark):
    assert values(spark, tokens.iban_valid, ["DE89370400440532013000", "DE89370400440532013001", "DE8937", "x"]) == [True, False, False, False]


@pytest.mark.parametrize("content,error", [(b"P6\n1 1\n255\nx", "BadMagic"), (b"P5\nx", "BadHeader"), (b"P5\n1 1\n300\nx", "Not8Bit"), (b"P5\n2 2\n255\nxyz", "Truncated"), (b"P5\n# c\n2 1\n255\nxy", None)])
def test_pgm(content, error):
    assert pgm.parse(content)[3] == error


def test_pgm_files(spark, tmp_path):
    (tmp_path / "a.pgm").write_bytes(pgm.packed(b"abcdef", 3, 2))
    row = pgm.read_pgm(spark.read.format("binaryFile").load(str(tmp_path))).first()
    assert (bytes(row["grey"]), row["w"], row["h"], row["error"]) == (b"abcdef", 3, 2, None)


def test_stream_matches_batch(spark, tmp_path):
    from pageloom.streaming import monitor

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    out = monitor.windowed(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    q = out.writeStream.outputMode("update").format("memory").queryName("monitor").start()
    q.processAllAvailable()
    q.stop()
    got = {(r["start"], r["event_type"]): r["n"] for r in spark.table("monitor").collect()}
    assert got == {(r["start"], r["event_type"]): r["n"] for r in monitor.windowed(events).collect()}


def test_stream_counts_users_exactly(spark, tmp_path):
    from pageloom.streaming import monitor

    events = spark.range(20_000).selectExpr("timestamp_seconds(id % 7200) AS ts", "if(id % 3 = 0, 'a', 'b') AS event_type", "if(id % 50 = 0, null, id % 9001) AS user_id", "1.0D AS value")
    events.write.parquet(str(tmp_path / "in"))
    out = monitor.windowed(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    q = out.writeStream.outputMode("update").format("memory").queryName("users").start()
    q.processAllAvailable()
    q.stop()
    got = {(r["start"], r["event_type"]): r["users"] for r in spark.table("users").collect()}
    assert got == {(r["start"], r["event_type"]): r["users"] for r in monitor.windowed(events).collect()}
