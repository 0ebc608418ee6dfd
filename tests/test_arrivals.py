"""Arriving files and sessions, as streams and in batch."""

import datetime as dt
import json
import os
import time

from pageloom.streaming import arrivals


def put(folder, name, data, age):
    path = folder / name
    path.write_bytes(data)
    os.utime(path, (time.time() - age, time.time() - age))


def drain(files, out, checkpoint):
    query = files.select("path", "sha256", "length").writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None


def test_files_arrive_once(spark, tmp_path):
    folder, out, checkpoint = tmp_path / "in", tmp_path / "out", tmp_path / "checkpoint"
    folder.mkdir()
    for i, (name, data) in enumerate([("a.pgm", b"one"), ("b.pgm", b"two"), ("copy.pgm", b"one"), ("note.txt", b"other"), ("empty.pgm", b"")]):
        put(folder, name, data, 300 - i)
    own = lambda: arrivals.once(arrivals.arriving(spark, str(folder), "*.pgm", at_once=2))
    drain(own(), out, checkpoint)
    seen = lambda: sorted(os.path.basename(r.path) for r in spark.read.parquet(str(out)).collect())
    assert seen() == ["a.pgm", "b.pgm"]
    put(folder, "c.pgm", b"three", 200)
    put(folder, "again.pgm", b"two", 199)
    drain(own(), out, checkpoint)  # a restart: nothing is taken twice, and contents are remembered
    assert seen() == ["a.pgm", "b.pgm", "c.pgm"]
    drain(own(), out, checkpoint)
    assert len(seen()) == 3
    batch = arrivals.once(arrivals.arriving(spark, str(folder), "*.pgm", streaming=False))
    assert sorted(os.path.basename(r.path) for r in batch.collect()) == ["a.pgm", "b.pgm", "c.pgm"]


def test_sessions(spark, tmp_path):
    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    rows = [(1, at(0), 1.0), (1, at(29), 2.0), (1, at(58), 4.0), (1, at(95), 8.0), (2, at(10), 1.5), (2, at(10), 1.5), (1, at(900), 1.0), (3, at(2000), 1.0)]
    events = spark.createDataFrame(rows, "user_id long, ts timestamp, value double")
    want = [(1, at(0), at(58), 3, 7.0), (1, at(95), at(95), 1, 8.0), (1, at(900), at(900), 1, 1.0), (2, at(10), at(10), 2, 3.0), (3, at(2000), at(2000), 1, 1.0)]
    assert sorted(map(tuple, arrivals.sessions(events).collect())) == want
    source, out = tmp_path / "events", tmp_path / "sessions"
    source.mkdir()
    for k, part in enumerate((rows[:3], rows[3:])):
        (source / f"{k}.json").write_text("\n".join(json.dumps({"user_id": u, "ts": t.isoformat(), "value": v}) for u, t, v in part))
    stream = spark.readStream.schema("user_id long, ts timestamp, value double").option("maxFilesPerTrigger", 1).json(str(source))
    query = arrivals.sessions(stream).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = sorted(map(tuple, spark.read.parquet(str(out)).collect()))
    assert got == want[:-1]  # the last one is still open
    assert arrivals.sessions(events.limit(0)).count() == 0
