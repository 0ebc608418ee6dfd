"""Binary PGM rasters as binary columns."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

HEAD = re.compile(rb"P5(?:\s+|#[^\n]*\n)+(\d+)(?:\s+|#[^\n]*\n)+(\d+)(?:\s+|#[^\n]*\n)+(\d+)\s")
SIDE, PIXELS = 20_000, 40_000_000


def parse(content: bytes) -> tuple[bytes | None, int | None, int | None, str | None]:
    """Grey bytes, width, height, error."""
    if content[:2] != b"P5":
        return None, None, None, "BadMagic"
    head = HEAD.match(content)
    if not head:
        return None, None, None, "BadHeader"
    w, h, top = (int(x) for x in head.groups())
    if not 0 < top <= 255:
        return None, None, None, "Not8Bit"
    if w > SIDE or h > SIDE or w * h > PIXELS:
        return None, None, None, "TooLarge"
    grey = content[head.end() : head.end() + w * h]
    return (grey, w, h, None) if len(grey) == w * h else (None, None, None, "Truncated")


def packed(grey: bytes, w: int, h: int) -> bytes:
    return b"P5\n%d %d\n255\n" % (w, h) + grey


def read_pgm(files: DataFrame) -> DataFrame:
    """``path grey w h error`` of a ``binaryFile`` DataFrame; each file is a row, so the work spreads by file."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                got = parse(batch.column("content")[i].as_py())
                kinds = (pa.binary(), pa.int32(), pa.int32(), pa.string())
                yield pa.RecordBatch.from_arrays([batch.column("path").slice(i, 1), *(pa.array([x], k) for x, k in zip(got, kinds, strict=True))], ["path", "grey", "w", "h", "error"])

    return files.select("path", "content").mapInArrow(run, "path string, grey binary, w int, h int, error string")
