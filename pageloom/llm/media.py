"""Texts as AVI motion-JPEG media columns, and shots found in them.

A payload (the text's bytes, zero bytes up to a multiple of 64) becomes 8-bit
samples, 64 to a line, in frames of at most 32 lines.  Each frame is an intra
frame of lossless JPEG (predictor: the sample to the left; a restart interval
for each line), stored in an AVI file with its RIFF index.  Lines are coded and
decoded side by side, as columns of numpy matrices.

Reading parses the index, decodes every frame and compares the histograms of
neighbouring frames: a shot begins where the difference exceeds the mean of the
shot so far by ``k`` of its deviations and a floor.

Rows: a null or empty text is 64 zero bytes; equal texts give equal media;
repeated rows are kept; extra columns of the input are not carried, whatever
their names; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

WIDTH, LINES, RATE = 64, 32, 25
#: Code lengths of the nine difference classes, for prose: small for letters next to letters and to blanks.
CODE_BITS = {4: 2, 7: 2, 2: 3, 3: 3, 1: 4, 5: 4, 0: 5, 6: 5, 8: 6}


def _codes() -> dict[int, tuple[int, int]]:
    """Canonical code (value, bits) of each class."""
    out, value, bits = {}, 0, 0
    for kind, n in sorted(CODE_BITS.items(), key=lambda x: (x[1], x[0])):
        value <<= n - bits
        bits = n
        out[kind] = value, n
        value += 1
    return out


def _encoder() -> tuple[np.ndarray, np.ndarray]:
    """For difference + 255: its bits, left-aligned in 16, and their number."""
    codes, value, bits = _codes(), np.zeros(511, np.uint16), np.zeros(511, np.int64)
    for d in range(-255, 256):
        kind = abs(d).bit_length()
        code, n = codes[kind]
        both = (code << kind) | (d if d >= 0 else d + (1 << kind) - 1)
        value[d + 255], bits[d + 255] = both << (16 - n - kind), n + kind
    return value, bits


def _decoder() -> tuple[np.ndarray, np.ndarray]:
    """For the next 16 bits: the difference they begin with, and its number of bits."""
    value, bits = _encoder()
    diff, used = np.zeros(1 << 16, np.int16), np.zeros(1 << 16, np.uint8)
    for d in range(-255, 256):
        at, n = int(value[d + 255]), int(bits[d + 255])
        diff[at : at + (1 << (16 - n))], used[at : at + (1 << (16 - n))] = d, n
    return diff, used


def _head(lines: int) -> bytes:
    kinds = sorted(CODE_BITS, key=lambda k: (CODE_BITS[k], k))
    counts = [sum(n == b for n in CODE_BITS.values()) for b in range(1, 17)]
    huffman = b"\x00" + bytes(counts) + bytes(kinds)
    parts = [(0xC4, huffman), (0xDD, struct.pack(">H", WIDTH)), (0xC3, struct.pack(">BHHB", 8, lines, WIDTH, 1) + b"\x01\x11\x00"), (0xDA, b"\x01\x01\x00\x01\x00\x00")]
    return b"\xff\xd8" + b"".join(struct.pack(">BBH", 0xFF, mark, len(body) + 2) + body for mark, body in parts)


def scans(samples: np.ndarray, frame_ends: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Entropy-coded lines of all frames, and where each frame's part ends. ``frame_ends``: in lines."""
    value, bits = _encoder()
    diffs = samples.astype(np.int16)
    diffs = np.concatenate([diffs[:, :1] - 128, diffs[:, 1:] - diffs[:, :-1]], axis=1) + 255
    words, sizes = value[diffs], bits[diffs]
    pad = -sizes.sum(axis=1) % 8
    words = np.concatenate([words, np.full((len(words), 1), 0xFFFF, np.uint16)], axis=1)
    sizes = np.concatenate([sizes, pad[:, None]], axis=1)
    flags = np.unpackbits(words.astype(">u2").view(np.uint8).reshape(-1, 2), axis=1)
    data = np.packbits(flags[np.arange(16) < sizes.reshape(-1, 1)])
    line_ends = np.cumsum(sizes.sum(axis=1) // 8)
    full = data == 0xFF  # a zero byte follows each, and a restart mark each line but a frame's last
    inside = np.ones(len(samples), np.int64)
    inside[frame_ends - 1] = 0
    extra = full.astype(np.int64)
    extra[line_ends - 1] += 2 * inside
    ends = np.cumsum(1 + extra)
    out = np.zeros(int(ends[-1]), np.uint8)
    out[ends - 1 - extra] = data
    frame_of = np.repeat(np.arange(len(frame_ends)), np.diff(frame_ends, prepend=0))
    number = np.arange(len(samples)) - np.concatenate([[0], frame_ends])[frame_of]
    marked = np.flatnonzero(inside)
    at = ends[line_ends[marked] - 1]
    out[at - 2], out[at - 1] = 0xFF, 0xD0 + number[marked] % 8
    return out.tobytes(), ends[line_ends[frame_ends - 1] - 1]


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def avi(frames: list[bytes], lines: int, n_bytes: int, n_payload: int) -> bytes:
    """An AVI file of the frames; a comment tells the payload's length."""
    longest = max(map(len, frames))
    avih = struct.pack("<14I", 1_000_000 // RATE, longest * RATE, 0, 0x10, len(frames), 0, 1, longest, WIDTH, lines, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<10I", 0, 0, 0, 1, RATE, 0, len(frames), longest, 0xFFFFFFFF, 0) + struct.pack("<4H", 0, 0, WIDTH, lines)
    strf = struct.pack("<IiiHH4s5I", 40, WIDTH, lines, 1, 8, b"MJPG", WIDTH * lines, 0, 0, 0, 0)
    hdrl = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf)))
    info = _chunk(b"LIST", b"INFO" + _chunk(b"ICMT", b"%d %d" % (n_bytes, n_payload)))
    body, index, at = [], [], 4
    for f in frames:
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        body.append(_chunk(b"00dc", f))
        at += len(body[-1])
    rest = hdrl + info + _chunk(b"LIST", b"movi" + b"".join(body)) + _chunk(b"idx1", b"".join(index))
    return b"RIFF" + struct.pack("<I", len(rest) + 4) + b"AVI " + rest


def write_all(texts: list[bytes]) -> list[bytes]:
    """The media of each text."""
    padded = [t + b"\0" * ((-len(t)) % WIDTH if t else WIDTH) for t in texts]
    parts, ends, shapes, total = [], [], [], 0
    for p in padded:
        n = len(p) // WIDTH
        lines = min(n, LINES)
        count = -(-n // lines)
        parts.append(p + b"\0" * ((count * lines - n) * WIDTH))
        ends.append(total + lines * np.arange(1, count + 1))
        shapes.append((lines, count))
        total += count * lines
    data, cuts = scans(np.frombuffer(b"".join(parts), np.uint8).reshape(-1, WIDTH), np.concatenate(ends))
    cuts, heads, out, at, k = cuts.tolist(), {n: _head(n) for n, _ in shapes}, [], 0, 0
    for text, p, (lines, count) in zip(texts, padded, shapes, strict=True):
        frames = []
        for end in cuts[k : k + count]:
            frames.append(heads[lines] + data[at:end] + b"\xff\xd9")
            at = end
        k += count
        out.append(avi(frames, lines, len(text), len(p)))
    return out


def parse(media: bytes) -> tuple[list[tuple[int, int]], int, int, int]:
    """Where the index says the frames lie (start, end), lines of a frame, text and payload bytes."""
    if media[:4] != b"RIFF" or media[8:12] != b"AVI ":
        raise ValueError("no AVI file")
    movi, frames, lines, lengths = 0, [], 0, (0, 0)
    stack = [(12, 8 + struct.unpack_from("<I", media, 4)[0])]
    while stack:
        at, end = stack.pop()
        while at + 8 <= end:
            name, n = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
            if name == b"LIST" and media[at + 8 : at + 12] == b"movi":
                movi = at + 8
            elif name == b"LIST":
                stack.append((at + 12, at + 8 + n))
            elif name == b"strf":
                lines = struct.unpack_from("<i", media, at + 16)[0]
            elif name == b"ICMT":
                lengths = tuple(map(int, media[at + 8 : at + 8 + n].split()))
            elif name == b"idx1":
                frames = [(o, size) for _, _, o, size in struct.iter_unpack("<4sIII", media[at + 8 : at + 8 + n])]
            at += 8 + n + n % 2
    return [(movi + o + 8, movi + o + 8 + n) for o, n in frames], lines, *lengths


def decode_lines(data: np.ndarray, frame_starts: np.ndarray) -> np.ndarray:
    """Samples of all lines in entropy-coded ``data``."""
    diff, used = _decoder()
    after = np.append(data[1:], np.uint8(1))
    full = data == 0xFF
    marks = full & (after >= 0xD0) & (after <= 0xD7)
    drop = np.zeros(len(data) + 1, bool)
    drop[1:] = full & (after == 0) | marks
    drop[:-1] |= marks
    keep = ~drop[:-1]
    place = np.cumsum(keep) - keep
    starts = np.sort(np.concatenate([frame_starts, np.flatnonzero(marks) + 2]))
    at = place[starts].astype(np.int64) * 8
    clean = np.concatenate([data[keep], np.zeros(4, np.uint8)]).astype(np.uint32)
    words = (clean[:-3] << 24) | (clean[1:-2] << 16) | (clean[2:-1] << 8) | clean[3:]
    out = np.empty((len(starts), WIDTH), np.int16)
    for j in range(WIDTH):
        nxt = (words[at >> 3] >> (16 - (at & 7)).astype(np.uint32)) & 0xFFFF
        out[:, j] = diff[nxt]
        at += used[nxt]
    return (np.cumsum(out, axis=1, dtype=np.int32) + 128).astype(np.uint8)


def shots(histograms: np.ndarray, k: float = 3.0, floor: float = 0.25) -> list[int]:
    """First frames of the shots."""
    if len(histograms) < 2:
        return [0]
    share = histograms / np.maximum(histograms.sum(axis=1, keepdims=True), 1)
    change = np.abs(np.diff(share, axis=0)).sum(axis=1) / 2
    out, n, mean, spread = [0], 0, 0.0, 0.0
    for i, d in enumerate(change.tolist(), 1):
        if d > max(floor, mean + k * (spread / max(n - 1, 1)) ** 0.5 if n > 1 else floor):
            out.append(i)
            n, mean, spread = 0, 0.0, 0.0
        else:
            n += 1
            step = d - mean
            mean += step / n
            spread += step * (d - mean)
    return out


def read_all(medias: list[bytes]) -> list[dict]:
    """For each media: the payload read back, the text's bytes, and its shots (first frame, end frame)."""
    parsed = [parse(m) for m in medias]
    segments, starts, total = [], [], 0
    for m, (frames, lines, _, _) in zip(medias, parsed, strict=True):
        skip = len(_head(lines))
        for a, b in frames:
            segments.append(m[a + skip : b - 2])
            starts.append(total)
            total += b - 2 - a - skip
    samples = decode_lines(np.frombuffer(b"".join(segments), np.uint8), np.array(starts, np.int64))
    out, at = [], 0
    frame_lines = np.concatenate([np.full(len(f), lines) for f, lines, _, _ in parsed])
    if frame_lines.sum() != len(samples):
        raise ValueError("lines are missing")
    frame_of = np.repeat(np.arange(len(frame_lines)), frame_lines)
    bins = np.bincount((frame_of[:, None] * 16 + (samples >> 4)).ravel(), minlength=16 * len(frame_lines)).reshape(-1, 16)
    k = 0
    for frames, lines, n_bytes, n_payload in parsed:
        n = len(frames) * lines
        payload = samples[at : at + n].tobytes()[:n_payload]
        first = shots(bins[k : k + len(frames)])
        out.append({"n_bytes": n_bytes, "payload": payload, "frames": len(frames), "lines": lines, "shots": list(zip(first, [*first[1:], len(frames)], strict=True))})
        at, k = at + n, k + len(frames)
    return out


def store(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``media``, the AVI file of each whole text."""

    def run(batches):
        for batch in batches:
            for part in common.pieces(batch, "text", 2 << 20):
                media = write_all([t.encode() for t in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(media, pa.binary())], ["doc_id", "media"])

    return common.texts(docs).mapInArrow(run, "doc_id long, media binary")


def clips(stored: DataFrame) -> DataFrame:
    """One row per shot: ``doc_id clip start_ms end_ms frames``."""

    def run(batches):
        for batch in batches:
            for part in common.pieces(batch, "media", 2 << 20):
                rows = [
                    (doc_id, i, a * 1000 // RATE, b * 1000 // RATE, b - a)
                    for doc_id, got in zip(part.column("doc_id").to_pylist(), read_all(part.column("media").to_pylist()), strict=True)
                    for i, (a, b) in enumerate(got["shots"])
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "clip", "start_ms", "end_ms", "frames"])

    return stored.select("doc_id", "media").mapInArrow(run, "doc_id long, clip long, start_ms long, end_ms long, frames long")


def digest(stored: DataFrame) -> DataFrame:
    """What the stored media hold, read back: one row of digests and features per document."""

    def run(batches):
        for batch in batches:
            for part in common.pieces(batch, "media", 2 << 20):
                rows, medias = [], part.column("media").to_pylist()
                for doc_id, media, got in zip(part.column("doc_id").to_pylist(), medias, read_all(medias), strict=True):
                    p = got["payload"]
                    feature = f"{got['frames']}x{WIDTH}x{got['lines']}:" + ",".join(f"{a * 1000 // RATE}-{b * 1000 // RATE}" for a, b in got["shots"])
                    rows.append((doc_id, got["n_bytes"], len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    names = [x.split()[0] for x in schema.split(", ")]
    return stored.select("doc_id", "media").mapInArrow(run, schema)
