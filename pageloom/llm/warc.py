"""WARC archives and their globally ordered capture index.

Pages are written as gzip members of WARC archives, one archive per task;
among records of equal payload the one with the largest page_id is a response
and the others revisit it.  Archives are kept as a table of members in the
shared folder: ``archive``, ``offset`` in it, and ``member``; the members of an
archive in order of offset are a valid ``.warc.gz`` file.

The index is built from what is read back.  Each task sorts the entries of its
members, ``RUN`` at a time (a capture run), by URL key, timestamp and page_id,
and cuts each run at the borders of key ranges into blocks.  For each range one task merges the
runs with a loser tree; blocks arrive in the order of their first keys, so that
one block of a run is open at a time.  A URL captured very often is cut by
timestamp like any other keys.

Rows: a null html is an empty payload, a null url the empty key; a row without
page_id is a response that no other refers to, and comes first among equal
keys; a capture's date follows from its page_id, of any size, going round after
``SPAN`` seconds; rows that repeat a page_id with the same payload are of the
same type; extra columns of
the input are not carried, whatever their names; an empty table gives an empty
table.
"""

from __future__ import annotations

import base64
import bisect
import datetime
import hashlib
import zlib
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

EPOCH, SPAN = datetime.datetime(2020, 1, 1), 1 << 31
#: Index entries that are sorted together.
RUN = 100_000
ENTRY = "url_key string, captured string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long"
NAMES = [x.split()[0] for x in ENTRY.split(", ")]
TYPES = [pa.int64() if x.endswith("long") else pa.string() for x in ENTRY.split(", ")]
KEY = NAMES[:3]


def place(row: tuple) -> tuple:
    """What entries are ordered by; no page_id comes before any."""
    return row[0], row[1], row[2] is not None, row[2] or 0


def url_key(url: str) -> str:
    """Sortable key: reversed host, then path and query."""
    try:
        parts = urlsplit(url.strip())
        host = (parts.hostname or "").removeprefix("www.")
    except ValueError:
        return url.lower()
    query = f"?{parts.query}" if parts.query else ""
    return ",".join(reversed(host.split("."))) + ")" + (parts.path or "/").lower() + query.lower()


def record(page_id: int | None, url: str, payload: bytes, refers_to: int | None) -> bytes:
    """A WARC record; a revisit has its payload's digest and length, but no payload."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    kind = "response" if refers_to is None else "revisit"
    date = (EPOCH + datetime.timedelta(seconds=(page_id or 0) % SPAN)).strftime("%Y-%m-%dT%H:%M:%SZ")
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block += payload if refers_to is None else b""
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}", f"WARC-Target-URI: {url.translate({10: ' ', 13: ' '})}", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return ("WARC/1.1\r\n" + "\r\n".join(head) + "\r\n\r\n").encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of an unpacked record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    n = int(fields["Content-Length"])
    if len(rest) != n + 4:
        raise ValueError("a WARC record is cut short")
    return fields, rest[:n]


def entry(fields: dict[str, str], block: bytes, archive: str, offset: int) -> tuple:
    """The index entry of a record, its digest checked where it holds its payload."""
    head, _, payload = block.partition(b"\r\n\r\n")
    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
    n_bytes = int(head.rpartition(b"Content-Length: ")[2])
    if kind == "response" and (len(payload) != n_bytes or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError("a payload differs from its digest")
    number = lambda name: int(n) if (n := fields[name].rpartition(":")[2].rstrip(">")) else None
    return url_key(fields["WARC-Target-URI"]), fields["WARC-Date"], number("WARC-Record-ID"), n_bytes, digest, kind, number("WARC-Refers-To") if kind == "revisit" else None, archive, offset


def digest() -> Column:
    return F.sha1(F.coalesce(F.col("html"), F.lit("")).cast("binary"))


def revisits(pages: DataFrame) -> DataFrame:
    """``page_id``, ``digest`` and ``refers_to`` of the records that repeat another's payload.

    A page_id can come with several payloads, so that the digest is part of the key.
    """
    keyed = common.written(pages.select("page_id", digest().alias("digest")), "digests")
    kept = keyed.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return keyed.join(kept, "digest").filter("page_id < refers_to").select("page_id", "digest", "refers_to").distinct()


def write(pages: DataFrame) -> DataFrame:
    """The table of archives: ``archive offset member``."""

    def run(batches):
        archive, at = f"pages-{TaskContext.get().partitionId():06d}.warc.gz", 0
        for batch in batches:
            for part in common.pieces(batch, "html"):
                members = [member(record(i, u, h.encode(), r)) for i, u, h, r in zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to")), strict=True)]
                offsets = []
                for m in members:
                    offsets.append(at)
                    at += len(m)
                yield pa.RecordBatch.from_arrays([pa.array([archive] * len(members), pa.string()), pa.array(offsets, pa.int64()), pa.array(members, pa.binary())], ["archive", "offset", "member"])

    own = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"), digest().alias("digest"))
    again = common.written(revisits(pages), "revisits")
    return common.written(own.join(again, ["page_id", "digest"], "left").mapInArrow(run, "archive string, offset long, member binary"), "archives")


def read(archives: DataFrame) -> DataFrame:
    """Index entries of all records, in the order of the archives' members."""

    def run(batches):
        for batch in batches:
            for part in common.pieces(batch, "member", 2 << 20):
                rows = [entry(*parse(zlib.decompress(m, 31)), a, o) for a, o, m in zip(*(c.to_pylist() for c in part.columns), strict=True)]
                yield table(rows)

    return archives.select("archive", "offset", "member").mapInArrow(run, ENTRY)


def table(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(NAMES), TYPES, strict=True)], NAMES)


class LoserTree:
    """Merges sorted runs; runs can be added while it yields."""

    def __init__(self):
        self.runs: list[tuple[list, int]] = []
        self.heads: list = []
        self.losers: list[int] = []
        self.winner = -1

    def add(self, run: list) -> None:
        self.heads.append(place(run[0]))
        self.runs.append((run, 0))
        self._build()

    def _less(self, a: int, b: int) -> bool:
        """Whether run ``a`` comes before run ``b``; -1 and used-up runs come last."""
        if a < 0 or self.heads[a] is None:
            return False
        return b < 0 or self.heads[b] is None or (self.heads[a], a) < (self.heads[b], b)

    def _build(self) -> None:
        live = [i for i, h in enumerate(self.heads) if h is not None]
        self.heads, self.runs = [self.heads[i] for i in live], [self.runs[i] for i in live]
        n = len(live)
        self.losers = [-1] * max(n, 1)
        best = [-1] * n + list(range(n))
        for node in range(n - 1, 0, -1):
            a, b = best[2 * node], best[2 * node + 1]
            best[node], self.losers[node] = (a, b) if self._less(a, b) else (b, a)
        self.winner = best[1] if n > 1 else n - 1

    def head(self):
        return self.heads[self.winner] if self.winner >= 0 else None

    def pop(self):
        """The least entry; the matches on its run's path are played again."""
        i = self.winner
        run, at = self.runs[i]
        out, at = run[at], at + 1
        self.runs[i] = run, at
        self.heads[i] = place(run[at]) if at < len(run) else None
        node = (i + len(self.runs)) // 2
        while node:
            if self._less(self.losers[node], i):
                i, self.losers[node] = self.losers[node], i
            node //= 2
        self.winner = i
        if self.heads[i] is None:
            self._build()
        return out


def merged(blocks):
    """Entries of sorted blocks in order; blocks come in the order of their first keys."""
    tree = LoserTree()
    for block in blocks:
        while (head := tree.head()) is not None and head < place(block[0]):
            yield tree.pop()
        tree.add(block)
    while tree.head() is not None:
        yield tree.pop()


def merge_index(entries: DataFrame, rows_per_range: int = 1_000_000, block: int = 1024, samples_per_range: int = 24) -> DataFrame:
    """Entries in global order: ``key_range`` and ``position`` in it, then the columns of ``ENTRY``.

    Borders of the key ranges come from a sample of ``samples_per_range`` keys
    for each range of about ``rows_per_range`` rows, the only thing that goes to
    the driver (some 4 KB for a million entries); they shape the work alone, not
    the result.
    """
    spark = entries.sparkSession
    n = entries.count()
    ranges = max(1, -(-n // rows_per_range), min(int(spark.conf.get("spark.sql.shuffle.partitions")), n // 1000))
    share = min(1.0, ranges * samples_per_range * 1.5 / max(n, 1))
    keys = sorted(place(tuple(r)) for r in entries.select(*KEY).sample(share, seed=7).collect())
    borders = [keys[len(keys) * i // ranges] for i in range(1, ranges)] if keys else []

    def runs(batches):
        rows = []
        for batch in batches:
            rows += zip(*(batch.column(c).to_pylist() for c in NAMES), strict=True)
            if len(rows) >= RUN:
                yield from cut(rows)
                rows = []
        if rows:
            yield from cut(rows)

    def cut(rows):
        rows.sort(key=place)
        at, held = 0, []
        for r, border in enumerate([*borders, None]):
            end = len(rows) if border is None else bisect.bisect_left(rows, border, at, key=place)
            for i in range(at, end, block):
                own = rows[i : min(i + block, end)]
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, pa.schema(list(zip(NAMES, TYPES, strict=True)))) as out:
                    out.write_batch(table(own))
                held.append((r, *own[0][:3], sink.getvalue().to_pybytes()))
            at = end
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), (pa.int32(), pa.string(), pa.string(), pa.int64(), pa.binary()), strict=True)], ["key_range", *KEY, "block"])

    def merge(batches):
        def blocks(open_range):
            while ahead and ahead[0][0] == open_range:
                _, data = ahead.pop()
                with pa.ipc.open_stream(data) as stream:
                    got = stream.read_all()
                yield list(zip(*(got.column(c).to_pylist() for c in NAMES), strict=True))
                ahead.extend([x] if (x := next(incoming, None)) else [])

        incoming = ((r, b) for batch in batches for r, b in zip(batch.column("key_range").to_pylist(), batch.column("block").to_pylist(), strict=True))
        ahead = [x] if (x := next(incoming, None)) else []
        while ahead:
            own, rows, position = ahead[0][0], [], 0
            for row in merged(blocks(own)):
                rows.append(row)
                if len(rows) == 4096:
                    yield numbered(own, position, rows)
                    position, rows = position + len(rows), []
            if rows:
                yield numbered(own, position, rows)

    def numbered(own, position, rows):
        got = table(rows)
        return pa.RecordBatch.from_arrays([pa.array([own] * len(rows), pa.int32()), pa.array(range(position, position + len(rows)), pa.int64()), *got.columns], ["key_range", "position", *NAMES])

    blocked = entries.mapInArrow(runs, "key_range int, url_key string, captured string, page_id long, block binary")
    dealt = blocked.repartition(ranges, "key_range").sortWithinPartitions("key_range", *KEY)
    return dealt.select("key_range", "block").mapInArrow(merge, "key_range int, position long, " + ENTRY)


def capture_histories(pages: DataFrame) -> DataFrame:
    """Write archives of ``pages``, read them back, and return the merged index."""
    return merge_index(common.written(read(write(pages)), "index"))
