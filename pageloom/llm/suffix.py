"""Removal of repeated byte strings, exact, by sampled anchors and induced suffix sorting.

Every window of ``LEAST`` bytes has an anchor: the gram of ``GRAM`` bytes with
the least hash in it.  Equal windows have equal anchors at the same place, so
only text around anchors that repeat is compared.

0. Of whole texts that are equal only the first is compared: what a copy
   holds, the first holds earlier.  A copy goes as a whole.
1. Each task lists the anchors of its texts, with the span of bytes that their
   windows cover and a hash of it.  Spans that repeat within the task are
   settled there, which thins hot groups before the shuffle.
2. Anchors are sorted by hash.  All but the first of equal spans are repeats;
   where an anchor has several distinct spans, the first of each is a context.
   A window holds one of four stretches around its anchor, so a context that
   agrees with no other in any of these is dropped.
3. Contexts are cut from the texts and brought together by anchor.  Their
   suffixes are put in order by induced sorting; of windows that agree in
   ``LEAST`` bytes with a neighbour all but the first are repeats.  An anchor
   with more than ``HOT`` contexts is split by the windows' own hashes.
4. Each text loses the bytes of its repeats.

Rows: a null text is empty; texts shorter than ``LEAST`` lose nothing; rows
that repeat a doc_id and text are one document, so that none is earlier than
another, and all are cut alike; a row without doc_id is compared with nothing
and left whole; extra columns of the input are not carried,
whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .induced import common_prefix, suffix_order
from .neardup import BYTE, INVERSE, RADIX, mixed, powers

LEAST, GRAM = 100, 24
#: Every window holds its anchor, some multiple k of these bytes before it, and 3 - k times as many behind.
SIDE = (LEAST - GRAM) // 4
#: Contexts of one anchor that are held to be compared by their sides; of more than that, all stay.
HELD = 1 << 17
#: Contexts of an anchor beyond which its windows are dealt by their own hashes.
HOT = 4000
#: Anchors settled together in a task, and bytes sorted together.
CHUNK, SHARD = 400_000, 2 << 20
#: Bytes whose anchors are found together.
STRIDE = 1 << 20
PLACE_BITS = 22
_POWERS = powers(RADIX, STRIDE + 4 * LEAST), powers(INVERSE, STRIDE + 4 * LEAST)


def _prefix(data: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE[data] * _POWERS[0][: len(data)], dtype=np.uint64)])


def _window_hash(prefix: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mixed((prefix[b] - prefix[a]) * _POWERS[1][a])


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Anchor hash, packed span hash, anchor's place, text number, and sides, of texts that lie end to end in ``data``.

    The packed value holds 50 bits of the span's hash, the anchor's distance
    from the first window's start, and the number of windows less one.  Sides
    are 16 bits each of the hashes of four stretches of the anchor with 0 to 3
    times ``SIDE`` bytes before it and the rest behind, 0 where the text ends.
    """
    n = len(data)
    if n < LEAST:
        return (np.zeros(0, np.int64),) * 5
    with np.errstate(over="ignore"):
        prefix = _prefix(data)
        gram = mixed((prefix[GRAM:] - prefix[:-GRAM]) * _POWERS[1][: n - GRAM + 1])
        key = (gram >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS)) | np.arange(len(gram), dtype=np.uint64)
        width, have = LEAST - GRAM + 1, 1
        while have * 2 <= width:
            key = np.minimum(key[:-have], key[have:])
            have *= 2
        if have < width:
            key = np.minimum(key[: len(key) - (width - have)], key[width - have :])
        place = (key & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
        text = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))[: len(place)]
        inside = np.arange(len(place)) + LEAST <= ends[text]
        fresh = np.concatenate([[True], (place[1:] != place[:-1]) | (text[1:] != text[:-1]) | (inside[1:] != inside[:-1])])
        low = np.flatnonzero(fresh)
        high = np.append(low[1:], len(place)) - 1
        low, high = low[inside[low]], high[inside[low]]
        at = place[low]
        span = _window_hash(prefix, low, high + LEAST)
        packed = (span >> np.uint64(14) << np.uint64(14)) | ((at - low).astype(np.uint64) << np.uint64(7)) | (high - low).astype(np.uint64)
        own = text[low]
        begin, end = ends[own - 1] * (own > 0), ends[own]
        side = np.zeros(len(at), np.uint64)
        for k in range(4):
            a, b = at - k * SIDE, at + GRAM + (3 - k) * SIDE
            part = _window_hash(prefix, np.maximum(a, 0), np.minimum(b, n)) >> np.uint64(48) | np.uint64(1)
            side = side << np.uint64(16) | np.where((a >= begin) & (b <= end), part, np.uint64(0))
        return gram[at].view(np.int64), packed.view(np.int64), at, own, side.view(np.int64)


def _paired(a, side):
    """Whether each context has another of its anchor that is equal in one of the four stretches."""
    out = np.zeros(len(a), bool)
    with np.errstate(over="ignore"):
        for k in range(4):
            part = side.view(np.uint64) >> np.uint64(16 * k) & np.uint64(0xFFFF)
            some = np.flatnonzero(part)
            key = mixed(a[some].view(np.uint64) + part[some] * RADIX)
            order = np.argsort(key)
            alike = key[order][1:] == key[order][:-1]
            out[some[order[1:][alike]]] = out[some[order[:-1][alike]]] = True
    return out


def _batches(texts: list[bytes]):
    """Groups (data, ends, text numbers, starts in their texts) of about ``STRIDE`` bytes; a longer text comes in overlapping parts."""
    group, total = [], 0
    for i, t in enumerate(texts):
        for start in range(0, max(len(t) - LEAST + 1, 0), STRIDE):
            part = t[start : start + STRIDE + LEAST - 1]
            if group and total + len(part) > STRIDE:
                yield group
                group, total = [], 0
            group.append((i, start, part))
            total += len(part)
    if group:
        yield group


def _settle(a, w, doc, at, side):
    """First of equal spans, and the intervals of the rest, merged where they touch."""
    order = np.lexsort((at, doc, w, a))
    a, w, doc, at, side = a[order], w[order], doc[order], at[order], side[order]
    fresh = np.concatenate([[True], (a[1:] != a[:-1]) | (w[1:] != w[:-1]) | (doc[1:] != doc[:-1]) | (at[1:] != at[:-1])])
    a, w, doc, at, side = a[fresh], w[fresh], doc[fresh], at[fresh], side[fresh]  # of a repeated row, one
    again = np.concatenate([[False], (a[1:] == a[:-1]) & (w[1:] == w[:-1])])
    start = at[again] - ((w[again] >> 7) & 127)
    return (a[~again], w[~again], doc[~again], at[~again], side[~again]), _union(doc[again], start, start + (w[again] & 127) + LEAST)


def _union(doc, start, end):
    """Intervals of each document, merged."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    new_doc = np.concatenate([[True], doc[1:] != doc[:-1]])
    number = np.cumsum(new_doc) - 1
    span = int(end.max()) + 1
    reach = np.maximum.accumulate(end + number * span) - number * span
    fresh = new_doc.copy()
    fresh[1:] |= start[1:] > reach[:-1]
    first = np.flatnonzero(fresh)
    return doc[first], start[first], reach[np.append(first[1:], len(doc)) - 1]


def listed(docs: DataFrame) -> DataFrame:
    """``kind a w doc_id at side``: anchors (kind 0), and intervals settled in the task (kind 1: doc_id, w: start, at: end)."""

    def rows(held):
        first, (d, s, e) = _settle(*(np.concatenate(x) for x in zip(*held, strict=True)))
        yield _table(np.zeros(len(first[0]), np.int32), *first)
        if len(d):
            yield _table(np.ones(len(d), np.int32), mixed(d.view(np.uint64)).view(np.int64), s, d, e, np.zeros(len(d), np.int64))

    def run(batches):
        held, count = [], 0
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            for group in _batches([t.encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]):
                data = np.frombuffer(b"".join(g[2] for g in group), np.uint8)
                ends = np.cumsum([len(g[2]) for g in group])
                a, w, at, own, side = anchors(data, ends)
                number, shift = np.array([g[0] for g in group]), np.array([g[1] for g in group]) - np.concatenate([[0], ends[:-1]])
                held.append((a, w, ids[number[own]], at + shift[own], side))
                count += len(a)
                if count >= CHUNK:
                    yield from rows(held)
                    held, count = [], 0
        if count:
            yield from rows(held)

    return common.texts(docs.filter(F.col("doc_id").isNotNull())).mapInArrow(run, "kind int, a long, w long, doc_id long, at long, side long")


def _table(*columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], ["kind", "a", "w", "doc_id", "at", "side"][: len(columns)])


def matched(anchored: DataFrame) -> DataFrame:
    """Repeats (kind 1: doc_id, w: start, at: end) and contexts (kind 2: a, w, doc_id, at)."""

    def run(batches):
        held = [np.zeros(0, np.int64)] * 5  # first-of-its-span rows of the anchor that came last
        whole = last = None  # an anchor whose contexts all stay; the last first-of-its-span row

        def several(rows, keep):
            if keep.any():
                yield _table(np.full(keep.sum(), 2, np.int32), *(x[keep] for x in rows[:4]))

        for batch in batches:
            kind, *rows = (batch.column(c).to_numpy() for c in ("kind", "a", "w", "doc_id", "at", "side"))
            known = kind == 1
            if known.any():
                yield _table(kind[known], *(x[known] for x in rows[:4]))
            a, w, doc, at, side = (x[~known] for x in rows)
            if not len(a):
                continue
            if last is not None:
                a, w, doc, at, side = (np.concatenate([[x], y]) for x, y in zip(last, (a, w, doc, at, side), strict=True))
            alike = (a[1:] == a[:-1]) & (w[1:] == w[:-1])
            twice = alike & (doc[1:] == doc[:-1]) & (at[1:] == at[:-1])  # a repeated row
            own = np.concatenate([[last is None], ~twice])
            again = np.concatenate([[False], alike])[own]
            last = a[-1], w[-1], doc[-1], at[-1], side[-1]
            a, w, doc, at, side = (x[own] for x in (a, w, doc, at, side))
            if not len(a):
                continue
            if again.any():
                start = at[again] - ((w[again] >> 7) & 127)
                d, s, e = _union(doc[again], start, start + (w[again] & 127) + LEAST)
                yield _table(np.ones(len(d), np.int32), np.zeros(len(d), np.int64), s, d, e)
            rows = [np.concatenate([x, y[~again]]) for x, y in zip(held, (a, w, doc, at, side), strict=True)]
            if not len(rows[0]):
                continue
            ended = int(np.flatnonzero(rows[0] != rows[0][-1])[-1]) + 1 if rows[0][0] != rows[0][-1] else 0
            done, held = [x[:ended] for x in rows], [x[ended:] for x in rows]
            yield from several(done, _paired(done[0], done[4]) | (done[0] == whole))
            if len(held[0]) > HELD or held[0][0] == whole:
                whole = held[0][0]
                yield from several(held, np.ones(len(held[0]), bool))
                held = [x[:0] for x in held]
        yield from several(held, _paired(held[0], held[4]))

    n = int(anchored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = anchored.repartition(n, "a").sortWithinPartitions("a", "w", "doc_id", "at")
    return dealt.mapInArrow(run, "kind int, a long, w long, doc_id long, at long")


def contexts(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``shard doc_id start n text``: spans cut from the texts; ``n`` windows begin in each, from byte ``start`` on.

    ``shard`` is the anchor, or for a hot anchor the hash of a single window.
    A window that repeats within the task is settled there: its row has no text.
    """
    own = found.filter("kind = 2")
    hot = own.groupBy("a").count().filter(F.col("count") > HOT).select("a", F.lit(1).alias("hot"))
    own = own.join(hot, "a", "left").select("doc_id", F.struct("at", "a", "w", F.coalesce("hot", F.lit(0)).alias("hot")).alias("c"))
    own = own.groupBy("doc_id").agg(F.collect_list("c").alias("cs"))

    def run(batches):
        for batch in batches:
            for part in common.pieces(batch, "text", 2 << 20):
                rows, windows = [], {}
                for doc, text, cs in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text", "cs")), strict=True):
                    data = text.encode("utf-8", "surrogatepass")
                    for c in cs:
                        start, n = c["at"] - ((c["w"] >> 7) & 127), (c["w"] & 127) + 1
                        if not c["hot"]:
                            rows.append((c["a"], doc, start, n, data[start : start + n - 1 + LEAST]))
                            continue
                        for s in range(start, start + n):
                            own = data[s : s + LEAST]
                            first = windows.get(own)
                            windows[own] = min(first, (doc, s)) if first else (doc, s)
                            if first and first != (doc, s):
                                rows.append((0, *max(first, (doc, s)), 1, None))
                for own, (doc, s) in windows.items():
                    rows.append((int.from_bytes(hashlib.blake2b(own, digest_size=8).digest(), "little", signed=True), doc, s, 1, own))
                if rows:
                    kinds = (pa.int64(),) * 4 + (pa.binary(),)
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["shard", "doc_id", "start", "n", "text"])

    joined = common.texts(docs).join(own, "doc_id").select("doc_id", "text", "cs")
    return joined.mapInArrow(run, "shard long, doc_id long, start long, n long, text binary")


def repeats(doc: np.ndarray, start: np.ndarray, n: np.ndarray, texts: list[bytes], budget: int = 64 << 20):
    """Intervals of the windows that an earlier one among the spans equals."""
    data = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
    begin = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
    owner = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])
    offset = np.arange(len(data)) - begin[owner]
    symbols = data.astype(np.int16) + 1
    symbols[begin + [len(t) for t in texts]] = 0
    order = suffix_order(symbols, LEAST, budget)
    order = order[offset[order] < n[owner[order]]]
    same = common_prefix(data, order[1:], order[:-1], LEAST)
    group = np.cumsum(np.concatenate([[False], ~same]))
    own_doc, own_start = doc[owner[order]], start[owner[order]] + offset[order]
    by = np.lexsort((own_start, own_doc, group))
    group, own_doc, own_start = group[by], own_doc[by], own_start[by]
    fresh = np.concatenate([[True], (group[1:] != group[:-1]) | (own_doc[1:] != own_doc[:-1]) | (own_start[1:] != own_start[:-1])])
    group, own_doc, own_start = group[fresh], own_doc[fresh], own_start[fresh]
    again = np.concatenate([[False], group[1:] == group[:-1]])
    d, s = own_doc[again], own_start[again]
    return _union(d, s, s + LEAST)


def resolved(spans: DataFrame, budget: int = 64 << 20) -> DataFrame:
    """``doc_id start end`` of the repeats among contexts."""

    def run(batches):
        held, size, last = [], 0, None
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("shard", "doc_id", "start", "n", "text")), strict=True):
                if size > SHARD and row[0] != last:
                    yield settled(held)
                    held, size = [], 0
                last = row[0]
                held.append(row)
                size += len(row[4])
        if held:
            yield settled(held)

    def settled(held):
        _, doc, start, n, texts = zip(*held, strict=True)
        d, s, e = repeats(np.array(doc), np.array(start), np.array(n), list(texts), budget)
        return pa.RecordBatch.from_arrays([pa.array(d), pa.array(s), pa.array(e)], ["doc_id", "start", "end"])

    partitions = int(spans.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = spans.filter("text is not null").repartition(partitions, "shard").sortWithinPartitions("shard")
    known = spans.filter("text is null").select("doc_id", "start", (F.col("start") + LEAST).alias("end"))
    return dealt.mapInArrow(run, "doc_id long, start long, end long").unionByName(known)


def firsts(docs: DataFrame) -> DataFrame:
    """``doc_id`` of the first of each group of equal texts; the others are copies."""
    own = common.texts(docs.filter(F.col("doc_id").isNotNull())).groupBy(F.unhex(F.sha2("text", 256)).alias("key")).agg(F.min("doc_id").alias("doc_id"))
    return own.select("doc_id").distinct()


def intervals(docs: DataFrame) -> DataFrame:
    """``doc_id start end``: every byte that a repeated window covers lies in one of these."""
    found = common.written(matched(listed(docs)), "matched")
    spans = common.written(contexts(docs, found), "contexts")
    known = found.filter("kind = 1").select("doc_id", F.col("w").alias("start"), F.col("at").alias("end"))
    return known.unionByName(resolved(spans))


def cut(docs: DataFrame, *keep: str, as_text: bool = False) -> DataFrame:
    """Per document ``doc_id``, the columns ``keep``, the ``kept`` bytes, ``n_bytes n_removed n_spans``.

    With ``as_text`` the kept bytes are text; what is left of a character cut
    in half goes too.
    """
    first = common.written(firsts(docs), "firsts").hint("merge")
    own = intervals(docs.join(first, "doc_id", "left_semi")).unionByName(first.select("doc_id", F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("end")))
    own = own.groupBy("doc_id").agg(F.collect_set(F.struct("start", "end")).alias("cuts"))  # a copy has none, others at least an empty one
    joined = common.texts(docs, *keep).join(own, "doc_id", "left")

    def run(batches):
        for batch in batches:
            for part in common.pieces(batch, "text", 4 << 20):
                kept, rows = [], []
                for doc, text, cuts in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text", "cuts")), strict=True):
                    data, out, at, removed, n = text.encode("utf-8", "surrogatepass"), [], 0, 0, 0
                    if cuts is None and doc is not None and len(data) >= LEAST:
                        cuts = [{"start": 0, "end": len(data)}]
                    for c in sorted((c["start"], c["end"]) for c in cuts or ()):
                        a, b = max(c[0], at), c[1]
                        if b <= a:
                            continue
                        n += c[0] > at or n == 0
                        out.append(data[at:a])
                        removed += b - a
                        at = b
                    out.append(data[at:])
                    kept.append(b"".join(out))
                    rows.append((len(data), removed, n))
                own_kept = pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string()) if as_text else pa.array(kept, pa.binary())
                counts = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(part.column(c) for c in keep), own_kept, *counts], ["doc_id", *keep, "kept", "n_bytes", "n_removed", "n_spans"])

    schema = joined.select("doc_id", *keep).schema
    for name, kind in (("kept", "string" if as_text else "binary"), ("n_bytes", "long"), ("n_removed", "long"), ("n_spans", "long")):
        schema = schema.add(name, kind)
    return joined.mapInArrow(run, type(schema)(schema.fields))
