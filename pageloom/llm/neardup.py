"""MinHash near-duplicate detection by a signature-coordinate inverted join.

A document's set of word shingles gets a signature of ``COORDINATES`` minima.
Documents are posted under coordinate-value pairs ("tokens"), rarest first.
Two documents that agree in at least ``MATCHES`` coordinates share one of the
first ``COORDINATES - MATCHES + 1`` tokens of each, so only those are posted;
a document with more tokens that occur nowhere else than that leaves at once.

1. A central document, the hub, is compared with the members of each posting
   list.  Their links join most groups; what a component holds together is
   skipped from then on.
2. In lists of at most ``SMALL`` members, every pair across components is
   compared.
3. A longer list is never paired out.  Its members are described by what they
   do *not* have in common with the hub h: a member x *adds* shingles that h
   has not, and *lacks* some of h's.  Sets x and y of different components can
   only be similar enough if they add or lack something in common (otherwise
   both are as close to h, and linked with it).  What all members lack, h's own
   words, says nothing about them and needs no posting: its part of the overlap
   is bounded by how much each lacks.  So members are posted under what they
   add, prefix-filtered by the overlap that is then still needed, in order of
   rarity; under what they lack only for pairs that need add nothing in common,
   of which one adds little itself.  A list that is still long after that gets
   a hub of its own, its most central member, and is described anew.

Candidate pairs whose signatures collide ``MATCHES`` times are confirmed on the
full sets, which are made again from the texts.  A pair of the least
similarity (0.8) agrees in fewer than ``MATCHES`` of the coordinates with a
probability below 1e-6, a closer pair far more rarely.

Documents with equal sets form a class, compared once.  Both sides of each join
grow with the documents, so sort-merge joins are asked for at every size.

Rows: a null text, or one without words, has an empty set, links with nothing
and is its own component; a text with fewer words than a shingle is one
shingle; repeated rows are of one class and each gets its row; doc_id
identifies a document, and a row whose doc_id is null takes no part: its
component is null and it is kept; extra columns of the input are not carried,
whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, graph

COORDINATES, MATCHES = 64, 34
#: Rows of one hub or list in one group; further groups are salted.
GROUP = 1000
#: Lists of at most so many members are paired out across components.
SMALL = 32
#: Lists of differences with more members get a hub of their own, so many times at most.
HOT, ROUNDS = 64, 1

_RNG = np.random.default_rng(20)
BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
RADIX = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
PLACE = _RNG.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
XOR = _RNG.integers(1, 2**63, COORDINATES, dtype=np.uint64)
MULTIPLY = _RNG.integers(1, 2**63, COORDINATES, dtype=np.uint64) | np.uint64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLANK = np.zeros(256, bool)
BLANK[[32, *range(9, 14)]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def shingle_sets(texts: list[str], words: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's ``words``-word shingles."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = LOWER[np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)]
    edge = np.diff(np.concatenate([[True], BLANK[data]]).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    with np.errstate(over="ignore"):
        prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE[data] * powers(RADIX, len(data)), dtype=np.uint64)])
        own = mixed((prefix[end] - prefix[start]) * powers(INVERSE, len(data) + 1)[start] + (end - start).astype(np.uint64))
        bounds = np.searchsorted(start, np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])]))
        n = len(own)
        shingles = np.zeros(max(n - words + 1, 0), np.uint64)
        for k in range(words):
            shingles += own[k : k + len(shingles)] * PLACE[k]
        shingles = mixed(shingles)
        out = []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a >= words:
                out.append(np.unique(shingles[a : b - words + 1]))
            elif b > a:
                out.append(mixed((own[a:b] * PLACE[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def tokens(shingles: np.ndarray) -> np.ndarray:
    """The signature as hashes of its coordinate-value pairs."""
    least = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(shingles), 4096):
            least = np.minimum(least, ((shingles[at : at + 4096, None] ^ XOR) * MULTIPLY).min(axis=0))
        return mixed(least + np.arange(COORDINATES, dtype=np.uint64) * RADIX)


def signed(docs: DataFrame, words: int) -> DataFrame:
    """``doc_id n h1 h2 tokens``: the set's size, its 128-bit hash and its signature."""

    def run(batches):
        for batch in batches:
            for part in common.pieces(batch, "text", 2 << 20):
                sets = shingle_sets(part.column("text").to_pylist(), words)
                with np.errstate(over="ignore"):
                    h1 = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64)
                    h2 = np.array([mixed(s ^ RADIX).sum(dtype=np.uint64) for s in sets], np.uint64)
                signatures = np.concatenate([tokens(s) if len(s) else np.zeros(0, np.uint64) for s in sets]).view(np.int64)
                ends = np.cumsum([0] + [COORDINATES * (len(s) > 0) for s in sets])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(signatures))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), lists], ["doc_id", "n", "h1", "h2", "tokens"])

    return common.texts(docs).mapInArrow(run, "doc_id long, n long, h1 long, h2 long, tokens array<long>")


def banded(posted: DataFrame, percent: int) -> DataFrame:
    """``posted`` with the ``band`` and ``salt`` of its lists.

    A long list is parted by size: a band holds sizes within two steps of a
    factor 100 / ``percent`` and overlaps the next by one, so that similar sets
    meet in one band at least and a central member is never much larger than
    the others.
    """
    step = F.floor(F.log("n") / F.log(F.lit(100 / percent) + 1e-9)).cast("int")
    bands = F.when(F.col("df") > SMALL, F.array(step, step + 1)).otherwise(F.array(F.lit(-1)))
    return posted.withColumn("band", F.explode(bands)).withColumn("salt", F.pmod(F.xxhash64("rep"), F.ceil(F.col("df") / GROUP)).cast("int"))


def postings(classes: DataFrame, percent: int) -> DataFrame:
    """Posted tokens of the classes that can have a partner: ``token band salt rep n top size``.

    Tokens that occur once stand first in the order by rarity and meet nothing.
    ``top`` is the most central of the list's ``size`` members: how central it
    is, its id (negative, so that ties go to the smaller one) and its size.
    """
    each = classes.select("rep", "n", F.explode("tokens").alias("token"))
    shared = each.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1")
    ordered = each.join(shared.hint("merge"), "token").groupBy("rep", "n").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("own"), F.sum("df").alias("central"))
    ordered = ordered.filter(F.size("own") >= MATCHES)
    posted = ordered.select("rep", "n", "central", F.explode(F.slice("own", 1, F.size("own") - MATCHES + 1)).alias("t"))
    posted = banded(posted.select("t.token", "t.df", "rep", "n", "central"), percent)
    posted = common.written(posted, "posted")
    top = F.max(F.struct("central", (-F.col("rep")).alias("rep"), "n")).alias("top")
    lists = posted.groupBy("token", "band").agg(top, F.count("*").alias("size"), F.first("df").alias("df")).filter("size > 1")
    salts = F.explode(F.sequence(F.lit(0), F.ceil(F.col("df") / GROUP).cast("int") - 1)).alias("salt")
    lists = lists.select("token", "band", salts, "top", "size")
    return posted.drop("df", "central").join(lists.hint("merge"), ["token", "band", "salt"])


def central(long: DataFrame) -> DataFrame:
    """``a b``: a hub and each member of the long lists that it stands for.

    A list takes the most central hub that any list of its members has, so
    that most lists of a group get the same hub, which need not be in them.
    """
    best = long.groupBy("rep").agg(F.max("top").alias("best"))
    lists = long.join(best.hint("merge"), "rep").groupBy("token", "band").agg((-F.max("best")["rep"]).alias("a"), F.max("salt").alias("last"))
    lists = lists.select("token", "band", "a", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("salt"))
    return long.join(lists.hint("merge"), ["token", "band", "salt"]).filter("a <> rep").select("a", F.col("rep").alias("b")).distinct()


def matching(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows of ``pairs`` (``a b``) whose signatures agree in at least ``MATCHES`` coordinates.

    Coordinates are compared by 16 bits, which never loses a pair.
    """

    def run(batches):
        for batch in batches:
            left, right = (batch.column(c).flatten().to_numpy().reshape(-1, COORDINATES) for c in ("a_brief", "b_brief"))
            own = pa.array((left == right).sum(axis=1) >= MATCHES)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(own), batch.column("b").filter(own)], ["a", "b"])

    briefs = classes.select("rep", "brief").hint("merge")
    joined = pairs.join(briefs.toDF("a", "a_brief"), "a").join(briefs.toDF("b", "b_brief"), "b")
    return joined.select("a", "b", "a_brief", "b_brief").mapInArrow(run, "a long, b long")


def confirmed(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs (``a``: the hub, ``b``, ``n``: the size of its set), and whether they are ``linked``.

    Where ``wide``, ``adds`` has the shingles that only b has, and ``lacks``
    those that only the hub has.  Rows are grouped by hub, in salted groups of
    about ``GROUP``; a group's first row is the hub.
    """
    sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("salts"))
    hubs = sizes.select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("a").alias("b"), F.lit(False).alias("wide"))
    rest = pairs.join(sizes, "a").select("a", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), "b", "wide")
    rows = hubs.unionByName(rest).join(common.texts(docs).hint("merge"), F.col("b") == F.col("doc_id")).select("a", "salt", "b", "wide", "text")
    rows = rows.repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b") != F.col("a"))

    def table(found):
        *columns, adds, lacks = zip(*found, strict=True)
        lists = [pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [len(x) for x in own]), pa.int32()), pa.array(np.concatenate(own).view(np.int64))) for own in (adds, lacks)]
        return pa.RecordBatch.from_arrays([*map(pa.array, columns), *lists], ["a", "b", "n", "linked", "adds", "lacks"])

    def run(batches):
        hub, none = None, np.zeros(0, np.uint64)
        for batch in batches:
            for part in common.pieces(batch, "text", 2 << 20):
                sets = shingle_sets(part.column("text").to_pylist(), words)
                found, held = [], 0
                for a, b, wide, own in zip(part.column("a").to_pylist(), part.column("b").to_pylist(), part.column("wide").to_pylist(), sets, strict=True):
                    if a == b:
                        hub = own
                        continue
                    adds, lacks = np.setdiff1d(own, hub, assume_unique=True), np.setdiff1d(hub, own, assume_unique=True)
                    linked = (100 + percent) * (len(adds) + len(lacks)) <= (100 - percent) * (len(hub) + len(own))
                    found.append((a, b, len(own), linked, adds if wide else none, lacks if wide else none))
                    held += len(found[-1][-1]) + len(found[-1][-2])
                    if held > 1 << 20:
                        yield table(found)
                        found, held = [], 0
                if found:
                    yield table(found)

    return rows.mapInArrow(run, "a long, b long, n long, linked boolean, adds array<long>, lacks array<long>")


def rooted(df: DataFrame, roots: DataFrame, node: str) -> DataFrame:
    """``df`` with the ``root`` of the component that ``node`` is in."""
    return df.join(roots.select(F.col("node").alias(node), "root").hint("merge"), node, "left").withColumn("root", F.coalesce("root", node))


def across_small(lists: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a b`` across components of each list."""
    several = lists.groupBy("token").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x <> y").select("token")
    own = lists.join(several, "token")
    other = own.select("token", F.col("rep").alias("b"), F.col("n").alias("b_n"), F.col("root").alias("b_root"))
    alike = 100 * F.least("n", "b_n") >= percent * F.greatest("n", "b_n")
    pairs = own.join(other, "token").filter((F.col("rep") < F.col("b")) & (F.col("root") != F.col("b_root")) & alike)
    return pairs.select(F.col("rep").alias("a"), "b").distinct()


def described(gauged: DataFrame, percent: int) -> DataFrame:
    """Postings ``a element adds b n m h root left anchor`` of the members of each hub's group.

    ``gauged``: ``a`` (the hub), ``b``, ``n``, ``adds``, ``lacks``, ``root``
    (of b).  ``m`` and ``h`` are the sizes of what b adds and lacks.  With p for
    the share, similar x and y have |x \\ y| <= (1 - p) n(x), so that all but
    so many of x's additions are y's too; and x lacks at most (1 - p) n(y) <=
    (1 - p) / p n(x) that y does not lack.  Of a pair with overlap c, the first
    common element leaves at least c elements of either from there on.
    """
    m, h = F.size("adds").alias("m"), F.size("lacks").alias("h")
    each = gauged.select("a", "b", "n", m, h, "root", F.explode(F.array(F.struct(F.lit(True).alias("adds"), F.col("adds").alias("own")), F.struct(F.lit(False).alias("adds"), F.col("lacks").alias("own")))).alias("x"))
    each = each.select("a", "b", "n", "m", "h", "root", "x.adds", "x.own").withColumn("anchor", (100 + percent) * F.col("m") <= (100 - percent) * F.col("n"))
    each = each.filter(F.col("adds") | (100 * F.col("m") <= (100 - percent) * F.col("n")))
    own = each.select("a", "b", "n", "m", "h", "root", "adds", "anchor", F.explode("own").alias("element"))
    counted = own.groupBy("a", "element").agg(F.count("*").alias("df"), F.min("root").alias("x"), F.max("root").alias("y"), F.max(F.col("adds") | F.col("anchor")).alias("led"))
    live = counted.filter("x <> y and led").select("a", "element", "df")
    member = ("n", "m", "h", "root", "anchor")
    ordered = own.join(live, ["a", "element"]).groupBy("a", "b", "adds").agg(*(F.first(c).alias(c) for c in member), F.sort_array(F.collect_list(F.struct("df", "element"))).alias("own"))
    # elements that only one component has meet nothing and are left out of the order
    placed = ordered.select("a", "b", "adds", *member, F.size("own").alias("live"), F.posexplode("own").alias("at", "e"))
    needed = F.when(F.col("adds"), F.col("m") - F.col("n") * (100 - percent) / 100).otherwise(F.col("h") - F.col("n") * (100 - percent) / percent)
    left = (F.col("live") - F.col("at")).alias("left")
    return placed.select("a", F.col("e.element").alias("element"), "adds", "b", *member, left, needed.alias("needed")).filter(F.col("left") >= F.greatest(F.lit(1), F.ceil("needed"))).drop("needed")


def paired(placed: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a b`` across components that share an element of ``placed`` and can be similar enough."""
    other = placed.select("a", "element", *(F.col(c).alias(f"b_{c}") for c in ("b", "n", "m", "h", "root", "left", "anchor")))
    pairs = placed.join(other, ["a", "element"]).filter((F.col("root") != F.col("b_root")) & (F.col("adds") & (F.col("b") < F.col("b_b")) | ~F.col("adds") & F.col("anchor")))
    apart = F.col("m") + F.col("b_m") + F.abs(F.col("h") - F.col("b_h")) - 2 * F.least("left", "b_left")
    lacking = F.col("m") + F.col("b_m") + F.col("h") + F.col("b_h") - 2 * F.least("left", "b_left")
    enough = (100 + percent) * F.when(F.col("adds"), apart).otherwise(lacking) <= (100 - percent) * (F.col("n") + F.col("b_n"))
    alike = 100 * F.least("n", "b_n") >= percent * F.greatest("n", "b_n")
    return pairs.filter(enough & alike).select(F.least("b", "b_b").alias("a"), F.greatest("b", "b_b").alias("b")).distinct()


def rehubbed(hot: DataFrame) -> DataFrame:
    """``a b``: the hub of each list in ``hot``, its most central member, with every other member.

    Central is who has most in common with these lists and least beside it: of
    an outlier as hub, members of one template would all differ alike.  A list
    takes the most central hub that any list of its members has, so that lists
    of the same members share one.
    """
    beside = F.col("m") + F.col("h") - 2 * F.count("*").over(Window.partitionBy("a", "b"))
    lists = hot.withColumn("beside", beside).groupBy("a", "element").agg(F.min(F.struct("beside", "n", "b")).alias("least"))
    best = hot.join(lists, ["a", "element"]).groupBy("a", "b").agg(F.min("least").alias("best"))
    hubs = hot.join(best, ["a", "b"]).groupBy("a", "element").agg(F.min("best")["b"].alias("hub"))
    return hot.join(hubs, ["a", "element"]).filter("hub <> b").select(F.col("hub").alias("a"), "b").distinct()


def across_long(gauged: DataFrame, roots: DataFrame, docs: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Pairs ``a b`` across components among the sets compared with one hub, that can be similar enough; and the components by now.

    Lists of more than ``HOT`` members are taken out and described by a hub of
    their own, ``ROUNDS`` times at most (a second time was measured to part few
    lists more); what is then still long is paired.
    """
    pairs = None
    for turn in range(ROUNDS + 1):
        placed = common.written(described(rooted(gauged, roots, "b"), percent), "placed")
        sizes = placed.groupBy("a", "element").agg(F.count("*").alias("size"), F.min("root").alias("x"), F.max("root").alias("y")).filter("x <> y")
        hot = sizes.filter(F.col("size") > HOT).select("a", "element") if turn < ROUNDS else sizes.limit(0).select("a", "element")
        hot = common.written(hot, "hot")
        found = common.written(paired(placed.join(hot, ["a", "element"], "left_anti"), percent), "pairs")
        pairs = found if pairs is None else pairs.unionByName(found)
        if turn == ROUNDS or hot.isEmpty():
            common.dropped(placed, hot)
            return pairs.distinct(), roots
        stars = common.written(rehubbed(placed.join(hot, ["a", "element"])).withColumn("wide", F.lit(True)), "hubs")
        gauged = common.written(confirmed(stars, docs, words, percent), "gauged")
        roots = graph.components(gauged.filter("linked").select("a", "b"), roots)
        common.dropped(placed, hot, stars)
    raise AssertionError


def links(docs: DataFrame, classes: DataFrame, words: int, percent: int) -> DataFrame:
    """Components (``node root``) of the confirmed links, which connect every pair of similar classes, directly or through others."""
    posted = common.written(postings(classes, percent), "postings")
    hub, hub_n = -F.col("top.rep"), F.col("top.n")
    alike = 100 * F.least("n", hub_n) >= percent * F.greatest("n", hub_n)
    short = posted.filter((F.col("size") <= SMALL) & (F.col("rep") != hub) & alike).select(hub.alias("a"), F.col("rep").alias("b")).distinct()
    wide = common.written(central(posted.filter(F.col("size") > SMALL)), "hubs")
    near = matching(short.join(wide, ["a", "b"], "left_anti"), classes).withColumn("wide", F.lit(False))
    near = common.written(near.unionByName(wide.withColumn("wide", F.lit(True))), "near")
    gauged = common.written(confirmed(near, docs, words, percent), "gauged")
    roots = graph.components(gauged.filter("linked").select("a", "b"))

    small = common.written(rooted(posted.filter(F.col("size") <= SMALL).select(F.xxhash64("token", "band").alias("token"), "rep", "n"), roots, "rep"), "small")
    apart = gauged.filter((F.size("adds") > 0) | (F.size("lacks") > 0))
    known = near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    far, roots = across_long(apart, roots, docs, words, percent)
    open_ = across_small(small, percent).unionByName(far).distinct()
    open_ = common.written(open_.join(known, ["a", "b"], "left_anti"), "open")
    matched = common.written(matching(open_, classes).withColumn("wide", F.lit(False)), "matched")
    judged = common.written(confirmed(matched, docs, words, percent), "judged")
    common.dropped(posted, wide, small, near, gauged, open_, matched)
    return graph.components(judged.filter("linked").select("a", "b"), roots)


def components(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id n_shingles component_id kept`` of every document."""
    own = common.written(signed(docs, words), "signatures")
    classes = own.filter("n > 0 and doc_id is not null").groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("size"), F.min_by("tokens", "doc_id").alias("tokens"))
    brief = F.transform("tokens", lambda t: (t % 32768).cast("short"))
    classes = common.written(classes.withColumn("brief", brief), "classes")
    roots = links(docs, classes, words, percent)
    moved = classes.join(roots.hint("merge"), F.col("rep") == F.col("node"), "left").filter("size > 1 or root is not null")
    moved = common.written(moved.select("h1", "h2", "n", F.coalesce("root", "rep").alias("root")), "roots")
    joined = own.drop("tokens").join(moved.hint("merge"), ["h1", "h2", "n"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id"))
    return joined.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
