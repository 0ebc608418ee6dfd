"""Main text of web pages by two passes of rules over their blocks.

A page is read once into blocks: runs of text between block-level tags, with
the share of their characters that are links, the share of their words that
are stop words, and the section they stand in.  The first pass decides what it
can: text in navigation, footers, side bars, adverts, notices, forms and
comments is bad, and so are lists of links; long running text with stop words
is good.  The second pass settles the ambiguous rest, short blocks above all,
by the nearest decided neighbours before and after them, of the same section
first: where both sides agree that is the label, else the nearer one decides,
and ties go to the block before.

A section that the page itself declares as its article (``article``, ``main``
and the like) decides for blocks that have no decided neighbour within it;
there, too few stop words leave a block ambiguous instead of bad, so that
text in a language without a word list below stays.

Rows: a null or empty page, or one without main text, gives an empty text;
repeated rows and pages of one id are extracted each on their own; extra
columns are not carried, whatever their names; an empty table gives an empty
table.  A page is one row and is read in time linear in its length.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

# Frequent function words of the languages read here.
STOP_WORDS = frozenset(
    """
    a about after all also an and any are as at be because been but by can could did do for from had has have he her his how i if in into is
    it its me more my no not of on or other our she so some than that the their them then there these they this to up was we were what when
    which who will with would you your
    aber als am an auch auf aus bei bin bis das dass dem den der des die doch du durch ein eine einem einen einer er es für haben hat hatte ich
    ihr im in ist ja kann mit nach nicht noch nur oder sein sich sie sind so über um und uns vom von vor war was wenn wer werden wie wir wird
    zu zum zur
    au aux avec ce ces cette comme dans de des du elle elles en est et eux il ils je la le les leur lui ma mais me même mes moi mon ne nos notre
    nous on ou où par pas plus pour qu que qui sa se ses son sont sur ta tes toi ton tu un une vos votre vous été être
    al como con cuando del desde donde el ella ellos entre era esta este está fue ha hay la las lo los más me mi muy no nos o para pero por
    porque que se ser si sin sobre son su sus también te tiene todo un una y ya yo
    """.split()
)

# Elements by their part in a page.
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
UNSEEN = frozenset("applet audio button canvas datalist embed head iframe label map noembed noframes noscript object script select style svg template textarea title video".split())
RAW = frozenset("script style textarea title iframe noembed noframes noscript".split())
VOID = frozenset("area base br col embed frame hr img input keygen link meta param source track wbr".split())
BESIDE = frozenset("aside dialog fieldset footer form menu nav search".split())

# Words of class, id and role that say what an element is.
BESIDE_WORDS = frozenset(
    """
    ad ads adsense advert advertisement advertising adverts alert alertdialog author-box banner breadcrumb breadcrumbs comment comments commentlist consent contentinfo
    complementary cookie cookies copyright dialog discussion disqus footer footnav form gdpr login masthead menu menubar modal nav navbar navigation newsletter notice
    outbrain overlay pager pagination popup promo promoted promotion recommended related replies reply respond search share sharing sidebar signup skip social sponsor
    sponsored subscribe subscription taboola tags toolbar topbar widget widgets
    """.split()
)
WRAPPER_WORDS = frozenset("has no with without".split())
ARTICLE_NAMES = frozenset("article articlebody article-body article-content article-text blog-post entry-content post-body post-content story story-body storybody".split())
MAIN_NAMES = frozenset("content content-body main main-content maincontent page-content".split())

#: First pass: the least share of stop words of good text, and of text that may be good; characters of short and of long blocks; most link share.
MANY, SOME, SHORT, LONG, LINKS = 0.30, 0.15, 70, 200, 0.4

OPEN, MAIN, ARTICLE, BAD_PLACE = 0, 1, 2, 3
BAD, AMBIGUOUS, GOOD = -1, 0, 1

TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))"  # a comment; an open one takes the rest
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"']?[^\s>]*+))*+)(?:>|\Z)"
    r"|<[!?/][^>]*+(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=/>\"']++)\s*+(?:=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?")
WORD = re.compile(r"[^\W\d_]+")


class Block(NamedTuple):
    text: str
    tag: str
    section: int
    place: int
    links: int  # characters within links, white space not counted
    chars: int  # characters, white space not counted


def place_of(name: str, rest: str, above: int) -> int:
    """What an opening tag says about the text in it: an article, text beside it, or nothing new."""
    if above == BAD_PLACE or name in BESIDE or name == "header" and above == OPEN:
        return BAD_PLACE
    found: dict[str, str] = {}
    if "=" in rest or "hidden" in rest:
        for key, *values in ATTRIBUTE.findall(rest):
            found.setdefault(key.lower(), "".join(values))
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", found.get("style", ""), re.I):
        return BAD_PLACE
    names = set(html.unescape(" ".join(found.get(k, "") for k in ("class", "id", "role", "itemprop"))).lower().replace("_", "-").split())
    words = {w for x in names if not WRAPPER_WORDS & (own := set(x.split("-"))) for w in own}
    if name not in ("html", "body") and (words & BESIDE_WORDS or "header" in words and above == OPEN):
        return BAD_PLACE
    if name == "article" or ARTICLE_NAMES & names:
        return ARTICLE
    return MAIN if above == OPEN and (name == "main" or MAIN_NAMES & names) else above


class Reader:
    """Collects a page's blocks while its tags go by."""

    def __init__(self) -> None:
        self.blocks: list[Block] = []
        self.stack: list[tuple[str, int, int, bool]] = [("", OPEN, 0, True)]  # name, place, section, seen
        self.opened: Counter = Counter()
        self.sections, self.tag, self.in_link = 0, "", False
        self.parts: list[str] = []
        self.links = 0

    def close(self) -> None:
        """What was read since the last border is a block."""
        text = " ".join("".join(self.parts).split())
        if text:
            _, place, section, _ = self.stack[-1]
            self.blocks.append(Block(text, self.tag, section, place, self.links, len(text) - text.count(" ")))
        self.parts, self.links = [], 0

    def text(self, raw: str) -> None:
        if raw and self.stack[-1][3]:
            self.parts.append(html.unescape(raw) if "&" in raw else raw)
            if self.in_link:
                self.links += len("".join(self.parts[-1].split()))

    def pop(self, name: str) -> None:
        """Leave the innermost open element of this name and all in it; an inline one only within its block."""
        if not self.opened[name]:
            return
        k = len(self.stack) - 1
        while self.stack[k][0] != name:
            if name not in BLOCK and self.stack[k][0] in BLOCK:
                return
            k -= 1
        for last in self.stack[k:]:
            self.opened[last[0]] -= 1
        del self.stack[k:]

    def start(self, name: str, rest: str) -> None:
        if name == "a":
            self.in_link = "href" in rest.lower()
        if name in BLOCK:
            self.close()
            self.pop("p")  # a paragraph holds no block
            self.tag = name
        if name in VOID or rest.endswith("/") and name not in BLOCK and name != "a":
            return
        _, place, section, seen = self.stack[-1]
        inner = place_of(name, rest, place)
        if name not in BLOCK and inner != place:
            inner, seen = place, seen and inner != BAD_PLACE  # within a block: left out, or no border
        if inner != place or name in ("article", "main", "section"):
            self.sections += 1
            section = self.sections
        self.stack.append((name, inner, section, seen and name not in UNSEEN))
        self.opened[name] += 1

    def end(self, name: str) -> None:
        if name == "a":
            self.in_link = False
        if name in BLOCK:
            self.close()
            self.tag = ""
        self.pop(name)


def blocks_of(page: str) -> list[Block]:
    """The blocks of a page with visible text, in order."""
    reader, at = Reader(), 0
    while found := TOKEN.search(page, at):
        reader.text(page[at : found.start()])
        at = found.end()
        name = (found["name"] or "").lower()
        if name == "br":
            reader.text(" ")
        elif name and found["end"]:
            reader.end(name)
        elif name:
            reader.start(name, found["rest"])
            if name in RAW:
                end = re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I).search(page, at)
                at = end.start() if end else len(page)
    reader.text(page[at:])
    reader.close()
    return reader.blocks


def first_pass(block: Block) -> int:
    if block.place == BAD_PLACE:
        return BAD
    words = WORD.findall(block.text.lower())
    density = sum(w in STOP_WORDS for w in words) / max(1, len(words))
    if block.links > LINKS * block.chars:
        return AMBIGUOUS if block.place == ARTICLE and block.tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote") else BAD
    if len(block.text) < SHORT or block.tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
        return AMBIGUOUS
    if density >= MANY or density >= SOME and len(block.text) >= LONG:
        return GOOD
    return AMBIGUOUS if density >= SOME or block.place == ARTICLE else BAD


def second_pass(labels: np.ndarray, section: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Labels without ambiguous ones: each gets that of its nearest decided neighbours."""
    out = labels.copy()
    for own in (section, np.zeros_like(section)):
        open_ones = np.flatnonzero(out == AMBIGUOUS)
        if not len(open_ones):
            break
        order = np.lexsort((np.arange(len(out)), own))
        label, group = out[order], own[order]
        i = np.arange(len(out))
        before = np.maximum.accumulate(np.where(label != AMBIGUOUS, i, -1))
        after = np.minimum.accumulate(np.where(label != AMBIGUOUS, i, len(out))[::-1])[::-1]
        has_before = (before >= 0) & (group[before] == group)
        has_after = (after < len(out)) & (group[np.minimum(after, len(out) - 1)] == group)
        nearer_after = has_after & (~has_before | (order[np.minimum(after, len(out) - 1)] - order < order - order[before]))
        settled = np.where(nearer_after, label[np.minimum(after, len(out) - 1)], np.where(has_before, label[before], AMBIGUOUS))
        if own is section:  # an article decides for its blocks without neighbours
            settled = np.where((settled == AMBIGUOUS) & (place[order] == ARTICLE), GOOD, settled)
        new = np.empty_like(out)
        new[order] = np.where(label == AMBIGUOUS, settled, label)
        out = new
    return np.where(out == AMBIGUOUS, BAD, out)


def classified(page: str) -> list[tuple[Block, bool]]:
    """The page's blocks, each with whether it is main text.

    Where a page declares an article, or else a main part, text that stands
    outside of it is none; where it declares neither, the rules decide over all.
    """
    found = blocks_of(page)
    if not found:
        return []
    declared = max((b.place for b in found if b.place != BAD_PLACE), default=OPEN)
    if declared == MAIN:
        found = [b._replace(place=ARTICLE) if b.place == MAIN else b for b in found]
    place, section = (np.array([getattr(b, c) for b in found]) for c in ("place", "section"))
    labels = np.array([first_pass(b) for b in found])
    if declared != OPEN:
        labels[place == OPEN] = BAD
    return list(zip(found, (second_pass(labels, section, place) == GOOD).tolist(), strict=True))


def page_blocks(pages: DataFrame) -> DataFrame:
    """Every block of every page: ``page_id position text tag main``."""

    def run(batches):
        for batch in batches:
            for part in common.pieces(batch, "html"):
                for page_id, page in zip(part.column("page_id").to_pylist(), part.column("html").to_pylist(), strict=True):
                    own = classified(page or "")
                    columns = [pa.array([page_id] * len(own), pa.int64()), pa.array(range(len(own)), pa.int32()), pa.array([b.text for b, _ in own], pa.string()), pa.array([b.tag for b, _ in own], pa.string()), pa.array([m for _, m in own], pa.bool_())]
                    yield pa.RecordBatch.from_arrays(columns, ["page_id", "position", "text", "tag", "main"])

    return pages.select("page_id", "html").mapInArrow(run, "page_id long, position int, text string, tag string, main boolean")


def extract(pages: DataFrame) -> DataFrame:
    """Each page's main text, one block a line: ``page_id url text``."""

    def run(batches):
        for batch in batches:
            for part in common.pieces(batch, "html"):
                texts = ["\n".join(b.text for b, main in classified(page or "") if main) for page in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    out = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    return out.mapInArrow(run, "page_id long, url string, text string")
