"""Main text of web pages: page structure and a suffix array over each host's pages.

A page is cut into blocks, each with the zone of its innermost marked element:
``main`` (article, main and their like), ``chrome`` (menus, headers, footers,
sidebars, notices, adverts, forms, reader comments), ``doubt`` (within main, with
a name that may mean chrome, as in "related-work") or ``open``.  The words
outside the main zone are the page's token stream.  The streams of a host are
concatenated, with a break between pages, and their suffixes are sorted by
their first ``RUN`` words by prefix doubling; neighbours in that order that
agree in all of them and lie on distinct pages are repeats.  Pages that are
asked about and have ``COPIES`` % of their shingles in common are one page
here, so copies don't take each other's text; a page without a host has no
repeats.  A page's text is its main zone, or its open blocks if it has none; of
blocks in doubt and of open ones those words stay that no repeat covers, so what
a host repeats from page to page goes and unique runs stay.  Text that is
plainly in the main zone is never removed for being repeated.

A host is dealt out in shards of about ``SHARD`` words.  Shards of one host
hand on the grams they hold with the first and last page of each, and a gram is
repeated if these differ over all shards: the result is the same as for one
array, and no task holds a host of any size.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from itertools import compress

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import gram_hashes, stored, text_batches, word_hashes
from .near_dedup import near_duplicates

RUN = 8
SHARD = 1 << 16
#: Per cent of the five-word shingles of two pages' texts that are the same in copies.
COPIES = 80

# Element and class names of HTML.
_BLOCK = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_RAW = "script|style|textarea|title|iframe"
_SKIPPED = set("template noscript svg annotation annotation-xml object canvas video audio select button".split())
#: Of these, one may stand within another.
_NESTED = {"template", "object"}
_CHROME_TAGS = set("nav footer aside form dialog menu head".split())
_CHROME_ROLES = set("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar note".split())
_CHROME_WORDS = set("ad ads adv advert advertisement advertising advertorial banner sponsor sponsored promo promotion sidebar aside cookie cookies consent gdpr notice notices alert comment comments commentlist discussion disqus replies respond share sharing social related recommended newsletter subscribe subscription signup popup modal overlay pagination pager breadcrumb breadcrumbs".split())
_OUTER_WORDS = set("nav navbar navigation menu topbar toolbar header masthead footer bottom copyright widget search login logo".split())

#: Words that leave a name of chrome one, as in "related-posts"; any other makes it doubtful within main.
_FILLER_WORDS = set("area articles bar block body bottom box button buttons container content count div entry form group inner item items left links list message meta outer page panel post posts reader readers right section site slot stories thread top unit user users widget wrap wrapper".split())
#: Names that are never a paragraph's own part of an article.
_PAID_WORDS = set("ad ads adv advert advertisement advertising sponsor sponsored promo promotion cookie cookies".split())
#: Elements of running text; their names never decide within main.
_TEXT_TAGS = set("p h1 h2 h3 h4 h5 h6 li dt dd td th blockquote pre figure figcaption table tr caption".split())

#: A tag's attributes; a stray < ends them. Nothing is gone back on, so that marks without an end cost one pass.
_ATTRIBUTES = r"(?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+"
_MARK = re.compile(rf"<!--.*?(?:-->|\Z)|<({_RAW})(?=[\s/>]){_ATTRIBUTES}>.*?(?:</\1\s*+>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)({_ATTRIBUTES})>|<[!?][^<>]*+>", re.S | re.I)
_SKIPPED_TAG = re.compile(rf"<(/?)({'|'.join(sorted(_SKIPPED))})(?=[\s/>])", re.I)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[a-z0-9]+")
_SPACES = re.compile(r"\s+")


def _zone(tag: str, attributes: str, around: str) -> str | None:
    """The zone that an element opens; None if it doesn't open one."""
    if around == "chrome":
        return None
    if tag in _CHROME_TAGS or (tag == "header" and around not in ("main", "doubt")):
        return "chrome"
    zone = "main" if tag in ("article", "main") else None
    if attributes:
        given = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
        role = given.get("role", "").lower()
        if role in _CHROME_ROLES or "hidden" in given or given.get("aria-hidden", "").lower() == "true" or "display:none" in given.get("style", "").replace(" ", "").lower():
            return "chrome"
        names = [set(_WORD.findall(x.lower())) for x in re.sub(r"([a-z])([A-Z])", r"\1-\2", given.get("class", "") + " " + given.get("id", "")).split()]
        words = set().union(*names)
        if tag != "body" and words & _CHROME_WORDS:
            if around not in ("main", "doubt"):
                return "chrome"
            names = [{w for w in x if not w.isdigit()} for x in names]
            sure = any(x & _CHROME_WORDS and x <= _CHROME_WORDS | _FILLER_WORDS for x in names)
            paid = any(x & _PAID_WORDS and x <= _PAID_WORDS | _FILLER_WORDS for x in names)
            return "chrome" if paid or (sure and tag not in _TEXT_TAGS) else "doubt"
        if tag != "body" and around not in ("main", "doubt") and zone is None and words & _OUTER_WORDS:
            return "chrome"
        if role in ("main", "article") or given.get("itemprop", "").lower() == "articlebody":
            zone = "main"
    return None if zone == "main" and around == "doubt" else zone


def _tag_places(page: str) -> dict[tuple[str, str], list[int]]:
    """Where the start tags ("") and end tags ("/") of skipped elements are."""
    found: dict[tuple[str, str], list[int]] = {}
    for m in _SKIPPED_TAG.finditer(page):
        found.setdefault((m[2].lower(), m[1]), []).append(m.start())
    return found


def _ended(places: dict, tag: str, at: int) -> bool:
    """Whether the element whose start tag ends at ``at`` has an end tag of its own."""
    ends, starts = places.get((tag, "/"), []), places.get((tag, ""), [])
    end, start = bisect_left(ends, at), bisect_left(starts, at)
    return end < len(ends) and (tag in _NESTED or start == len(starts) or ends[end] < starts[start])


def blocks(page: str | None) -> list[tuple[str, str]]:
    """(zone, text) of a page's blocks in order; texts with single spaces, none empty.

    Skipped elements (``_SKIPPED``) have no text and cut no block.  They end
    with their end tag or an element around them; one without an end tag ends
    at the next block.
    """
    out: list[tuple[str, str]] = []
    stack: list[tuple[str, str, str]] = []  # tag, the zone around it, what is skipped around it
    places_of: dict[str, list[int]] = {}  # of a tag, or of all blocks ("/block") or skipped elements (""), in the stack
    pieces: list[str] = []
    zone, at = "open", 0
    skipped = ""  # "ended" or "cut off" within a skipped element with or without an end tag
    places = None

    def close():
        if pieces:
            text = _SPACES.sub(" ", html.unescape("".join(pieces))).strip()
            if text:
                out.append((zone, text))
            pieces.clear()

    def kinds(tag: str):
        return (tag, "") if tag in _SKIPPED else (tag, "/block") if tag in _BLOCK else (tag,)

    def put(tag: str):
        for kind in kinds(tag):
            places_of.setdefault(kind, []).append(len(stack))
        stack.append((tag, zone, skipped))

    def last(kind: str) -> int:
        found = places_of.get(kind)
        return found[-1] if found else -1

    def cut(i: int):
        while len(stack) > i:
            for kind in kinds(stack.pop()[0]):
                places_of[kind].pop()

    page = page or ""
    for m in _MARK.finditer(page):
        if m.start() > at and not skipped:
            pieces.append(page[at : m.start()])
        at = m.end()
        if not m[3]:
            continue
        tag = m[3].lower()
        if tag == "br":
            if not skipped:
                pieces.append(" ")
            continue
        if tag in _BLOCK and not m[2] and skipped == "cut off":
            while skipped == "cut off":
                skipped = stack[-1][2]
                cut(len(stack) - 1)
        if tag in _BLOCK and not skipped:
            close()
        if tag in _VOID:
            continue
        if m[2]:
            i = last(tag)
            if i >= 0 and not (skipped == "ended" and tag in ("p", "li") and last("") > i):
                if stack[i][1] != zone or (tag in _BLOCK and not stack[i][2]):
                    close()
                _, zone, skipped = stack[i]
                cut(i)
            continue
        if tag in _SKIPPED:
            if m[4].endswith("/") and tag == "svg":
                continue
            places = _tag_places(page) if places is None else places
            put(tag)
            if skipped != "ended":
                skipped = "ended" if _ended(places, tag, m.end()) else "cut off"
            continue
        if tag in ("p", "li") or tag == "body":  # these end an open one of their kind
            i = max(last(tag), last("head")) if tag == "body" else last(tag)
            if i >= 0 and (tag == "body" or not last("/block") > i and not last("") > i):
                _, zone, skipped = stack[i]
                cut(i)
        put(tag)
        own = None if skipped else _zone(tag, m[4].strip(" /"), zone)
        if own and own != zone:
            close()
            zone = own
    if not skipped:
        pieces.append(page[at:])
    close()
    return out


_HOST = re.compile(r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", re.I)


def host_of(url: str | None) -> str:
    m = _HOST.match(url or "")
    return m[1].lower() if m else ""


def _parsed(batches):
    """Pages with the blocks their text is made of, whether each is asked about, and their token streams, in which these come first."""
    for batch in batches:
        for start, pages in text_batches(batch, "html"):
            parts, asked, streams = [], [], []
            for page in pages:
                found = blocks(page)
                main = any(z == "main" for z, _ in found)
                own = [(z, t) for z, t in found if z in (("main", "doubt") if main else ("open", "doubt"))]
                parts.append([t for _, t in own])
                asked.append([z != "main" for z, _ in own])
                streams.append("\n".join([t for z, t in own if z != "main"] + [t for z, t in found if z == "chrome" or (main and z == "open")]))
            words, bounds = word_hashes(streams)
            hosts = [host_of(u) for u in batch.column("url").slice(start, len(pages)).to_pylist()]
            out = [batch.column(c).slice(start, len(pages)) for c in ("page_id", "url", "row")]
            out += [pa.array(hosts), pa.array(parts, pa.list_(pa.string())), pa.array(asked, pa.list_(pa.bool_())), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(words.view(np.int64)))]
            yield pa.RecordBatch.from_arrays(out, names=["page_id", "url", "row", "host", "parts", "asked", "words"])


_PARSED = "page_id long, url string, row long, host string, parts array<string>, asked array<boolean>, words array<long>"


def suffix_order(tokens: np.ndarray, run: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes sorted by their first ``run`` tokens (a power of two), and the rank of each suffix, equal if these tokens are."""
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64) + 1
    width = 1
    while width < run:
        after = np.zeros_like(rank)
        after[:-width] = rank[width:]
        rank = np.unique(rank * (int(rank.max()) + 1) + after, return_inverse=True)[1].astype(np.int64) + 1
        width *= 2
    return np.argsort(rank, kind="stable"), rank


def _repeats(shard: pd.DataFrame, several: bool):
    """(gram, first page, last page) of the shard's grams: all if the host has several shards, else those on distinct pages."""
    lists = [np.asarray(w, np.int64).view(np.uint64) for w in shard["words"]]
    sizes = np.array([len(w) + 1 for w in lists])
    tokens = np.concatenate([np.append(w, np.uint64(i)) for i, w in enumerate(lists)])  # a page's number ends its stream
    page = np.repeat(np.arange(len(lists)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - 1 - np.arange(len(tokens))
    if len(tokens) < RUN:
        return
    order, rank = suffix_order(tokens)
    order = order[left[order] >= RUN]
    if not len(order):
        return
    new = np.flatnonzero(np.concatenate(([True], rank[order][1:] != rank[order][:-1])))
    pages = shard["page"].to_numpy()[page[order]]
    first, last = np.minimum.reduceat(pages, new), np.maximum.reduceat(pages, new)
    keep = np.ones(len(new), bool) if several else first != last
    grams = gram_hashes(tokens, RUN)[order[new]]
    yield grams[keep], first[keep], last[keep]


def _shards(batches):
    held: list[pd.DataFrame] = []

    def whole(frame):
        for (host, _), shard in frame.groupby(["host", "shard"], sort=False):
            for gram, first, last in _repeats(shard, bool(shard["shards"].iloc[0] > 1)):
                yield pa.RecordBatch.from_arrays([pa.array([host] * len(gram), pa.string()), pa.array(gram.view(np.int64)), pa.array(first), pa.array(last)], names=["host", "gram", "first", "last"])

    for batch in batches:
        held.append(batch.to_pandas())
        frame = pd.concat(held)
        last = (frame["host"] == frame["host"].iloc[-1]) & (frame["shard"] == frame["shard"].iloc[-1])
        yield from whole(frame[~last])
        held = [frame[last]]
    if held:
        yield from whole(pd.concat(held))


def _places(batches):
    """(row, host, place, gram) of pages' token streams."""
    for batch in batches:
        for row, host, words in zip(*(batch.column(c).to_pylist() for c in ("row", "host", "words")), strict=True):
            grams = gram_hashes(np.array(words, np.int64).view(np.uint64), RUN).view(np.int64)
            n = len(grams)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, row)), pa.array([host] * n, pa.string()), pa.array(np.arange(n)), pa.array(grams)], names=["row", "host", "place", "gram"])


def _unique_runs(batches):
    for batch in batches:
        texts = []
        for parts, asked, places in zip(*(batch.column(c).to_pylist() for c in ("parts", "asked", "places")), strict=True):
            words = [t.split(" ") for t in parts]  # as word_hashes splits them: a block's white space is single spaces
            covered = np.zeros(sum(len(w) for w, a in zip(words, asked, strict=True) if a) + RUN, bool)
            for p in places or []:
                covered[p : p + RUN] = True
            at, kept = 0, []
            for t, own, ask in zip(parts, words, asked, strict=True):
                if not ask:
                    kept.append(t)
                    continue
                kept.append(" ".join(compress(own, ~covered[at : at + len(own)])))
                at += len(own)
            texts.append("\n".join(filter(None, kept)))
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts)], names=["row", "unique"])


def main_texts(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars): the main text of each row of ``pages`` (page_id, url, html).

    Character references are decoded, white space within a block is one space,
    blocks are joined by one line feed.  A null or empty page gives an empty
    text.  Pages with a null or odd url have no host, so nothing is repeated on
    them.  Repeated rows each have their text.  An empty table gives no rows.
    """
    rows = pages.select("page_id", "url", "html").withColumn("row", F.monotonically_increasing_id())
    parsed = stored(rows.mapInArrow(_parsed, _PARSED), "pages")
    undecided = parsed.where(F.array_contains("asked", True) & (F.col("host") != ""))
    copies = near_duplicates(undecided.select(F.col("row").alias("doc_id"), F.array_join("parts", "\n").alias("text")), COPIES)
    copies = copies.select(F.col("doc_id").alias("row"), F.col("component_id").alias("page")).where("row <> page")
    streams = parsed.where((F.size("words") >= RUN) & (F.col("host") != ""))
    hosts = streams.groupBy("host").agg(F.sum(F.size("words").cast("long")).alias("n"))
    shards = F.greatest(F.lit(1), F.ceil(F.col("n") / SHARD)).cast("long")
    streams = streams.select("host", "row", "words").join(hosts.select("host", shards.alias("shards")), "host")
    streams = streams.join(copies, "row", "left").withColumn("page", F.coalesce("page", "row"))
    streams = streams.withColumn("shard", F.pmod(F.xxhash64("row"), "shards")).repartition("host", "shard").sortWithinPartitions("host", "shard")
    grams = streams.mapInArrow(_shards, "host string, gram long, first long, last long")
    repeats = stored(grams.groupBy("host", "gram").agg(F.min("first").alias("first"), F.max("last").alias("last")).where("first <> last").select("host", "gram"), "repeats")
    places = undecided.select("row", "host", "words").mapInArrow(_places, "row long, host string, place long, gram long")
    places = places.join(repeats, ["host", "gram"], "left_semi").groupBy("row").agg(F.collect_list("place").alias("places"))
    unique = undecided.select("row", "parts", "asked").join(places, "row", "left").mapInArrow(_unique_runs, "row long, unique string")
    decided = parsed.where(~F.array_contains("asked", True) | (F.col("host") == "")).select("page_id", "url", F.array_join("parts", "\n").alias("text"))
    rest = undecided.select("page_id", "url", "row").join(unique, "row").select("page_id", "url", F.col("unique").alias("text"))
    return decided.unionAll(rest).withColumn("n_chars", F.length("text").cast("long"))
