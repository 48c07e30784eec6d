"""The main text of web pages: structure where it speaks, and suffix arrays over each site's pages where it is silent.

A page is cut into blocks. Tags and attributes settle many of them: what stands in an article or main element is text,
what stands in menus, headers, footers, sidebars, notices, adverts, forms or comments isn't. A class or id settles a part only
if it says nothing else; one that merely has such a word in it nominates the part, within an article as well. On sites that
have nominated or other blocks, too, the pages' token streams are concatenated, a suffix array finds long runs of tokens that
recur on distinct pages, and the blocks that such runs cover are dropped; unique runs stay, wherever they are.

Sites are dealt into cells of a bounded number of pages, and tasks build their arrays over some cells at a time. A site with
more pages than a cell holds has them in several cells; its cells first tell the runs they have, and runs that are on
enough pages of all cells together come back to them, so a run is found wherever its pages lie.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import saved
from .words import LOWER, U64, find_words, mix, span_hashes

TEXT, OPEN, CHROME = 1, 0, -1
#: What an element may say besides: its blocks are for the runs to judge; an article that is text unless the page has another.
NOMINATED, OTHER = 2, 3
#: Tokens of a run that counts as long, and distinct pages that it must be on.
LONG, PAGES = 8, 2
#: Share of an open block's tokens that long runs must cover for it to go.
COVERED = 0.8
CELL_PAGES = 64
#: Pages are dealt over so many salts where they meet what is known of their site, as one site may have a third of them.
SITE_SALTS = 16
#: Cells are taken together up to so many tokens.
BATCH_TOKENS = 1 << 18

#: Elements whose content is no markup and ends at their own end tag only; elements left out with all that is in them; and
#: those of them that can't stand inside themselves.
_RAW = frozenset("script style title textarea iframe".split())
_SKIP = frozenset("noscript template svg object canvas select button audio video".split())
_NOT_NESTED = frozenset("select button".split())
_CHROME_TAGS = frozenset("nav aside footer form dialog menu".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
_CHROME_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog status menu menubar toolbar".split())
#: A class or id with one of these words marks a part that isn't main text.
_CHROME_WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adbox adslot adsbygoogle banner banners breadcrumb breadcrumbs comment comments commentlist consent cookie "
    "cookies disqus footer gdpr header login masthead menu menus modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promos "
    "promoted promotion related recommended replies reply respond responses share sharing sidebar sidebars signup social sponsor sponsored sponsors subscribe subscription tags toolbar topbar "
    "widget widgets alert alerts toc skip donate rail".split()
)
#: Of those, words that also name parts of a text; and words that only say what is near or how a part is laid out.
_CHROME_UNLESS_TEXT = frozenset(("header", "tags", "banner", "alert"))
_OTHER_ARTICLES = frozenset("comment comments reply replies ad ads advert promo sponsored related teaser".split())
_LAYOUT = frozenset("has with without no not wrap wrapper layout container open closed enabled".split())
#: Words beside which a word of the list above still means the part itself, as in ``siteFooter`` or ``comment-list``.
_NEUTRAL = frozenset("site page post posts article articles main list link links box block section area unit slot bar top bottom left right global primary secondary inner outer group button buttons icon icons".split())
_TEXT_WORDS = frozenset("article content entry main post story text body".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'=<>/]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_SPACE = re.compile(r"\s+")
_PARTS = re.compile(r"[^a-z]+")


def _names_chrome(name: str) -> int:
    """Whether one class or id names a part without main text: CHROME for one like ``article-comments`` or ``siteFooter``, which
    says no more; NOMINATED for one like ``notice-board``, which may be about something else; else OPEN."""
    words = set(_PARTS.split(re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower())) - {""}
    chrome = words & _CHROME_WORDS
    if not chrome or words & _LAYOUT or chrome <= _CHROME_UNLESS_TEXT and words & _TEXT_WORDS:
        return OPEN
    return NOMINATED if words - chrome - _NEUTRAL else CHROME


def _standing(tag: str, attributes: str, inside_article: bool) -> int:
    """What an element's tag and attributes say about the text in it."""
    if tag in _CHROME_TAGS or tag == "header" and not inside_article:
        return CHROME
    if not attributes:
        return TEXT if tag in ("article", "main") else OPEN
    named = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(attributes)}
    found = {k: v.lower() for k, v in named.items()}
    if found.get("role") in _CHROME_ROLES or "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", ""):
        return CHROME
    names = f"{named.get('class', '')} {named.get('id', '')}".split()
    if tag in ("article", "main"):  # comments and teasers can be articles, too
        other = tag == "article" and any(_names_chrome(x) == CHROME and _OTHER_ARTICLES & set(_PARTS.split(x.lower())) for x in names)
        return TEXT if not other else CHROME if inside_article else OTHER
    said = set(map(_names_chrome, names)) if tag not in ("body", "html") else set()
    if CHROME in said:
        return CHROME
    if found.get("role") in ("main", "article") or found.get("itemprop") == "articlebody":
        return TEXT
    return NOMINATED if NOMINATED in said else OPEN


def blocks_of(html: str) -> list[tuple[int, str]]:
    """(standing, text) of the page's blocks that have text, in page order."""
    out: list[tuple[int, str]] = []
    parts: list[str] = []
    stack: list[tuple[str, int, bool]] = []  # open elements, what holds in them, and whether they are within an article
    standing, within, at = OPEN, False, 0

    def flush() -> None:
        if parts:
            text = _SPACE.sub(" ", unescape("".join(parts))).strip()
            parts.clear()
            if text:
                out.append((standing, text))

    while m := _TOKEN.search(html, at):
        if m.start() > at:
            parts.append(html[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        closing, tag, attributes = m[1], m[2].lower(), m[3]
        if (tag in _RAW or tag in _SKIP) and not closing:
            if tag in _RAW or not attributes.endswith("/"):
                at = _after_element(html, at, tag)
            if tag == "title":
                flush()
            continue
        if tag in _BLOCK:
            flush()
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
        elif tag not in _VOID and not attributes.endswith("/"):
            said = OPEN if standing == CHROME else _standing(tag, attributes, within)
            own = OPEN if said == NOMINATED else said or standing
            if tag == "p" and stack and stack[-1][0] == "p":
                stack.pop()  # a paragraph ends the one before
            if own != standing and tag not in _BLOCK:
                flush()
            stack.append((tag, own, within or said in (TEXT, OTHER)))
        now, within = stack[-1][1:] if stack else (OPEN, False)
        if now != standing:
            flush()
            standing = now
    parts.append(html[at:])
    flush()
    other = CHROME if any(x == TEXT for x, _ in out) else TEXT
    return [(other if x == OTHER else x, text) for x, text in out]


def _after_element(html: str, at: int, tag: str) -> int:
    """Where the content of an element that begins at ``at`` and is left out ends.

    Without an end tag, content that is no markup goes on to the page's end; any other such element is taken as empty.
    """
    end = re.compile(rf"</?{tag}(?=[\s/>])[^>]*>?" if tag in _NOT_NESTED else rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(html, at)
    if end is None:
        return len(html) if tag in _RAW else at
    return end.end() if end[0].startswith("</") else end.start()


def suffix_ranks(stream: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of a token stream, sorted by the first ``length`` tokens, and each suffix's rank.

    Prefix doubling: ranks by 2 ** k tokens come from pairs of ranks by half as many. Suffixes with equal starts of that
    length have equal ranks. ``length`` must be a power of two.
    """
    _, rank = np.unique(stream, return_inverse=True)
    rank = rank.astype(np.int64)
    step = 1
    while step < length:
        second = np.zeros_like(rank)
        second[:-step] = rank[step:] + 1 if step < len(rank) else 0
        _, rank = np.unique(rank * (rank.max(initial=0) + 2) + second, return_inverse=True)
        rank = rank.astype(np.int64)
        step *= 2
    return np.argsort(rank, kind="stable"), rank


def windows_on_pages(stream: np.ndarray, page: np.ndarray, length: int = LONG) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes whose first ``length`` tokens lie on one page, in the suffix array's order; the number of the group of
    suffixes that start alike, for each; and how many distinct pages each group is on."""
    n = len(stream)
    if n < length:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    order, rank = suffix_ranks(stream, length)
    whole = np.zeros(n, dtype=bool)
    whole[: n - length + 1] = page[: n - length + 1] == page[length - 1 :]
    order = order[whole[order]]
    names, group = np.unique(rank[order], return_inverse=True)
    pairs = np.unique(group * (page.max(initial=0) + 1) + page[order])
    return order, group, np.bincount(pairs // (page.max(initial=0) + 1), minlength=len(names))


def covered_by(begins: np.ndarray, n: int, length: int = LONG) -> np.ndarray:
    """Places of a stream of n tokens that the windows at these places cover; a longer run is covered by its windows."""
    edges = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edges, begins, 1)
    np.subtract.at(edges, np.minimum(begins + length, n), 1)
    return np.cumsum(edges[:n]) > 0


_FACTORS = np.random.Generator(np.random.PCG64(99)).integers(0, 2**64, LONG, dtype=U64) | U64(1)


def window_hashes(stream: np.ndarray, begins: np.ndarray) -> np.ndarray:
    return mix(sum((stream[begins + k] * f for k, f in enumerate(_FACTORS)), np.zeros(len(begins), dtype=U64)))


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``(key, site, html)`` to the token streams of all blocks but those settled as text.

    ``tokens`` are hashes of lower-cased words with the site in them, so sites never share a run; ``blocks`` has each
    token's block, as its negative less one if the block isn't open. ``open`` says whether the page has open blocks.
    """
    for batch in batches:
        keys, sites, tokens, blocks, is_open = [], [], [], [], []
        for key, site, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            found = [(k, standing, text) for k, (standing, text) in enumerate(blocks_of(html.as_py() or "")) if standing != TEXT]
            if not found:
                continue
            data = LOWER[np.frombuffer("\n".join(text for _, _, text in found).encode(), dtype=np.uint8)]
            start, end, _ = find_words(data, np.array([0, len(data)]))
            lengths = np.array([len(text.encode()) + 1 for _, _, text in found])
            of = np.searchsorted(np.cumsum(lengths), start, side="right")
            number = np.array([k if standing == OPEN else -k - 1 for k, standing, _ in found], dtype=np.int32)
            keys.append(key)
            sites.append(site)
            tokens.append(mix(span_hashes(data, start, end) ^ U64(site & 0xFFFFFFFFFFFFFFFF)).view(np.int64))
            blocks.append(number[of])
            is_open.append(bool((number >= 0).any()))
        columns = [pa.array(keys, pa.int64()), pa.array(sites, pa.int64()), pa.array(tokens, pa.list_(pa.int64())), pa.array(blocks, pa.list_(pa.int32())), pa.array(is_open, pa.bool_())]
        yield pa.RecordBatch.from_arrays(columns, ["key", "site", "tokens", "blocks", "open"])


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows in the order of their cells, as tables of whole cells with about ``BATCH_TOKENS`` tokens or one cell."""
    held: list[pa.RecordBatch] = []
    tokens = 0
    for batch in batches:
        for at in range(0, batch.num_rows, CELL_PAGES):
            part = batch.slice(at, CELL_PAGES)
            held.append(part)
            tokens += len(part.column("tokens").flatten())
            if tokens >= BATCH_TOKENS:
                table = pa.Table.from_batches(held)
                cell = table["cell"].to_numpy()
                done = int(np.searchsorted(cell, cell[-1]))  # the last cell may go on
                if done:
                    yield table.slice(0, done)
                held = table.slice(done).to_batches()
                tokens = sum(len(x.column("tokens").flatten()) for x in held)
    if held:
        yield pa.Table.from_batches(held)


def _concatenated(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens, the row of each, its block, and each row's cell."""
    lists = table["tokens"].combine_chunks()
    row = np.repeat(np.arange(table.num_rows), lists.value_lengths().to_numpy())
    return lists.flatten().to_numpy().view(U64), row, table["blocks"].combine_chunks().flatten().to_numpy(), table["cell"].to_numpy()


def _tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct windows of each cell and on how many of its pages each is."""
    for table in _cells(batches):
        stream, row, _, cell = _concatenated(table)
        order, group, _ = windows_on_pages(stream, row)
        if not len(order):
            continue
        name = window_hashes(stream, order)
        pairs = np.unique(np.rec.fromarrays([cell[row[order]], name, row[order]], names="cell,window,row"))
        found, first, n = np.unique(pairs[["cell", "window"]], return_index=True, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(found["cell"])), pa.array(np.ascontiguousarray(found["window"]).view(np.int64)), pa.array(n, pa.int64())], ["cell", "window", "n"])


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The open blocks ``(key, block)`` that long runs cover. Rows without a key carry windows known from other cells."""
    for table in _cells(batches):
        told = table.filter(pa.compute.is_null(table["key"]))
        table = table.filter(pa.compute.is_valid(table["key"]))
        stream, row, block, _ = _concatenated(table)
        if not len(stream):
            continue
        order, group, pages = windows_on_pages(stream, row)
        known = np.unique(told["tokens"].combine_chunks().flatten().to_numpy()).view(U64)
        begins = order[(pages[group] >= PAGES) | (np.isin(window_hashes(stream, order), known) if len(known) else False)]
        covered = covered_by(begins, len(stream))
        place = np.flatnonzero(block >= 0)
        width = int(block.max(initial=0)) + 1
        names, at = np.unique(row[place] * width + block[place], return_inverse=True)
        go = np.bincount(at, weights=covered[place]) >= COVERED * np.bincount(at)
        keys = table["key"].to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(keys[names[go] // width]), pa.array((names[go] % width).astype(np.int32))], ["key", "block"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``(page_id, url, html, dropped)`` to the main text: blocks that are text, and open ones not dropped."""
    for batch in batches:
        texts = []
        for html, dropped in zip(batch.column(2), batch.column(3).to_pylist()):
            gone = set(dropped or ())
            texts.append(" ".join(text for k, (standing, text) in enumerate(blocks_of(html.as_py() or "")) if standing == TEXT or standing == OPEN and k not in gone))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def site_of(url: Column) -> Column:
    """The host of a URL in lower case; a null or unreadable URL belongs to the site without a name."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


def main_texts(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", cell_pages: int = CELL_PAGES) -> DataFrame:
    """``page_id, url, text`` for each row of ``pages``; the text is empty where a page has none.

    White space inside a block becomes one space, blocks are joined by one. Null html is empty. Repeated rows count as one
    page when runs are looked for, and each gets its text; there are no other ties. Runs are looked for on sites that have
    open blocks; where structure settles all blocks of all pages nothing is left to find. Very long pages are parsed whole.
    Other columns are ignored, and an empty table gives an empty result.
    """
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    keyed = rows.withColumn("key", F.xxhash64("page_id", "url", "html"))
    kinds = "key long, site long, tokens array<long>, blocks array<int>, open boolean"
    streams = saved(keyed.select("key", F.xxhash64(site_of(F.col("url"))).alias("site"), "html").mapInArrow(_streams, kinds).dropDuplicates(["key"]), "streams")
    asked = streams.groupBy("site").agg(F.count("*").alias("count"), F.max("open").alias("open")).where("open")
    if asked.isEmpty():
        return keyed.withColumn("dropped", F.lit(None).cast("array<int>")).select("page_id", "url", "html", "dropped").mapInArrow(_texts, "page_id long, url string, text string")
    asked = asked.select("site", F.when(F.col("count") > cell_pages, F.ceil(F.col("count") / cell_pages).cast("int")).alias("cells"), F.explode(F.sequence(F.lit(0), F.lit(SITE_SALTS - 1))).alias("salt"))
    dealt = streams.withColumn("salt", F.pmod("key", F.lit(SITE_SALTS)).cast("int")).join(asked.hint("merge"), ["site", "salt"])
    dealt = dealt.withColumn("cell", F.when(F.col("cells").isNotNull(), F.xxhash64("site", F.pmod("key", "cells"))).otherwise(F.col("site")))
    by_cell = lambda df: df.repartition("cell").sortWithinPartitions("cell")
    spread = dealt.where("cells IS NOT NULL").select("cell", "key", "tokens", "blocks")
    told = saved(by_cell(spread).mapInArrow(_tell, "cell long, window long, n long"), "windows")
    wide = told.groupBy("window").agg(F.sum("n").alias("pages"), F.count("*").alias("cells")).where((F.col("pages") >= PAGES) & (F.col("cells") > 1)).select("window")
    known = told.join(wide.hint("merge"), "window", "left_semi").select("cell", F.lit(None).cast("long").alias("key"), F.array("window").alias("tokens"), F.array().cast("array<int>").alias("blocks"))
    verdicts = saved(by_cell(dealt.select("cell", "key", "tokens", "blocks").unionByName(known)).mapInArrow(_judge, "key long, block int"), "verdicts")
    whole = keyed.join(verdicts.groupBy("key").agg(F.collect_set("block").alias("dropped")), "key", "left")
    return whole.select("page_id", "url", "html", "dropped").mapInArrow(_texts, "page_id long, url string, text string")
