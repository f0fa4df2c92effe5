"""Main text of web pages: markup roles, and a suffix array over each host's token streams."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from commentguard.plans.shared import written

#: Bytes of HTML of a host that one suffix array covers; a larger host has several.
PART_BYTES = 1_500_000
#: Tokens from which a repeated substring is long.
LONG = 8
#: Inside a marked article a repeat only counts as the host's boilerplate on this share of its pages, and so many at least.
ARTICLE_SHARE, ARTICLE_PAGES = 0.5, 4
#: Share of a block's characters inside links that makes it a menu, where no article is marked.
LINKS = 0.6

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split()
)
DROPPED = frozenset("aside button dialog footer form menu nav".split())
IMPLIED_END = frozenset("dd dt li option p td th tr".split())
DROPPED_ROLES = frozenset("alert banner complementary contentinfo dialog navigation search".split())
#: Words of a class or id that mark menus, headers, footers, sidebars, notices, adverts, forms and reader comments.
DROPPED_WORDS = frozenset(
    "ad ads advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus "
    "footer form gdpr login masthead menu modal nav navbar navigation newsletter notice notices notification pager pagination popup "
    "promo promoted recommended related replies reply respond share sharing sidebar signup social sponsor sponsored subscribe teaser "
    "toolbar widget".split()
)
HEADER_WORDS = frozenset(["header", "topbar"])
_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|template|noscript|textarea|select|svg|iframe|object|canvas|math|title)\b[^>]*+>.*?(?:</\1\s*>|\Z)"
    r"""|<(/?)([a-z][a-z0-9:-]*+)((?:[^>"'=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|["'=])*+)>"""
    r"|<[!?][^>]*+>",
    re.I | re.S,
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop|hidden|aria-hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_WORDS = re.compile(r"[a-z]+|\d+")


def _role(tag: str, attributes: str, above: int) -> int:
    """0 for what is not of the article, 2 for a marked article, 1 for the rest, as far as the element says."""
    if above == 0 or (tag in DROPPED) or (tag == "header" and above != 2):
        return 0
    own = above
    if tag in ("article", "main"):
        own = 2
    for m in _ATTRIBUTE.finditer(attributes) if attributes else ():
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name in ("class", "id") and tag not in ("html", "body", "main"):
            marks = set(_WORDS.findall(value))
            if marks & DROPPED_WORDS or (marks & HEADER_WORDS and own != 2):
                return 0
        elif name == "role":
            own = 0 if value in DROPPED_ROLES else 2 if value in ("main", "article") else own
        elif name == "itemprop" and value == "articlebody":
            own = 2
        elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
            return 0
        if own == 0:
            return 0
    return own


def blocks_of(page: str | None) -> list[tuple[int, str]]:
    """(role, text) of the page's blocks that markup does not rule out: 2 in a marked article, 1 elsewhere.

    References are decoded, white space inside a block is one blank, and blocks
    without text are left out.  An end tag closes what is open inside its
    element; one that fits nothing is ignored.
    """
    page = page or ""
    out: list[tuple[int, str]] = []
    stack: list[tuple[str, int]] = []
    parts: list[str] = []
    linked, links = 0, 0

    def flush() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split()) if parts else ""
        role = stack[-1][1] if stack else 1
        if text and role:
            menu = role == 1 and linked >= LINKS * len(text)
            if not menu:
                out.append((role, text))
        parts.clear()
        linked = 0

    at = 0
    for m in _MARKUP.finditer(page):
        if m.start() > at:
            parts.append(page[at : m.start()])
            linked += (m.start() - at) * (links > 0)
        at = m.end()
        tag = m[3]
        if tag is None:
            continue
        tag = tag.lower()
        if m[2]:
            if tag == "a":
                links = max(0, links - 1)
            spot = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag), None)
            if tag not in INLINE or spot is not None:
                flush()
            if spot is not None:
                del stack[spot:]
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag == "br":
                parts.append(" ")
            continue
        above = stack[-1][1] if stack else 1
        role = _role(tag, m[4], above)
        if tag in INLINE:
            links += tag == "a"
            if role != above:
                flush()
                stack.append((tag, role))
            continue
        flush()
        while stack and (stack[-1][0] == "p" or (stack[-1][0] == tag and tag in IMPLIED_END)):
            stack.pop()
            role = _role(tag, m[4], stack[-1][1] if stack else 1)
        stack.append((tag, role))
    parts.append(page[at:])
    flush()
    return out


def _sequence(streams: list[list[list[str]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """The pages' tokens as one sequence: number, page and tokens left on the page of each place; the tokens by number.

    0 stands between blocks, a negative number ends a page: no substring runs over it.
    """
    numbers: dict[str, int] = {}
    codes, pages = [], []
    for page, blocks in enumerate(streams):
        row = [0]
        for block in blocks:
            row += [numbers.setdefault(w, len(numbers) + 1) for w in block]
            row.append(0)
        codes += [*row, -page - 1]
        pages += [page] * (len(row) + 1)
    codes = np.array(codes, np.int64)
    ends = np.flatnonzero(codes < 0)
    room = ends[np.searchsorted(ends, np.arange(len(codes)))] - np.arange(len(codes))
    return codes, np.array(pages, np.int64), room, list(numbers)


def _window_hashes(codes: np.ndarray, words: list[str], host: str) -> np.ndarray:
    """A 64-bit hash of the host and the ``LONG`` tokens from each place on."""
    own = np.array([xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in ["", *words]], np.uint64)
    tokens, out = own[np.maximum(codes, 0)], np.full(len(codes), xxhash.xxh64_intdigest(host), np.uint64)
    for k in range(LONG):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out[: len(out) - k] += tokens[k:]
        out ^= out >> np.uint64(31)
    return out.view(np.int64)


def window_counts(streams: list[list[list[str]]], host: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct window hashes of the pages, and on how many of them each stands."""
    codes, owner, room, words = _sequence(streams)
    here = room >= LONG
    pairs = np.unique(np.stack([_window_hashes(codes, words, host)[here], owner[here]], axis=1), axis=0)
    return np.unique(pairs[:, 0], return_counts=True)


def repeats(
    streams: list[list[list[str]]], host: str = "", counts: tuple[np.ndarray, np.ndarray] | None = None,
) -> list[list[np.ndarray]]:
    """For each token of each block of each page: on how many pages the longest-shared substring around it occurs.

    The pages' tokens, with a mark between blocks, are one sequence.  Its
    suffixes are sorted by doubling to the depth of ``LONG`` tokens; suffixes of
    equal rank begin with the same long substring.  ``counts`` has the window
    hashes (sorted) that stand on several pages of the whole host, where these
    are only some of its pages, and the number of those pages.
    """
    codes, owner, room, words = _sequence(streams)
    size = len(codes)
    rank, depth = codes.copy(), 1
    rank[rank < 0] = len(words) - rank[rank < 0]
    while depth < LONG:
        # As many ranks as fit in one number take the place of doubling where that is more.
        bits = int(rank.max() + 2).bit_length()
        shifts = sorted({min(j * depth, LONG - depth) for j in range(max(2, 63 // bits))})
        key = np.zeros(size, np.int64)
        for shift in shifts:
            key <<= bits
            key[: max(0, size - shift)] += rank[shift:] + 1
        rank = np.unique(key, return_inverse=True)[1].astype(np.int64)
        depth += shifts[-1]
    both = np.unique(rank * len(streams) + owner)
    spread = np.bincount(both // len(streams))[rank]
    if counts is not None and len(counts[0]):
        hashes = _window_hashes(codes, words, host)
        spot = np.minimum(np.searchsorted(counts[0], hashes), len(counts[0]) - 1)
        spread = np.maximum(spread, np.where(counts[0][spot] == hashes, counts[1][spot], 1))
    spread = np.where(room >= LONG, spread, 1)
    most = spread.copy()
    for k in range(1, LONG):  # a token is covered by the substrings that start up to LONG - 1 before it
        most[k:] = np.maximum(most[k:], spread[:-k])
    out, at = [], 0
    for blocks in streams:
        at += 1
        own = []
        for block in blocks:
            own.append(most[at : at + len(block)])
            at += len(block) + 1
        out.append(own)
        at += 1
    return out


def _streams(pages: list[str | None]) -> list[tuple[bool, list[str]]]:
    """For each page whether an article is marked, and the texts of its blocks (only the article's, if so)."""
    found = []
    for page in pages:
        blocks = blocks_of(page)
        marked = [t for r, t in blocks if r == 2]
        found.append((bool(marked), marked or [t for _, t in blocks]))
    return found


def _without_runs(text: str, covered: np.ndarray) -> str:
    """The text without its covered runs of ``LONG`` tokens or more; nothing if all tokens are covered."""
    if not covered.any():
        return text
    if covered.all():
        return ""
    edges = np.flatnonzero(np.diff(np.r_[False, covered, False].astype(np.int8)))
    stays = np.ones(len(covered), bool)
    for start, end in edges.reshape(-1, 2).tolist():
        if end - start >= LONG:
            stays[start:end] = False
    return " ".join(w for w, s in zip(text.split(" "), stays.tolist(), strict=True) if s)


def main_texts(
    pages: list[str | None], host: str = "", n_pages: int | None = None, counts: tuple[np.ndarray, np.ndarray] | None = None,
) -> list[str]:
    """The main text of each page, of pages of one host.

    A page with a marked article gives its blocks, without the runs of tokens
    that the host's pages share as boilerplate; any other page gives what no
    other page has.  If repeats would leave nothing the page is a copy of
    another, and all its blocks stay.  If the host has more pages than these,
    ``n_pages`` is their number and ``counts`` as in ``repeats``.
    """
    return _main_texts(_streams(pages), host, n_pages or len(pages), counts)


def _main_texts(
    found: list[tuple[bool, list[str]]], host: str, n_pages: int, counts: tuple[np.ndarray, np.ndarray] | None,
) -> list[str]:
    shared = repeats([[t.split(" ") for t in texts] for _, texts in found], host, counts) if n_pages > 1 else None
    out = []
    for k, (marked, texts) in enumerate(found):
        kept = texts
        if shared:
            least = max(ARTICLE_PAGES, ARTICLE_SHARE * n_pages) if marked else 2
            kept = [rest for t, n in zip(texts, shared[k], strict=True) if (rest := _without_runs(t, n >= least))]
        out.append("\n".join(kept or texts))
    return out


def _host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def _parsed(pages: DataFrame) -> DataFrame:
    """page_id, url, n_bytes, whether an article is marked, the blocks of every page (Zstandard), and a number to deal it by."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen, packer = TaskContext.get().partitionId(), 0, zstandard.ZstdCompressor()
        for batch in batches:
            found = _streams(batch.column(2).to_pylist())
            # Blocks hold no line end.
            packed = [packer.compress("\n".join(t).encode()) if t else None for _, t in found]
            deal = [xxhash.xxh32_intdigest(f"{task} {seen + k}") for k in range(len(found))]
            seen += len(found)
            made = [pa.array([m for m, _ in found], pa.bool_()), pa.array(packed, pa.binary()), pa.array(deal, pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in (0, 1, 3)), *made], ["page_id", "url", "n_bytes", "marked", "blocks", "deal"]
            )

    size = F.coalesce(F.octet_length("html"), F.lit(0)).cast("long")
    schema = f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, n_bytes long, marked boolean, blocks binary, deal long"
    return pages.select("page_id", "url", "html", size.alias("n_bytes")).mapInArrow(parse, schema)


def _unpacked(table: pa.Table) -> list[list[str]]:
    """The blocks of each page of a part."""
    packer = zstandard.ZstdDecompressor()
    return [packer.decompress(p).decode().split("\n") if p else [] for p in table.column("blocks").to_pylist()]


def _windows(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """``window_counts`` of the pages of one part."""
    return window_counts([[t.split(" ") for t in texts] for texts in _unpacked(table)], str(table.column("seed")[0].as_py()))


def _window_rows(table: pa.Table, hashes: np.ndarray, counts: np.ndarray) -> pa.Table:
    columns = {c: pa.array([table.column(c)[0].as_py()] * len(hashes), pa.int64()) for c in ("part", "seed", "parts")} if len(hashes) else {
        c: pa.array([], pa.int64()) for c in ("part", "seed", "parts")
    }
    return pa.table(columns | {"hash": pa.array(hashes, pa.int64()), "n": pa.array(counts, pa.int64())})


def _host_counts(dealt: DataFrame, marked: bool, open_hosts: bool) -> DataFrame:
    """(part, hash, n): windows of a part, and on how many pages of the host they stand, where a page's text may depend on it.

    Where all of a host's pages have a marked article, only windows on the share
    ``ARTICLE_SHARE`` of its pages matter, and such a window is on that share of
    the pages of one part at least.  These few are named by the parts and then
    counted in all of them.  A host with other pages gives every window.
    """
    schema = "part long, seed long, parts long, hash long, n long"
    none = pa.array([], pa.int64())
    empty = pa.table({c: none for c in ("part", "seed", "parts", "hash", "n")})

    def frequent(table: pa.Table) -> pa.Table:
        if table.column("parts")[0].as_py() == 1 or table.column("open")[0].as_py():
            return empty
        hashes, counts = _windows(table)
        often = counts >= ARTICLE_SHARE * table.num_rows
        return _window_rows(table, hashes[often], counts[often])

    def every(table: pa.Table) -> pa.Table:
        if table.column("parts")[0].as_py() == 1 or not table.column("open")[0].as_py():
            return empty
        return _window_rows(table, *_windows(table))

    def asked(table: pa.Table, wanted: pa.Table) -> pa.Table:
        if not table.num_rows or not wanted.num_rows:
            return empty
        hashes, counts = _windows(table)
        known = np.isin(hashes, wanted.column("hash").to_numpy())
        return _window_rows(table, hashes[known], counts[known])

    counted = []
    if marked:
        named = dealt.groupBy("part").applyInArrow(frequent, schema).select("seed", "parts", "hash").distinct()
        named = named.select("hash", "seed", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("k"))
        named = named.select(F.xxhash64("seed", "k").alias("part"), "hash")
        counted.append(dealt.groupBy("part").cogroup(named.groupBy("part")).applyInArrow(asked, schema))
    if open_hosts:
        counted.append(dealt.groupBy("part").applyInArrow(every, schema))
    # A window has one row for each part of its host, not for each page.
    rows = reduce(DataFrame.union, counted).select("part", "hash", "n")
    return rows.withColumn("n", F.sum("n").over(Window.partitionBy("hash"))).where("n > 1")


def extract_pages(pages: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """page_id, url and text of every row of ``pages`` (page_id, url, html).

    Pages are parsed once, and compared by their blocks with all others of their
    host.  A host is dealt into parts of about ``part_bytes`` of HTML by the
    place of its rows, so that neither memory nor a task grows with it, equal
    rows included.  Where that makes several parts, windows of ``LONG`` tokens
    are counted over the host (``_host_counts``), so that a text does not depend
    on the deal.  A null url is a host of its own, null or empty html has an
    empty text, equal rows stay.
    """
    rows = written(_parsed(pages), "page-blocks")
    rows = rows.withColumn("host", _host(F.col("url")))
    sizes = rows.groupBy("host").agg(
        F.sum("n_bytes").alias("bytes"), F.count("*").alias("n_pages"), F.max(~F.col("marked") & F.col("blocks").isNotNull()).alias("open")
    )
    parts = sizes.select("host", "n_pages", "open", F.ceil(F.greatest(F.col("bytes"), F.lit(1)) / part_bytes).alias("parts"))
    several = F.col("parts") > 1
    n_hosts, marked, open_hosts = parts.agg(
        F.count("*"), F.count_if(several & ~F.col("open")), F.count_if(several & F.col("open"))
    ).first()
    # The parts are few rows for each host; the pages themselves move once, to their part.
    dealt = rows.join(F.broadcast(parts) if n_hosts <= 500_000 else parts, "host").withColumn("seed", F.xxhash64("host"))
    dealt = dealt.withColumn("part", F.xxhash64("seed", F.pmod("deal", "parts"))).select(
        "part", "seed", "parts", "open", "n_pages", "page_id", "url", "marked", "blocks"
    )
    schema = f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string"

    def texts_of(table: pa.Table, counts: tuple[np.ndarray, np.ndarray] | None) -> pa.Table:
        texts = []
        if table.num_rows:
            found = list(zip(table.column("marked").to_pylist(), _unpacked(table), strict=True))
            texts = _main_texts(found, str(table.column("seed")[0].as_py()), table.column("n_pages")[0].as_py(), counts)
        return pa.table({"page_id": table.column("page_id"), "url": table.column("url"), "text": pa.array(texts, pa.string())})

    def alone(table: pa.Table) -> pa.Table:
        return texts_of(table, None)

    def extract(table: pa.Table, known: pa.Table) -> pa.Table:
        hashes = known.column("hash").to_numpy() if known.num_rows else np.empty(0, np.int64)
        order = np.argsort(hashes)
        return texts_of(table, (hashes[order], known.column("n").to_numpy()[order]) if len(order) else None)

    if not marked and not open_hosts:
        return dealt.groupBy("part").applyInArrow(alone, schema)
    known = _host_counts(dealt, marked > 0, open_hosts > 0)
    return dealt.groupBy("part").cogroup(known.groupBy("part")).applyInArrow(extract, schema)
